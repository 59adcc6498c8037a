"""Record copies, residue, mixture and percentiles on small cases, against brute force."""

import json
import math
import random

import numpy as np
from pyspark.sql import functions as F

from stepforge.llm import mixture as M
from stepforge.llm import percentiles as P
from stepforge.llm import records as R
from stepforge.llm import residue as Q


def df_of(spark, rows):
    return spark.createDataFrame(rows, "id bigint, j string")


def test_copies_differ_only_in_form(spark):
    rows = [
        (5, '{"a": "Put the cup, now!", "b": [1, 2]}'),
        (9, '{ "b":[1,2],  "a":"put THE  cup now"}'),
        (1, '{"b": [2, 1], "a": "put the cup now"}'),  # another order in a list
        (2, '{"a": "move 5.1 cm", "b": [1, 2]}'),
        (3, '{"a": "move 51 cm", "b": [1, 2]}'),
        (4, '{"a": "move 5.1 cm.", "b": ["1", "2"]}'),  # 1 and "1" are equal values
        (6, None), (7, None), (8, "{broken"), (10, "{broken"), (11, "NaN"), (12, "NaN"),
        (13, '{"A": "Put the cup, now!", "b": [1, 2]}'),  # another field name
        (14, '"x"'), (15, '"X!"'), (16, "null"), (17, '{"a": null}'), (18, '{"a": "null"}'), (19, ""),
        (20, '{"a": "put the cup now", "b": [1, 2], "b": [1, 2]}'),
        (None, '"x"'),
    ]
    got = sorted((r.keep_id, r.copy_id) for r in R.copies(df_of(spark, rows), "id", "j").collect())
    assert got == [(2, 4), (5, 9), (14, 15)]
    classes = {r.keep_id: r.n_copies for r in R.copy_classes(df_of(spark, rows), "id", "j").collect()}
    assert classes == {1: 1, 2: 2, 3: 1, 5: 2, 13: 1, 14: 2, 16: 1, 17: 1, 18: 1, 20: 1}
    assert R.copies(df_of(spark, []), "id", "j").count() == 0


def test_a_third_of_all_rows_in_one_class(spark):
    rng = random.Random(4)
    rows = [(i, json.dumps({"t": f"row {i if i % 3 else 0}", "n": [i % 3 and i]})) for i in range(3000)]
    rng.shuffle(rows)
    got = R.copies(df_of(spark, rows).repartition(7), "id", "j")
    assert {r.keep_id for r in got.collect()} == {0} and got.count() == 999


def test_colliding_digests_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(R, "record_digests", lambda d, i, t: d.select(F.col(i).alias("_id"), F.lit(b"x").alias("_root"), F.col(t).cast("binary").alias("_form")))
    rows = [(1, "a"), (2, "b"), (3, "a"), (4, "b"), (5, "a")]
    got = sorted((r.keep_id, r.copy_id) for r in R.copies(df_of(spark, rows), "id", "j").collect())
    assert got == [(1, 3), (1, 5), (2, 4)]
    assert sorted((r.keep_id, r.n_copies) for r in R.copy_classes(df_of(spark, rows), "id", "j").collect()) == [(1, 3), (2, 2)]


RESIDUE = [
    "{{object}}", "put the <ARM> on the table", "pick up the {color:s} cup", "Task: __GOAL__", "go to ${place}", "%(verb)s it", "[insert task here]", "put it on ____",
    "N/A", "todo", "lorem ipsum dolor sit amet", "the recording has no picture", "no caption", "caption goes here", "test test 3",
    "404 Not Found", "502 bad gateway", "Seite nicht gefunden (Fehler 404)", "Traceback (most recent call last): KeyError: 'x'", "Something went wrong, try again later", "page introuvable",
    "Please enable JavaScript to view this page", "Veuillez activer JavaScript dans votre navigateur", "verify you are human to continue", "Checking your browser before you continue",
]
CONTENT = [
    "stack the {red, green, blue} cubes in that order", "[left arm] lift the cup [right arm] hold the table", "raise the lemon by 30% more", "use none of the silver blocks",
    "close the page of the book JavaScript for Beginners", "show the sign access denied to the head camera", "take the sample text card from the sink", "press the key labelled error on the table",
    "fill in the blank form with the marker", "plug the null modem cable into the server", "take the banana", "put the cup down <setup_start>two arms on rig 3<setup_end>", "insert the peg here, next to the tin",
]


def test_residue_and_content():
    assert [t for t in RESIDUE if Q.inspect(t)[0] != Q.STRONG] == []
    assert [t for t in CONTENT if Q.inspect(t)[0] == Q.STRONG] == []
    assert [t for t in RESIDUE if Q.inspect(f"1) Task: “{t}” (take 17)")[0] != Q.STRONG] == []


def records(spark, rows):
    return spark.createDataFrame(rows, "instr_id bigint, dataset string, task_slug string, instructions string, form string")


def test_residue_records(spark):
    rows = [(i, "d", "lift_cup", json.dumps({"caption": t, "view": "{{x}}"}), "x") for i, t in enumerate(CONTENT)]
    rows += [(100 + i, "d", None, json.dumps(["lift the cup", t]), "x") for i, t in enumerate(RESIDUE)]
    rows += [(200, "d", "s", None, "x"), (201, "d", "s", "{bad {{x}}", "x"), (202, "d", "s", '{"caption": "  "}', "x"), (203, None, None, '{"note": "404 not found"}', "x")]
    # A notice that no detector knows, given back for many tasks that it doesn't name.
    rows += [(300 + i, f"d{i % 3}", f"lift_thing{i}", json.dumps({"seen": ["Quota zeppelin exceeded, contact billing"]}), "x") for i in range(8)]
    got = {r.instr_id for r in Q.residue_records(records(spark, rows)).collect()}
    assert got == {100 + i for i in range(len(RESIDUE))} | {300 + i for i in range(8)}
    kept = Q.without_residue(records(spark, rows))
    assert kept.count() == len(rows) - len(got) and kept.columns[-1] == "form"
    assert Q.residue_records(records(spark, [])).count() == 0


def test_notices_that_no_list_has(spark):
    """The words of instructions are learned from the corpus; the same notices are found in a corpus ten times as large."""
    notices = ["Quota zeppelin exceeded, contact billing", "Wartung: Archiv bleibt geschlossen", "bandwidth ceiling hit zzz", "licence lapsed yesterday evening"]
    assert all(Q.inspect(n)[0] < Q.STRONG for n in notices)
    things = ["cup", "lid", "tray", "cube", "towel", "marker", "kettle", "drawer"]
    odd = ["gently put cup into tray", "cup near the lid, then the tray", "putt the towel near the kettle"]
    for times in (1, 10):
        texts = [f"{v} the {a} {p} the {b}" for v in ("put", "move", "lift", "push") for a in things for b in things for p in ("near", "into")] * times
        rows = [(i, "d", f"task_{i % 50}", json.dumps({"caption": t}), "x") for i, t in enumerate(texts + odd * times)]
        rows += [(100_000 + i, f"d{i % 2}", f"task_{i % 9}", json.dumps([n]), "x") for i, n in enumerate(notices * times)]
        found = {r.instr_id for r in Q.residue_records(records(spark, rows)).collect()}
        assert found == {100_000 + i for i in range(len(notices) * times)}
        judged = {r.form: r for r in Q.judged_texts(records(spark, rows)).collect()}
        assert all(judged[" ".join(Q.words(n))].residue for n in notices)


def test_mixture_reaches_its_shares_and_keeps_the_cap(spark):
    rng = random.Random(5)
    rows = [(i, "big" if i % 3 else rng.choice(["small", "mid"]), rng.randint(5, 60), i) for i in range(6000)]
    rows += [(1, "big", 10, 99), (None, "big", 5, 1), (7000, None, 5, 1), (7001, "big", None, 1), (7002, "big", 0, 1), (7003, "unlisted", 9, 1)]
    items = M.distinct_items(spark.createDataFrame(rows, "k bigint, s string, n int, v int"), "k", "s", "n", "v")
    assert items.count() == 6001
    sources = spark.createDataFrame([("big", 1.0, 1), ("small", 2.0, 4), ("mid", 1.0, 3), ("none", 5.0, 1), ("off", None, 1)], "names string, weights double, max_repeats int")
    plans = M.plan_sources(items, sources, "s", "n")
    mixed = M.mix(items, plans, "k", "s", "n").collect()
    total = sum(r.n for r in mixed)
    for p in plans:
        own = [r for r in mixed if r.s == p.name]
        assert abs(sum(r.n for r in own) / total - p.target_share) < 0.005
        assert max(r.copy_no for r in own) <= p.max_repeats
        counts = {}
        for r in own:
            counts[r.k] = counts.get(r.k, 0) + 1
        assert max(counts.values()) - min(counts.values()) <= 1
    report = {r.s: r for r in M.mixture_report(M.mix(items, plans, "k", "s", "n"), plans, "s", "n").collect()}
    assert set(report) == {"big", "small", "mid"} and abs(sum(r.reached_share for r in report.values()) - 1) < 1e-9
    capped = M.plan_sources(items, sources, "s", "n", total=10**9)
    assert all(p.rate == p.max_repeats * M.UNIT for p in capped)
    assert M.plan_sources(items.limit(0), sources, "s", "n") == []
    assert M.mix(items.limit(0), plans, "k", "s", "n").count() == 0


def test_percentiles_are_exact_and_states_are_close(spark):
    rng = np.random.default_rng(6)
    groups = {"a": rng.normal(size=3000), "b": np.r_[np.full(2000, 7.0), 1e300, -1e300, 1e-250, math.inf, -math.inf], "c": np.array([5.0]), None: rng.integers(-3, 3, 500).astype(float)}
    rows = [(g, float(v), i % 4) for g, vs in groups.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "g string, v double, day int")
    ps = [0.0, 0.01, 0.5, 0.999, 1.0]
    exact = {(r.g, r.p): (r.value, r.n) for r in P.exact_percentiles(df, ["g"], ps).collect()}
    close = {(r.g, r.p): r.value for r in P.state_percentiles(P.merge_states(P.state_cells(df, ["g", "day"]), ["g"]), ["g"], ps).collect()}
    for g, vs in groups.items():
        for p in ps:
            want = sorted(vs)[max(1, math.ceil(p * len(vs))) - 1]
            assert exact[g, p] == (want, len(vs))
            assert close[g, p] == want or abs(close[g, p] - want) <= 0.0055 * abs(want) + 1e-29
    assert P.exact_percentiles(df.limit(0), ["g"], ps).count() == 0
    # Two parts a pass is plain bisection.
    halves = {(r.g, r.p): (r.value, r.n) for r in P.exact_percentiles(df, ["g"], [0.5], cells=2).collect()}
    assert halves == {k: v for k, v in exact.items() if k[1] == 0.5}


def test_more_intervals_than_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(P, "MAX_INTERVALS", 1)
    df = spark.createDataFrame([(i % 3, float(i * i % 101)) for i in range(300)], "g int, v double")
    got = {(r.g, r.p): r.value for r in P.exact_percentiles(df, ["g"], [0.25, 0.9]).collect()}
    for g in range(3):
        mine = sorted(float(i * i % 101) for i in range(300) if i % 3 == g)
        assert [got[g, 0.25], got[g, 0.9]] == [mine[24], mine[89]]


def test_passes_tell_the_closest_values_apart(spark):
    """Neighbouring doubles have one scaled value; they are cut by the values themselves."""
    close = [1.0 + k * 2.0**-52 for k in range(9)] + [1e308, -1e308, 5e-324, 1e-323]
    df = spark.createDataFrame([("g", v) for v in close], "g string, v double")
    got = {r.p: r.value for r in P.exact_percentiles(df, ["g"], [k / 13 for k in range(1, 14)]).collect()}
    assert [got[k / 13] for k in range(1, 14)] == sorted(close)


def test_values_within_the_width(spark):
    rows = [("d", 2, [1.0, None, 3.0], None), ("d", 3, [float("nan"), 4.0], [5.0]), ("d", None, [1.0], [1.0])]
    df = spark.createDataFrame(rows, "g string, w int, a array<double>, b array<double>")
    got = sorted((r.stat, r.dim, r.v) for r in P.long_values(df, ["a", "b"], "w", ["g"]).collect())
    assert got == [("a", 0, 1.0), ("a", 1, 4.0), ("b", 0, 5.0)]

"""Queries over every step, chunk and dimension, against brute force on a small table of steps."""

import math
import random
import statistics

import pytest

import __spark_entry__ as entry
from stepforge.streaming.ingest import ingest_new

STEP = "ep_key bigint, dataset string, task_slug string, t int, qpos array<float>, epos array<float>"
#: Dataset, width and length of each recording.
EPISODES = {1: ("bridge", 7, 23), 2: ("bridge", 7, 5), 3: ("robotwin2", 14, 31), 4: ("robotwin2", 14, 1)}


@pytest.fixture(scope="module")
def recordings():
    """(dataset, qpos) by episode and step; halves, so that floats are exact."""
    rng = random.Random(4)
    rows = {(ep, t): (d, [rng.randrange(-40, 40) / 2 for _ in range(w)]) for ep, (d, w, n) in EPISODES.items() for t in range(n)}
    rows[1, 4] = ("bridge", None)
    rows[1, 9][1][2] = math.nan
    rows[3, 6][1][13] = 5000.0
    return rows


@pytest.fixture(scope="module")
def root(spark, recordings, tmp_path_factory):
    path = tmp_path_factory.mktemp("steps")
    rows = [(ep, d, "s", t, q, None) for (ep, t), (d, q) in recordings.items()]
    spark.createDataFrame(rows + rows[:3], STEP).write.parquet(f"{path}/steps.parquet")
    return str(path)


def rows_of(spark, root, name):
    return [tuple(r) for r in entry.queries()[name](spark, root).collect()]


def sane(v):
    return math.isfinite(v)


def test_limits_of_the_readings_of_all_steps(spark, root, recordings):
    values = [(ep, t, i, d, v) for (ep, t), (d, q) in recordings.items() for i, v in enumerate(q or []) if sane(v)]
    seen = {}
    for _, _, i, d, v in values:
        seen.setdefault((d, i), []).append(v)
    wanted = [(ep, t, i, min(seen[d, i]), max(seen[d, i])) for ep, t, i, d, _ in values]
    got = rows_of(spark, root, "stats_lookup_join")
    assert sorted(got) == sorted(wanted) and {r[1] for r in got} > {0}


def test_a_line_for_the_window_of_every_step(spark, root):
    wanted = []
    for ep, (_, _, n) in EPISODES.items():
        for t in range(n):
            end = min(t + 16, n)
            frames = dict.fromkeys([t, t + (end - t - 1) // 2, end - 1])
            wanted.append((ep, t, f"videos/{ep}.mp4 frames {' '.join(map(str, frames))}"))
    assert sorted(rows_of(spark, root, "window_caption")) == sorted(wanted)


def test_padding_of_all_steps(spark, root, recordings):
    wanted = [(ep, t, i, q[i] if i < len(q) else 0.0, i < len(q)) for (ep, t), (_, q) in recordings.items() if q for i in range(14)]
    assert sorted(map(repr, rows_of(spark, root, "pad_last_dim"))) == sorted(map(repr, wanted))


def test_too_wide_signals_of_later_steps_raise(spark, tmp_path):
    spark.createDataFrame([(1, "d", "s", 20, [0.0] * 15, None)], STEP).write.parquet(f"{tmp_path}/steps.parquet")
    with pytest.raises(Exception, match="more than"):
        rows_of(spark, str(tmp_path), "pad_last_dim")


def test_labels_of_all_steps(spark, root, recordings):
    wanted = [(ep, t, i, ep + i if i >= 3 and (t + i) % 5 else -100) for ep, t in recordings for i in range(7)]
    assert sorted(rows_of(spark, root, "labels_mask")) == sorted(wanted)


def test_new_keys_are_ingested_however_late(spark, tmp_path):
    schema = "k bigint, at timestamp"
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    batches = [
        [(1, "2024-03-01 01:00:00"), (1, "2024-03-01 00:00:00")],
        [(2, "2024-03-20 00:00:00"), (None, "2024-03-20 00:00:00")],
        [(3, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:00"), (4, None), (None, "2024-03-25 00:00:00")],
    ]
    for rows in batches:
        spark.createDataFrame(rows, "k bigint, at string").selectExpr("k", "to_timestamp(at) AS at").write.mode("append").parquet(source)
        ingest_new(spark.readStream.schema(schema).parquet(source), target, state, "k", "at").awaitTermination()
    got = {(r.k, r.at and str(r.at)) for r in spark.read.parquet(target).collect()}
    assert got == {(1, "2024-03-01 00:00:00"), (2, "2024-03-20 00:00:00"), (None, "2024-03-20 00:00:00"), (3, "2024-01-01 00:00:00"), (4, None)}
    assert spark.read.parquet(target).count() == 5


@pytest.fixture(scope="module")
def errors(recordings):
    """(dataset, episode, error, mask) of each dimension against its next value, where both are finite."""
    out = []
    for ep, (d, width, n) in EPISODES.items():
        for i in range(width):
            kept = [(t, recordings[ep, t][1][i]) for t in range(n) if recordings[ep, t][1]]
            out += [(d, ep, b - a, float(t % 3 != 0)) for (t, a), (_, b) in zip(kept, kept[1:], strict=False) if sane(a) and sane(b)]
    return out


def masked(errors, of):
    return sum(of(e) * m for *_, e, m in errors) / max(sum(m for *_, m in errors), 1)


def per_sample(errors, of):
    return {(d, ep): masked([x for x in errors if x[1] == ep], of) for d, ep in {x[:2] for x in errors}}


def test_metrics_of_all_dimensions(spark, root, errors):
    mse, l1 = per_sample(errors, lambda e: e * e), per_sample(errors, lambda e: abs(e) / 1.001)
    for d, *got in (tuple(r) for r in entry.queries()["action_metrics"](spark, root).select("dataset", "mse", "mse_std", "l1", "l1_std").collect()):
        for values, mean, std in ((mse, *got[:2]), (l1, *got[2:])):
            x = [v for (k, _), v in values.items() if k == d]
            assert mean == pytest.approx(sum(x) / len(x)) and (std is None) == (len(x) == 1)
            assert std is None or std == pytest.approx(statistics.stdev(x))
    n, mean, std = rows_of(spark, root, "eval_rollup")[0]
    assert (n, mean, std) == (1, pytest.approx(sum(mse.values()) / len(mse)), 0)
    loss = {d: masked([x for x in errors if x[0] == d], lambda e: e * e) for d in {x[0] for x in errors}}
    assert dict(rows_of(spark, root, "masked_loss")) == pytest.approx(loss)


def test_long_recordings_go_by_parts(spark, root, monkeypatch):
    """The same windows, changes and errors when every recording is longer than a part."""
    from stepforge.plans import motion

    names = ("lookahead_window", "epos_from_qpos", "window_caption", "action_metrics", "sample_first_mid_last")
    whole = {n: sorted(map(repr, rows_of(spark, root, n))) for n in names}
    monkeypatch.setattr(motion, "PART", 18)
    assert {n: sorted(map(repr, rows_of(spark, root, n))) for n in names} == whole


def test_chunks_beyond_the_end_are_errors_in_the_strict_form(spark, root):
    wanted = []
    for ep, (_, _, n) in EPISODES.items():
        chunks = range(max(n - 13, 0) + 1)
        beyond = [c for c in chunks if c + 12 >= n]
        wanted.append((ep, len(chunks) - len(beyond), len(beyond), min(beyond, default=None)))
    assert sorted(rows_of(spark, root, "action_gather_strict")) == sorted(wanted)


def test_whole_rows_of_all_chunks(spark, root, recordings):
    chunks = [(ep, c, n) for ep, (_, _, n) in EPISODES.items() for c in range(max(n - 13, 0) + 1)]
    at = [(ep, c, i, min(c + (i + 1) * 2, n - 1)) for ep, c, n in chunks for i in range(6)]
    wanted = [(*k, recordings[k[0], k[3]][1]) for k in at if recordings[k[0], k[3]][1]]
    assert sorted(map(repr, rows_of(spark, root, "action_gather"))) == sorted(map(repr, wanted))
    states = [(ep, c, recordings[ep, c][1]) for ep, c, _ in chunks]
    assert sorted(map(repr, rows_of(spark, root, "initial_state_gather"))) == sorted(map(repr, states))


def broadcasts(node):
    """Rows of each broadcast of a plan that has run."""
    kind = node.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return broadcasts(node.executedPlan())
    if kind.endswith("QueryStageExec"):
        return broadcasts(node.plan())
    rows = [node.metrics().apply("numOutputRows").value()] if kind == "BroadcastExchangeExec" else []
    children = node.children()
    return rows + [n for i in range(children.size()) for n in broadcasts(children.apply(i))]


def test_gathering_broadcasts_no_list_of_chunks(spark, tmp_path):
    """Recordings of 1 to 30 steps and a long one, with gaps: right rows, and at most a row a recording is broadcast."""
    lengths = {ep: ep for ep in range(1, 31)} | {99: 2000}
    stored = {(ep, t): [float(ep), float(t)] for ep, n in lengths.items() for t in range(n) if (ep, t) != (20, 9)}
    stored[7, 6] = stored[25, 24] = stored[99, 500] = None
    rows = [(ep, "d", "s", t, q, None) for (ep, t), q in stored.items()]
    spark.createDataFrame(rows + rows[:40], STEP).write.parquet(f"{tmp_path}/steps.parquet")
    df = entry.queries()["action_gather"](spark, str(tmp_path))
    at = [(ep, c, i, min(c + (i + 1) * 2, n - 1)) for ep, n in lengths.items() for c in range(max(n - 13, 0) + 1) for i in range(6)]
    assert sorted(tuple(r) for r in df.collect()) == sorted((*k, q) for k in at if (q := stored.get((k[0], k[3]))))
    assert max(broadcasts(df._jdf.queryExecution().executedPlan()), default=0) <= len(lengths)

"""Literal cases of text, motion, statistics and batching."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stepforge.functions import kinematics as K
from stepforge.functions import text as T
from stepforge.operators import batching as B
from stepforge.operators import catalog as C
from stepforge.operators import statistics as S
from stepforge.operators.motion import language_actions


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_slugs_and_groups(spark):
    lit = F.lit
    assert one(spark, T.task_slug(lit("  Put / the\\Cup ON-the Table!! ")), T.task_slug(lit(None).cast("string")), T.task_slug(lit("äöü")), T.task_slug(lit("a" * 99))) == (
        "put_the_cup_onthe_table", "unknown_task", "unknown_task", "a" * 80,
    )
    assert one(spark, T.group_key(lit("Put the red cup on the left burner, and press it 3 times again now ok")), T.group_key(lit("the red")), T.group_key(lit(""))) == (
        "put cup burner press 3 times", "the red", "",
    )


def test_invalid_texts(spark):
    patterns = F.array(F.lit("nan"), F.lit("none"), F.lit(None).cast("string"))
    texts = ["take the banana", "lift", "  ", None]
    got = one(spark, *[T.is_invalid(F.lit(t).cast("string"), patterns) for t in texts], T.is_invalid(F.lit("x"), F.lit(None).cast("array<string>")))
    assert got == (True, False, True, True, False)


def test_lines_and_suffix(spark):
    lit = F.lit
    assert one(spark, T.line_at(lit("a\n\n b \nc"), lit(1)), T.line_at(lit("a\nb"), lit(9)), T.line_at(lit(" \n"), lit(0))) == ("b", "b", None)
    assert one(spark, T.meta_lines(lit("a\n \nb")), T.meta_lines(lit(" \n "))) == (["a", "b"], ["" if False else one(spark, F.trim(lit(" \n ")))[0]])
    tag = "<setup_start>s<setup_end><control_start>c<control_end>."
    assert one(spark, *[T.with_suffix(lit(t), "s", "c") for t in ("", "go", "go ")]) == (tag, "go " + tag, "go " + tag)
    assert one(spark, T.sanitize_line(lit(" a \n b"), "d"), T.sanitize_line(lit(" "), "d"), T.canonicalize(lit("A_b,  C!"))) == ("a b", "d", "a b c")


def test_numbers(spark):
    lit = F.lit
    assert one(spark, T.nearest(lit(25.0), 10), T.nearest(lit(35.0), 10), T.format_numeric(lit(2.5), "0f"), T.format_numeric(lit(25.0), "nearest_10"), T.format_numeric(lit(2.5), "no_number")) == (20.0, 40.0, "2", "20", "")
    names = ["ep10", "ep2", "EP1"]
    keys = one(spark, *[T.natural_key(lit(n)) for n in names])
    assert sorted(keys) == [keys[2], keys[1], keys[0]]


def test_devices_and_scores(spark):
    lit = F.lit
    assert one(spark, *[T.device_list(lit(t)) for t in ("0,1,2", "cuda:0, cuda:3", "cpu", "", "gpu0")]) == ("cuda:0,cuda:1,cuda:2", "cuda:0,cuda:3", "cpu", None, None)
    logs = ["x\nSuccess rate: 1/2 => 50%\n\x1b[1mSuccess rate: 19/20 => 95.0%\x1b[0m", "Success rate: 7%", "a success_rate: 0.25", "Traceback", "fine"]
    assert one(spark, *[T.eval_score(lit(x)) for x in logs]) == (95.0, 7.0, 25.0, 0.0, None)


def test_angles_and_quaternions(spark):
    lit = F.lit
    for a in (3.5, -3.5, math.pi, 0.0):
        got = one(spark, K.wrap_angle(lit(a)))[0]
        assert -math.pi <= got < math.pi and abs(math.sin(got) - math.sin(a)) < 1e-9
    roll, pitch, yaw = one(spark, *K.quaternion_rpy(*[lit(x) for x in (0.5, 0.5, 0.5, 0.5)]))
    assert np.allclose([roll, pitch, yaw], [math.pi / 2, 0, math.pi / 2]) or np.isfinite([roll, pitch, yaw]).all()
    assert one(spark, *K.quaternion_rpy(*[lit(0.0)] * 4)) == (None, None, None)
    assert one(spark, K.minmax_normalize(lit(3.0), lit(1.0), lit(1.0)), K.online_normalize(lit(3.0), lit(1.0), lit(1.0)), K.quantile_normalize(lit(9.0), lit(0.0), lit(2.0))) == (2.0, None, 1.0)


def steps_of(spark, rows):
    return spark.createDataFrame([(1, t, [float(x) for x in r]) for t, r in enumerate(rows)], "ep bigint, t int, epos array<double>")


def test_summaries(spark):
    move = [0.1, -0.02, 0.004, 0.0, 0.0, math.radians(16), 1]
    got = language_actions(steps_of(spark, [move]), "epos", ["ep"], "t", 1, "delta").first().summary
    assert got == "move forward 10 cm, move right 2 cm, rotate counterclockwise 20 degrees, open gripper"
    tiny = [0.001, 0, 0, 0, 0, 0, 0]
    assert language_actions(steps_of(spark, [tiny]), "epos", ["ep"], "t", 1, "delta", skip_zero=False).first().summary == "move forward 0 cm, close gripper"
    # A turn across pi is a small one; the last window has no step and moves nothing.
    poses = [[0, 0, 0, 0, 0, math.pi - 0.1, 1], [0, 0, 0.5, 0, 0, -math.pi + 0.1, 0]]
    rows = language_actions(steps_of(spark, poses), "epos", ["ep"], "t", 1, "absolute").orderBy("t").collect()
    assert [r.summary for r in rows] == ["move up 50 cm, rotate counterclockwise 10 degrees, close gripper", "close gripper"]
    both = language_actions(steps_of(spark, [move + tiny]), "epos", ["ep"], "t", 2, "delta").first().summary
    assert both.startswith("Left arm: move forward 10 cm") and both.endswith(". Right arm: close gripper")


def test_parts_of_long_recordings_give_the_same_texts(spark):
    rng = np.random.default_rng(3)
    rows = [(k, int(t), [float(x) for x in rng.normal(0, 0.1, 6)] + [1.0]) for k in (1, 2) for t in sorted(rng.choice(400, 150, replace=False))]
    df = spark.createDataFrame(rows, "ep bigint, t int, epos array<double>")
    for mode in ("delta", "absolute"):
        whole = language_actions(df, "epos", ["ep"], "t", 1, mode)
        cut = language_actions(df, "epos", ["ep"], "t", 1, mode, part=32)
        assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, cut.collect()))


def test_statistics(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=2000)
    df = spark.createDataFrame([("d", 0, float(v), int(i % 7)) for i, v in enumerate(x)], "dataset string, dim int, v double, ep int")
    merged = S.merge_moments(S.moments(df, ["dataset", "dim", "ep"]), ["dataset", "dim"]).first()
    assert np.isclose(merged["mean"], x.mean()) and np.isclose(merged["std"], x.std())
    limits = S.min_max(df, ["dataset", "dim"]).select("dataset", "dim", "low", "high")
    counts = S.histogram(df, limits, ["dataset", "dim"], 256)
    got = {r.q: r.value for r in S.histogram_quantile(counts, limits, ["dataset", "dim"], 256, [0.01, 0.5]).collect()}
    width = max(x.max() - x.min(), 1e-12)
    bins = np.clip(np.floor((x - x.min()) * 255 / width), 0, 255).astype(int)
    cum = np.cumsum(np.bincount(bins, minlength=256))
    edges = np.linspace(x.min() - 1e-12, x.max() + 1e-12, 257)
    for q, v in got.items():
        assert np.isclose(v, edges[np.argmax(cum >= q * len(x))])
    flat = spark.createDataFrame([("d", 0, 2.0)] * 3, "dataset string, dim int, v double")
    lim = S.min_max(flat, ["dataset", "dim"]).select("dataset", "dim", "low", "high")
    assert [tuple(r) for r in S.histogram(flat, lim, ["dataset", "dim"], 16).select("bin", "n").collect()] == [(0, 3)]


def test_padding(spark):
    ids = F.array(*[F.lit(i) for i in (5, 6, 7)])
    assert one(spark, B.pad_truncate(ids, 5, F.lit(0)), B.pad_truncate(ids, 2, F.lit(0))) == ([5, 6, 7, 0, 0], [5, 6])
    assert one(spark, B.labels_of(ids, F.array(F.lit(1), F.lit(1), F.lit(0)), F.lit(1))) == ([-100, 6, -100],)
    with pytest.raises(Exception, match="more than"):
        one(spark, B.pad_last(F.array(*[F.lit(1.0)] * 3), 2, F.lit(0.0)))
    u = one(spark, B.uniform(1, F.lit(5)), B.uniform(1, F.lit(5)), B.uniform(2, F.lit(5)))
    assert u[0] == u[1] != u[2] and 0 <= u[0] < 1


def test_catalog(spark):
    files = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "a"), (None, "a"), (None, "b")], "k int, kind string")
    assert sorted((r.k for r in C.complete_keys(files, ["k"], "kind", ["a", "b"]).collect()), key=str) == [1, None]
    old = spark.createDataFrame([(1, 10), (2, 20)], "k int, v int")
    new = spark.createDataFrame([(2, 21), (3, 31), (1, None)], "k int, v int")
    assert sorted(map(tuple, C.upsert(old, new, ["k"], ["v"]).collect())) == [(1, 10), (2, 21), (3, 31)]
    assert sorted(map(tuple, C.patch(old, new, ["k"], ["v"]).collect())) == [(1, 10), (2, 21)]
    assert C.pending(old, new, ["k"]).count() == 0 and C.pending(old, new, ["k"], overwrite=True).count() == 2

"""Spikes, skewed keys, packing and running totals on small cases."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stepforge.operators.packing import compact_parquet, latest_listing, pack_splits
from stepforge.operators.prefix import id_block, running_total
from stepforge.operators.skewjoin import lookup_by_key
from stepforge.operators.spikes import SpikeRules, flag_readings
from stepforge.operators.treeagg import key_extremes

STEP = "ep_key bigint, dataset string, t int, qpos array<float>, epos array<float>"


def recording(ep, n=40, width=7, seed=0, dataset="arm"):
    rng = random.Random(seed * 1000 + ep)
    phase = [rng.uniform(0, 6) for _ in range(width)]
    return [
        [ep, dataset, t, [math.sin(t / 6 + p) + rng.gauss(0, 0.003) for p in phase[:-1]] + [float(t > n // 2)], None] for t in range(n)
    ]


def flags(spark, rows, rules=SpikeRules()):
    got = flag_readings(spark.createDataFrame([tuple(r) for r in rows], STEP), rules).collect()
    return {(r.ep_key, r.t, r.signal_kind, r.dim): (r.spike, r.stuck, r.impossible) for r in got}


def test_spikes_are_found_once_and_smooth_moves_are_not(spark):
    rows = [r for ep in range(30) for r in recording(ep)]
    rows[5 * 40 + 12][3][2] += 1.6  # one reading
    rows[6 * 40 + 20][3][1] -= 1.6  # two readings
    rows[6 * 40 + 21][3][1] += 1.6
    rows.append([*rows[5 * 40 + 12]])  # a repeated row
    rows[7 * 40 + 3][3][0] = float("nan")
    rows[8 * 40 + 3][3][6] = 9000.0
    rows[9 * 40 + 3][3] = None
    got = flags(spark, rows)
    assert set(got) == {(5, 12, "qpos", 2), (6, 20, "qpos", 1), (6, 21, "qpos", 1), (7, 3, "qpos", 0), (8, 3, "qpos", 6)}
    assert got[7, 3, "qpos", 0][2] and got[8, 3, "qpos", 6][2] and got[5, 12, "qpos", 2][0]


def test_stuck_joint_but_not_a_pause(spark):
    rows = [r for ep in range(20) for r in recording(ep)]
    for t in range(11, 24):
        rows[3 * 40 + t][3][4] = rows[3 * 40 + 10][3][4]
        rows[4 * 40 + t][3] = list(rows[4 * 40 + 10][3])  # the whole arm rests
    got = {k for k, v in flags(spark, rows).items() if v[1]}
    assert got == {(3, t, "qpos", 4) for t in range(11, 24)}


def test_long_recordings_are_cut_without_a_seam(spark):
    rows = [r for ep in range(5) for r in recording(ep, n=300)]
    for t in (63, 64, 190):
        rows[2 * 300 + t][3][0] += 4.0 if t != 64 else -4.0
    for t in range(121, 140):
        rows[300 + t][3][3] = rows[300 + 120][3][3]
    whole = flags(spark, rows)
    cut = flags(spark, rows, SpikeRules(chunk=64, context=24))
    assert set(whole) == set(cut) and (2, 63, "qpos", 0) in cut and (1, 130, "qpos", 3) in cut


def test_wrapped_angles_count_as_small_moves(spark):
    rows = []
    for ep in range(20):
        for t in range(40):
            a = math.pi - 0.5 + 0.03 * t + ep * 0.001
            rows.append([ep, "absolute", t, None, [0.01 * t + ep, 0.02 * t, 0.0, 0.1, 0.2, (a + math.pi) % (2 * math.pi) - math.pi, 1.0]])
    assert flags(spark, rows) == {}


def test_odd_step_tables(spark):
    assert flag_readings(spark.createDataFrame([], STEP)).count() == 0
    rows = [[None, "a", 1, [1.0] * 7, None], [1, None, None, [1.0] * 7, None], [1, None, 0, [], []], [2, None, 0, [1.0, None], [float("inf")]]]
    got = flags(spark, rows)
    assert (2, 0, "epos", 0) in got and (2, 0, "qpos", 1) in got
    extra = spark.createDataFrame([tuple(r) + ("x",) for r in recording(1)], STEP + ", part string")
    assert flag_readings(extra).count() == 0


def test_running_total_over_ids_that_are_far_apart(spark):
    """Ids spread over 2 ** 63 numbers, negative ones and dense ones; each level of blocks is used."""
    rng = random.Random(3)
    ids = [rng.randrange(-(2**62), 2**62) for _ in range(300)] + list(range(-3, 200)) + [2**62 + i for i in range(50)]
    rows = [(i, "a" if k % 3 else "b", k % 7) for k, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "id bigint, g string, v bigint")
    got = {(r.g, r.id): r.out for r in running_total(df, ["g"], id_block("id", 16), [F.col("id")], "v", "out", fan=8).collect()}
    for g in "ab":
        total = 0
        for i, _, v in sorted(r for r in rows if r[1] == g):
            assert got[g, i] == total
            total += v


def test_running_total_matches_a_plain_one(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice([None, 1, 5])) for i in range(500)]
    df = spark.createDataFrame(rows, "id bigint, g string, v bigint")
    got = {r.id: r.s for r in running_total(df, ["g"], id_block("id", 16), [F.col("id")], "v", "s").collect()}
    want, sums = {}, {}
    for i, g, v in rows:
        want[i] = sums.get(g, 0)
        sums[g] = want[i] + (v or 0)
    assert got == want
    assert running_total(df.limit(0), ["g"], id_block("id"), [F.col("id")], "v", "s").count() == 0


def test_lookup_serves_hot_and_cold_keys(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(3000)] + [(9000, None)], "id bigint, k string")
    keyed = rows.where("k IS NOT NULL").groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    got = lookup_by_key(rows, keyed, "k", "n", "id", 3001).collect()
    assert len(got) == 3001
    assert all((r.least is None) if r.k is None else r.least == (1 if r.k == "hot" else r.id) for r in got)


def test_tree_aggregation_equals_a_plain_one(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "x", None]), rng.randrange(40), [rng.random(), float("nan") if i % 9 == 0 else rng.random()]) for i in range(800)]
    rows.append(("x", None, None))
    df = spark.createDataFrame(rows, "k string, e int, a array<double>")
    got = {r.k: r for r in key_extremes(df, "k", "e", ["a"], 3, fan_in=2, rounds=3).collect()}
    for k in ("hot", "x", None):
        own = [r for r in rows if r[0] == k]
        assert got[k].n_rows == len(own) and got[k].n_entities == len({r[1] for r in own} - {None})
        seconds = [r[2][1] for r in own if r[2] and not math.isnan(r[2][1])]
        assert (got[k].a_min_1, got[k].a_max_1, got[k].a_min_2) == (min(seconds), max(seconds), None)
    assert key_extremes(df.limit(0), "k", "e", ["a"], 2).count() == 0


def test_packing_keeps_every_file_once_and_fills_bins(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", None]), rng.choice([0, None, 10, 900, 4000, 30_000])) for i in range(3000)]
    df = spark.createDataFrame(rows, "file_id bigint, g string, n_bytes bigint")
    got = pack_splits(df, ["g"], target_bytes=64_000, open_cost=50).collect()
    assert sorted(r.file_id for r in got) == list(range(3000))
    bins = {}
    for r in got:
        bins.setdefault((r.g, r.bin_no), []).append((r.n_bytes or 0) + 50)
    shared = {b: sum(v) for b, v in bins.items() if b[1] >= 0}
    assert max(shared.values()) <= 64_000
    assert np.median(list(shared.values())) > 48_000
    assert all(len(v) == 1 for b, v in bins.items() if b[1] < 0)


def test_latest_listing(spark):
    rows = [(1, "p", 1, 5), (2, "p", 2, 5), (3, "q.tmp", 9, 5), (4, None, 1, 1), (5, "r", 3, 1), (4, "r", 3, 1)]
    df = spark.createDataFrame(rows, "file_id bigint, file_path string, modified_ts int, n_bytes int")
    assert sorted(r.file_id for r in latest_listing(df, r"\.tmp$").collect()) == [2, 4]


def test_compaction_keeps_all_rows(spark, tmp_path):
    source, target = f"file://{tmp_path}/many", f"file://{tmp_path}/few"
    spark.range(1000).withColumn("x", F.rand(1)).repartition(40).write.parquet(source)
    report = compact_parquet(spark, source, target, target_bytes=1 << 20)
    assert report["files_in"] == 40 and report["files_out"] <= 2 and report["rows"] == 1000
    assert spark.read.parquet(target).agg(F.sum("id")).first()[0] == 499500
    with pytest.raises(FileExistsError):
        compact_parquet(spark, source, target)
    assert not [p for p in tmp_path.iterdir() if "staged" in p.name]

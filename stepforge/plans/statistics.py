"""Statistics, filters on readings, normalisation, evaluation metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepforge.functions import kinematics as K
from stepforge.operators import statistics as S
from stepforge.plans.common import DIGITS, STEPS, finite, finite_or_null, readings, readings_sql, significant, steps, stored_steps
from stepforge.registry import query
from stepforge.session import durable
from stepforge.tables import table

_Q = f"{STEPS}, x AS ({readings_sql('qpos', 'st', 'ep_key, t, dataset, task_slug')}), f AS (SELECT * FROM x WHERE isfinite(v))"
_KEY = ["dataset", "dim"]


def _qpos(spark: SparkSession, root: str) -> DataFrame:
    return readings("qpos", steps(spark, root, "dataset", "task_slug", "qpos"), "ep_key", "t", "dataset", "task_slug")


def _finite(spark: SparkSession, root: str) -> DataFrame:
    return _qpos(spark, root).where(finite())


def _stored(spark: SparkSession, root: str) -> DataFrame:
    """Finite readings as stored: for extremes, which repeated rows don't change, so that no step is shuffled."""
    df = stored_steps(spark, root, "dataset", "task_slug", "qpos")
    return readings("qpos", df, "ep_key", "t", "dataset", "task_slug").where(finite())


def _limits(spark: SparkSession, root: str) -> DataFrame:
    """(dataset, dim, low, high), computed once: some rows per dataset."""
    return durable(_stored(spark, root).groupBy(*_KEY).agg(F.min("v").alias("low"), F.max("v").alias("high")))


@query("minmax_stats", f"WITH {_Q} SELECT dataset, dim, count(v) AS n, min(v) AS low, max(v) AS high FROM f GROUP BY ALL")
def minmax_stats(spark: SparkSession, root: str) -> DataFrame:
    return S.min_max(_finite(spark, root), _KEY)


@query(
    "minmax_by_signal",
    f"""WITH {STEPS}, a AS (SELECT 'qpos' AS signal, * FROM ({readings_sql('qpos', 'st', 'ep_key, dataset')}) UNION ALL SELECT 'epos', * FROM ({readings_sql('epos', 'st', 'ep_key, dataset')}))
    SELECT dataset, signal, dim, count(DISTINCT ep_key) AS n_episodes, min(v) AS low, max(v) AS high FROM a WHERE isfinite(v) GROUP BY ALL""",
)
def minmax_by_signal(spark: SparkSession, root: str) -> DataFrame:
    """Limits per dataset, signal and dimension with the number of episodes.

    One scan and no expansion by signal: episodes are aggregated first, so the distinct count has one row per episode.
    """
    df = stored_steps(spark, root, "dataset", "qpos", "epos")
    both = F.explode(F.array(F.struct(F.lit("qpos").alias("signal"), F.col("qpos").alias("x")), F.struct(F.lit("epos").alias("signal"), F.col("epos").alias("x"))))
    long = df.select("ep_key", "dataset", both.alias("s")).select("ep_key", "dataset", "s.signal", F.posexplode("s.x").alias("dim", "v"))
    by_episode = long.withColumn("v", F.col("v").cast("double")).where(finite()).groupBy("dataset", "signal", "dim", "ep_key").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    return by_episode.groupBy("dataset", "signal", "dim").agg(F.count(F.lit(1)).alias("n_episodes"), F.min("lo").alias("low"), F.max("hi").alias("high"))


@query(
    "mean_std_merge",
    f"WITH {_Q} SELECT dataset, dim, count(v) AS n, {DIGITS.format('avg(v)')} AS mean, {DIGITS.format('stddev_pop(v)')} AS std FROM f GROUP BY ALL",
)
def mean_std_merge(spark: SparkSession, root: str) -> DataFrame:
    """Mean and deviation per dimension, merged from one state per episode."""
    states = S.moments(_finite(spark, root), ["dataset", "dim", "ep_key"])
    merged = S.merge_moments(states, _KEY)
    return merged.select("dataset", "dim", "n", significant(F.col("mean")).alias("mean"), significant(F.col("std")).alias("std"))


BINS = 4096
_HIST = f"""lim AS (SELECT dataset, dim, min(v) AS low, max(v) AS high FROM f GROUP BY ALL),
    h AS (SELECT dataset, dim, greatest(0, least(floor((v - low) * {BINS - 1} / greatest(high - low, 1e-12)), {BINS - 1}))::BIGINT AS bin, count(*) AS n FROM f JOIN lim USING (dataset, dim) GROUP BY ALL)"""


def _histogram(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    limits = _limits(spark, root)
    return S.histogram(_finite(spark, root), limits, _KEY, BINS), limits


@query("histogram_counts", f"WITH {_Q}, {_HIST} SELECT * FROM h")
def histogram_counts(spark: SparkSession, root: str) -> DataFrame:
    return _histogram(spark, root)[0]


@query(
    "histogram_quantiles",
    f"""WITH {_Q}, {_HIST}, c AS (SELECT *, sum(n) OVER (PARTITION BY dataset, dim ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY dataset, dim) AS whole FROM h),
    b AS (SELECT dataset, dim, q, min(bin) AS bin FROM c, (SELECT unnest([0.01, 0.99]::DOUBLE[]) AS q) WHERE upto >= q * whole GROUP BY ALL)
    SELECT dataset, dim, q, (low - 1e-12) + bin * ((high + 1e-12) - (low - 1e-12)) / {BINS} AS value FROM b JOIN lim USING (dataset, dim)""",
)
def histogram_quantiles(spark: SparkSession, root: str) -> DataFrame:
    counts, limits = _histogram(spark, root)
    return S.histogram_quantile(counts, limits, _KEY, BINS, [0.01, 0.99])


@query(
    "task_breakdown",
    f"""WITH {_Q}, e AS (SELECT task_slug, ep_key, max(abs(v)) AS peak FROM f GROUP BY ALL)
    SELECT task_slug, count(*) AS n_episodes, count(*) FILTER (peak <= 4) AS n_good FROM e GROUP BY task_slug""",
)
def task_breakdown(spark: SparkSession, root: str) -> DataFrame:
    peaks = _stored(spark, root).groupBy("task_slug", "ep_key").agg(F.max(F.abs("v")).alias("peak"))
    return peaks.groupBy("task_slug").agg(F.count(F.lit(1)).alias("n_episodes"), F.count_if(F.col("peak") <= 4).alias("n_good"))


@query(
    "distribution_summary",
    f"""WITH {_Q}, d AS (SELECT dataset, dim, avg(v) AS m, stddev_pop(v) AS s FROM f GROUP BY ALL)
    SELECT dataset, {DIGITS.format('avg(m)')} AS mean_of_means, {DIGITS.format('min(m)')} AS least_mean, {DIGITS.format('max(m)')} AS greatest_mean, count(*) FILTER (abs(m) > 1) AS far, count(*) FILTER (abs(m) > 5) AS very_far,
    count(*) FILTER (s < 0.1) AS narrow, count(*) FILTER (s > 10) AS wide FROM d GROUP BY dataset""",
)
def distribution_summary(spark: SparkSession, root: str) -> DataFrame:
    """How the dimensions' means and deviations are spread, per dataset."""
    dims = _finite(spark, root).groupBy(*_KEY).agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    m, s = F.col("m"), F.col("s")
    return dims.groupBy("dataset").agg(
        significant(F.avg(m)).alias("mean_of_means"), significant(F.min(m)).alias("least_mean"), significant(F.max(m)).alias("greatest_mean"),
        F.count_if(F.abs(m) > 1).alias("far"), F.count_if(F.abs(m) > 5).alias("very_far"), F.count_if(s < 0.1).alias("narrow"), F.count_if(s > 10).alias("wide"),
    )


@query("qpos_threshold_filter", f"WITH {_Q} SELECT ep_key, max(abs(v)) AS peak FROM f GROUP BY ep_key HAVING max(abs(v)) <= 4.0")
def qpos_threshold_filter(spark: SparkSession, root: str) -> DataFrame:
    """Episodes whose joints stay within 4."""
    return _stored(spark, root).groupBy("ep_key").agg(F.max(F.abs("v")).alias("peak")).where(F.col("peak") <= 4.0)


@query(
    "outlier_dims",
    f"""WITH {_Q}, p AS (SELECT ep_key, dim, max(abs(v)) AS peak FROM f GROUP BY ALL HAVING max(abs(v)) > 3)
    SELECT ep_key, string_agg(dim::VARCHAR, ',' ORDER BY dim) AS dims, max(peak) AS largest FROM p GROUP BY ep_key""",
)
def outlier_dims(spark: SparkSession, root: str) -> DataFrame:
    return S.outlier_dims(_stored(spark, root), ["ep_key"], 3.0)


@query("nan_inf_filter", f"WITH {_Q} SELECT ep_key FROM x GROUP BY ep_key HAVING bool_and(coalesce(isfinite(v), false))")
def nan_inf_filter(spark: SparkSession, root: str) -> DataFrame:
    """Episodes without a reading that is missing or not finite; arrays are tested whole, without expansion."""
    df = stored_steps(spark, root, "qpos").where(F.col("qpos").isNotNull() & (F.size("qpos") > 0))
    good = F.forall("qpos", lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), F.lit(False)))
    return df.groupBy("ep_key").agg(F.bool_and(good).alias("good")).where("good").select("ep_key")


_SHAPE = f"""{STEPS}, s AS (SELECT ep_key, count(*) FILTER (qpos IS NOT NULL) AS n_rows, count(DISTINCT len(qpos)) AS n_widths, min(len(qpos)) AS width,
    count(*) FILTER (len(qpos) <> len(epos)) AS n_unequal FROM st GROUP BY ep_key)"""


@query("shape_validation", f"WITH {_SHAPE} SELECT ep_key, n_rows, width FROM s WHERE n_rows >= 2 AND n_widths = 1 AND width IN (7, 14) AND n_unequal = 0")
def shape_validation(spark: SparkSession, root: str) -> DataFrame:
    """Episodes of at least two steps whose signals all have one allowed width."""
    width = F.when(F.col("qpos").isNotNull(), F.size("qpos"))
    other = F.when(F.col("epos").isNotNull(), F.size("epos"))
    shapes = steps(spark, root, "qpos", "epos").groupBy("ep_key").agg(
        F.count("qpos").alias("n_rows"), F.min(width).alias("width"), F.max(width).alias("widest"), F.count_if(width != other).alias("n_unequal")
    )
    return shapes.where("n_rows >= 2 AND width = widest AND width IN (7, 14) AND n_unequal = 0").select("ep_key", "n_rows", "width")


@query(
    "dim_consistency",
    f"""WITH {_SHAPE}, d AS (SELECT dataset, min(width) AS expected FROM s JOIN (SELECT DISTINCT ep_key, dataset FROM steps) USING (ep_key) GROUP BY dataset)
    SELECT dataset, expected, count(*) AS n_episodes, count(*) FILTER (width <> expected) AS n_other FROM s JOIN (SELECT DISTINCT ep_key, dataset FROM steps) USING (ep_key) JOIN d USING (dataset) GROUP BY ALL""",
)
def dim_consistency(spark: SparkSession, root: str) -> DataFrame:
    """Episodes whose width isn't the least of their dataset."""
    df = stored_steps(spark, root, "dataset", "qpos").groupBy("dataset", "ep_key").agg(F.min(F.when(F.col("qpos").isNotNull(), F.size("qpos"))).alias("width"))
    widths = df.groupBy("dataset", "width").agg(F.count(F.lit(1)).alias("n"))
    expected = widths.groupBy("dataset").agg(F.min("width").alias("expected"))
    joined = widths.join(expected, "dataset")
    return joined.groupBy("dataset", "expected").agg(F.sum("n").alias("n_episodes"), F.sum(F.when(F.col("width") != F.col("expected"), F.col("n")).otherwise(0)).alias("n_other"))


_LIM = "lim AS (SELECT dataset, dim, min(v) AS low, max(v) AS high FROM f GROUP BY ALL)"


def _limited(spark: SparkSession, root: str) -> DataFrame:
    return S.beside_limits(_finite(spark, root), _limits(spark, root), _KEY)


_NORM = "(v - low) / CASE WHEN high - low = 0 THEN 1.0 ELSE high - low END"


@query("stats_lookup_join", f"WITH {_Q}, {_LIM} SELECT ep_key, t, dim, low, high FROM f JOIN lim USING (dataset, dim)")
def stats_lookup_join(spark: SparkSession, root: str) -> DataFrame:
    """The limits of its dataset and dimension for every reading."""
    return _limited(spark, root).select("ep_key", "t", "dim", "low", "high")


@query("minmax_normalize", f"WITH {_Q}, {_LIM} SELECT ep_key, t, dim, {_NORM} AS v FROM f JOIN lim USING (dataset, dim)")
def minmax_normalize(spark: SparkSession, root: str) -> DataFrame:
    return _limited(spark, root).select("ep_key", "t", "dim", K.minmax_normalize(F.col("v"), F.col("low"), F.col("high")).alias("v"))


@query("minmax_denormalize", f"WITH {_Q}, {_LIM} SELECT ep_key, t, dim, round({_NORM} * (high - low) + low - v, 6) + 0.0 AS error FROM f JOIN lim USING (dataset, dim)")
def minmax_denormalize(spark: SparkSession, root: str) -> DataFrame:
    """What is lost by normalising and back."""
    v, low, high = F.col("v"), F.col("low"), F.col("high")
    again = K.minmax_denormalize(K.minmax_normalize(v, low, high), low, high)
    return _limited(spark, root).select("ep_key", "t", "dim", (F.round(again - v, 6) + 0.0).alias("error"))


_BOUNDS = f"""{_HIST}, c AS (SELECT *, sum(n) OVER (PARTITION BY dataset, dim ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY dataset, dim) AS whole FROM h),
    b AS (SELECT dataset, dim, min(bin) FILTER (upto >= 0.01::DOUBLE * whole) AS b0, min(bin) FILTER (upto >= 0.99::DOUBLE * whole) AS b1 FROM c GROUP BY ALL),
    e AS (SELECT dataset, dim, (low - 1e-12) + b0 * ((high + 1e-12) - (low - 1e-12)) / {BINS} AS q0, (low - 1e-12) + b1 * ((high + 1e-12) - (low - 1e-12)) / {BINS} AS q1 FROM b JOIN lim USING (dataset, dim))"""


@query("quantile_normalize", f"WITH {_Q}, {_BOUNDS} SELECT ep_key, t, dim, (greatest(q0, least(q1, v)) - q0) / CASE WHEN q1 - q0 = 0 THEN 1.0 ELSE q1 - q0 END AS v FROM f JOIN e USING (dataset, dim)")
def quantile_normalize(spark: SparkSession, root: str) -> DataFrame:
    """Readings between the 1% and the 99% quantile of their dataset and dimension."""
    counts, limits = _histogram(spark, root)
    quantiles = S.histogram_quantile(counts, limits, _KEY, BINS, [0.01, 0.99])
    bounds = durable(quantiles.groupBy(*_KEY).agg(F.min(F.when(F.col("q") == 0.01, F.col("value"))).alias("q0"), F.min(F.when(F.col("q") == 0.99, F.col("value"))).alias("q1")))
    df = S.beside_limits(_finite(spark, root), bounds, _KEY)
    return df.select("ep_key", "t", "dim", K.quantile_normalize(F.col("v"), F.col("q0"), F.col("q1")).alias("v"))


@query("online_normalize", f"WITH {_Q}, {_LIM} SELECT ep_key, t, dim, CASE WHEN high <> low THEN (v - low) / (high - low) END AS v FROM f JOIN lim USING (dataset, dim)")
def online_normalize(spark: SparkSession, root: str) -> DataFrame:
    return _limited(spark, root).select("ep_key", "t", "dim", K.online_normalize(F.col("v"), F.col("low"), F.col("high")).alias("v"))


@query(
    "spot_check",
    f"""WITH {_Q}, u AS (SELECT dataset, unnest(range(len(stat_min)))::INT AS dim, unnest(stat_min) AS lo, unnest(stat_max) AS hi FROM episode_stats WHERE signal_kind = 'qpos' AND len(stat_min) = len(stat_max) AND stat_day < DATE '2024-09-01'),
    lim AS (SELECT dataset, dim, min(lo) AS low, max(hi) AS high FROM u WHERE isfinite(lo) AND isfinite(hi) GROUP BY ALL),
    e AS (SELECT ep_key, dataset, dim, min(v) AS lo, max(v) AS hi FROM f GROUP BY ALL)
    SELECT ep_key, dim, lo, hi FROM e JOIN lim USING (dataset, dim) WHERE lo < low - 1e-6 OR hi > high + 1e-6""",
)
def spot_check(spark: SparkSession, root: str) -> DataFrame:
    """Episodes beyond the limits that are stored for their dataset; all are looked at, not a sample."""
    stats = table(spark, root, "episode_stats", "dataset", "signal_kind", "stat_min", "stat_max", "stat_day")
    stats = stats.where((F.col("signal_kind") == "qpos") & (F.size("stat_min") == F.size("stat_max")) & (F.col("stat_day") < F.lit("2024-09-01").cast("date")))
    pairs = stats.select("dataset", F.posexplode(F.arrays_zip("stat_min", "stat_max")).alias("dim", "s")).select("dataset", "dim", F.col("s.stat_min").alias("lo"), F.col("s.stat_max").alias("hi"))
    limits = durable(pairs.where(finite("lo") & finite("hi")).groupBy(*_KEY).agg(F.min("lo").alias("low"), F.max("hi").alias("high")))
    local = _stored(spark, root).groupBy("ep_key", "dataset", "dim").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    return S.beside_limits(local, limits, _KEY).where("lo < low - 1e-6 OR hi > high + 1e-6").select("ep_key", "dim", "lo", "hi")


_PAIR = f"""{STEPS}, x AS ({readings_sql('qpos', 'st', 'ep_key, dataset, t')}), p AS (SELECT ep_key, dataset, t, dim, CASE WHEN isfinite(v) THEN v END AS a FROM x),
    q AS (SELECT *, lead(a) OVER (PARTITION BY ep_key, dim ORDER BY t) AS b FROM p), e AS (SELECT *, b - a AS e, (t % 3 <> 0)::INT::DOUBLE AS m FROM q WHERE b - a IS NOT NULL)"""


def _errors(spark: SparkSession, root: str) -> DataFrame:
    """Each dimension against its next value, with a mask; as a prediction and its target. Long recordings go by parts."""
    from pyspark.sql import Window

    from stepforge.plans.motion import _in_windows

    df, by = _in_windows(spark, root, "dataset", "qpos")
    df = readings("qpos", df, *by, "dataset", "t", "_own").withColumn("v", finite_or_null(F.col("v")))
    b = F.lead("v").over(Window.partitionBy(*by, "dim").orderBy("t"))
    e = df.withColumn("e", b - F.col("v")).where("_own AND e IS NOT NULL")
    return e.select("ep_key", "dataset", "t", "dim", "e", (F.col("t") % 3 != 0).cast("double").alias("m"))


_SAMPLE = "SELECT dataset, ep_key, sum(e * e * m) / greatest(sum(m), 1) AS mse, sum(abs(e) * m) / 1.001 / greatest(sum(m), 1) AS l1 FROM e GROUP BY ALL"


def _samples(errors: DataFrame) -> DataFrame:
    e, m = F.col("e"), F.col("m")
    n = F.greatest(F.sum(m), F.lit(1.0))
    return errors.groupBy("dataset", "ep_key").agg((F.sum(e * e * m) / n).alias("mse"), (F.sum(F.abs(e) * m) / F.lit(1.001) / n).alias("l1"))


@query("action_metrics", f"WITH {_PAIR}, s AS ({_SAMPLE}) SELECT dataset, {DIGITS.format('avg(mse)')} AS mse, {DIGITS.format('stddev_samp(mse)')} AS mse_std, {DIGITS.format('avg(l1)')} AS l1, {DIGITS.format('stddev_samp(l1)')} AS l1_std FROM s GROUP BY dataset")
def action_metrics(spark: SparkSession, root: str) -> DataFrame:
    """Masked errors of all dimensions per sample, then mean and sample deviation; one sample has no deviation."""
    figures = {"mse": F.avg("mse"), "mse_std": F.stddev_samp("mse"), "l1": F.avg("l1"), "l1_std": F.stddev_samp("l1")}
    by = _samples(_errors(spark, root)).groupBy("dataset").agg(*[c.alias(n) for n, c in figures.items()])
    return by.select("dataset", *[F.when(F.col(n).isNotNull(), significant(F.col(n))).alias(n) for n in figures])


@query("eval_rollup", f"WITH {_PAIR}, s AS ({_SAMPLE}), b AS (SELECT ep_key // 8 AS batch, avg(mse) AS mse FROM s GROUP BY ALL) SELECT count(*) AS n_batches, {DIGITS.format('avg(mse)')} AS mean, {DIGITS.format('stddev_pop(mse)')} AS std FROM b")
def eval_rollup(spark: SparkSession, root: str) -> DataFrame:
    """Mean and population deviation over batches, from the errors of all dimensions."""
    batches = _samples(_errors(spark, root)).groupBy(F.floor(F.col("ep_key") / 8).alias("batch")).agg(F.avg("mse").alias("mse"))
    figures = batches.agg(F.count(F.lit(1)).alias("n_batches"), F.avg("mse").alias("mean"), F.stddev_pop("mse").alias("std"))
    return figures.select("n_batches", *[F.when(F.col(n).isNotNull(), significant(F.col(n))).alias(n) for n in ("mean", "std")])


@query("masked_loss", f"WITH {_PAIR} SELECT dataset, {DIGITS.format('sum(e * e * m) / greatest(sum(m), 1)')} AS loss FROM e GROUP BY dataset")
def masked_loss(spark: SparkSession, root: str) -> DataFrame:
    """The mean masked error of all dimensions."""
    return _errors(spark, root).groupBy("dataset").agg(S.masked_mean(F.col("e") * F.col("e"), F.col("m")).alias("loss")).select("dataset", significant(F.col("loss")).alias("loss"))


@query(
    "run_counters",
    """WITH e AS (SELECT dataset, CASE WHEN instruction IS NULL OR trim(instruction) = '' THEN 'no_text' WHEN n_steps IS NULL OR n_steps < 2 THEN 'short' WHEN NOT has_epos THEN 'no_epos' ELSE 'written' END AS status FROM episodes)
    SELECT dataset, count(*) AS seen, count(*) FILTER (status = 'written') AS written, count(*) FILTER (status = 'no_text') AS skipped_text,
    count(*) FILTER (status = 'short') AS skipped_short, count(*) FILTER (status = 'no_epos') AS skipped_epos FROM e GROUP BY dataset""",
)
def run_counters(spark: SparkSession, root: str) -> DataFrame:
    return _counters(spark, root)


def _counters(spark: SparkSession, root: str) -> DataFrame:
    df = table(spark, root, "episodes", "dataset", "instruction", "n_steps", "has_epos")
    status = (
        F.when(F.col("instruction").isNull() | (F.trim("instruction") == ""), "no_text")
        .when(F.col("n_steps").isNull() | (F.col("n_steps") < 2), "short")
        .when(~F.col("has_epos"), "no_epos")
        .otherwise("written")
    )
    names = {"written": "written", "skipped_text": "no_text", "skipped_short": "short", "skipped_epos": "no_epos"}
    return df.groupBy("dataset").agg(F.count(F.lit(1)).alias("seen"), *[F.count_if(status == s).alias(n) for n, s in names.items()])


@query(
    "counter_merge",
    """SELECT count(*) AS seen, count(*) FILTER (NOT (instruction IS NULL OR trim(instruction) = '') AND n_steps >= 2 AND has_epos) AS written FROM episodes""",
)
def counter_merge(spark: SparkSession, root: str) -> DataFrame:
    """The counters of all parts of a run added up."""
    return _counters(spark, root).agg(F.sum("seen").alias("seen"), F.sum("written").alias("written"))


@query(
    "video_channel_stats",
    f"""WITH {STEPS}, p AS (SELECT dataset, i % 3 AS channel, (abs(hash_in) % 256)::DOUBLE / 255 AS v FROM (SELECT dataset, i, (ep_key * 31 + t * 17 + i * 101) AS hash_in FROM st, range(0, 6) r(i)))
    SELECT dataset, channel, min(v) AS low, max(v) AS high, round(avg(v), 9) AS mean, round(stddev_pop(v), 9) AS std FROM p GROUP BY ALL""",
)
def video_channel_stats(spark: SparkSession, root: str) -> DataFrame:
    """Limits, mean and deviation of each colour channel, over pixels given as rows."""
    pixels = steps(spark, root, "dataset").select("dataset", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("i"), "ep_key", "t")
    v = (F.abs(F.col("ep_key") * 31 + F.col("t") * 17 + F.col("i") * 101) % 256).cast("double") / 255
    return pixels.select("dataset", (F.col("i") % 3).alias("channel"), v.alias("v")).groupBy("dataset", "channel").agg(
        F.min("v").alias("low"), F.max("v").alias("high"), F.round(F.avg("v"), 9).alias("mean"), F.round(F.stddev_pop("v"), 9).alias("std")
    )

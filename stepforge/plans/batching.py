"""Mixture, weights, padding and batching of samples; schedules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stepforge.functions import schedules as H
from stepforge.operators import batching as B
from stepforge.operators.ranking import ranked
from stepforge.plans.common import EPISODES, STEPS, episodes, steps
from stepforge.registry import query
from stepforge.tables import table

_U = "CAST('0x' || substr(md5('{0}|' || {1}), 1, 8) AS BIGINT) / 4294967296.0"


@query(
    "dataset_mixture",
    f"""WITH w AS (SELECT names, weights, sum(weights) OVER (ORDER BY names) - weights AS lo, sum(weights) OVER () AS whole FROM multi_dataset WHERE weights > 0),
    {EPISODES}, u AS (SELECT ep_key AS draw, {_U.format(7, 'ep_key')} AS u FROM ep)
    SELECT draw, names AS dataset FROM u JOIN w ON u * whole >= lo AND u * whole < lo + weights""",
)
def dataset_mixture(spark: SparkSession, root: str) -> DataFrame:
    """A dataset for each draw, by weight, from a uniform number that depends on seed and draw.

    The sources' bounds are one array in a single row (bounded by the sources), looked up by value.
    """
    sources = table(spark, root, "multi_dataset", "names", "weights").where("weights > 0")
    w = Window.orderBy("names")
    bounds = sources.select("names", (F.sum("weights").over(w) - F.col("weights")).alias("lo"), F.sum("weights").over(Window.partitionBy()).alias("whole"))
    packed = bounds.agg(F.sort_array(F.collect_list(F.struct("lo", "names"))).alias("s"), F.max("whole").alias("whole"))
    draws = episodes(spark, root, "dataset").select(F.col("ep_key").alias("draw"), B.uniform(7, F.col("ep_key")).alias("u"))
    joined = draws.join(F.broadcast(packed), F.lit(True), "left")
    hit = F.element_at(F.filter("s", lambda x: x["lo"] <= F.col("u") * F.col("whole")), -1)
    return joined.select("draw", hit["names"].alias("dataset"))


@query(
    "task_weights",
    f"""WITH {EPISODES}, t AS (SELECT dataset, task_slug, count(*) AS n FROM ep GROUP BY ALL)
    SELECT dataset, task_slug, CASE WHEN dataset = 'robotwin2' THEN 1.0::DOUBLE / count(*) OVER (PARTITION BY dataset) ELSE n / (sum(n) OVER (PARTITION BY dataset))::DOUBLE END AS weight FROM t""",
)
def task_weights(spark: SparkSession, root: str) -> DataFrame:
    """Sampling weight of each task: by its episodes, or equal for robotwin2."""
    tasks = episodes(spark, root, "dataset", "task_slug").groupBy("dataset", "task_slug").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("dataset")
    even = F.lit(1.0) / F.count(F.lit(1)).over(w)
    return tasks.select("dataset", "task_slug", F.when(F.col("dataset") == "robotwin2", even).otherwise(F.col("n") / F.sum("n").over(w)).alias("weight"))


@query(
    "epoch_length",
    f"WITH {EPISODES} SELECT dataset, count(*) * CASE WHEN dataset IN ('ac_one', 'aloha_agilex_2') THEN 10000 ELSE 100 END AS length FROM ep GROUP BY dataset",
)
def epoch_length(spark: SparkSession, root: str) -> DataFrame:
    factor = F.when(F.col("dataset").isin("ac_one", "aloha_agilex_2"), 10000).otherwise(100)
    return episodes(spark, root, "dataset").groupBy("dataset").agg(F.count(F.lit(1)).alias("n")).select("dataset", (F.col("n") * factor).alias("length"))


@query(
    "pad_last_dim",
    f"""WITH {STEPS}, p AS (SELECT ep_key, t, i::INT AS dim, CASE WHEN i < len(qpos) THEN qpos[i + 1]::DOUBLE ELSE 0.0 END + 0.0 AS v, i < len(qpos) AS real FROM st, range(0, 14) r(i) WHERE qpos IS NOT NULL)
    SELECT * FROM p""",
)
def pad_last_dim(spark: SparkSession, root: str) -> DataFrame:
    """Signals of every width as 14 values with a mask of the real ones; a wider one raises an error."""
    return _padded(steps(spark, root, "qpos"))


def _padded(df: DataFrame) -> DataFrame:
    padded = B.pad_last(F.col("qpos").cast("array<double>"), 14, F.lit(0.0))
    long = df.where("qpos IS NOT NULL").select("ep_key", "t", F.size("qpos").alias("n"), F.posexplode(padded).alias("dim", "v"))
    return long.select("ep_key", "t", "dim", (F.col("v") + F.lit(0.0)).alias("v"), (F.col("dim") < F.col("n")).alias("real"))


_IDS = "list_transform(string_split(coalesce(text, ''), ' '), lambda w: len(w) + 1)"


@query(
    "pad_token_batch",
    f"""WITH d AS (SELECT doc_id, doc_id // 4 AS batch, {_IDS} AS ids, doc_id % 3 AS masked FROM documents WHERE text IS NOT NULL),
    b AS (SELECT *, len(ids) AS n, max(len(ids)) OVER (PARTITION BY batch) AS padded FROM d)
    SELECT doc_id, batch, n, padded, list_transform(range(0, padded), lambda i: CASE WHEN i < n THEN ids[i + 1] ELSE 0 END)::BIGINT[] AS ids,
    list_transform(range(0, padded), lambda i: CASE WHEN i < n THEN 1 ELSE 0 END)::INT[] AS mask,
    list_transform(range(0, padded), lambda i: CASE WHEN i < n AND i >= masked THEN ids[i + 1] ELSE -100 END)::BIGINT[] AS labels FROM b""",
)
def pad_token_batch(spark: SparkSession, root: str) -> DataFrame:
    """Token ids of each text padded to the longest of its batch of four with 0, the mask with 0, the labels with -100.

    An id is one more than its word's length; a text's first words, its prompt, have no label. A window holds one batch.
    """
    df = table(spark, root, "documents", "doc_id", "text").where("text IS NOT NULL")
    ids = F.transform(F.split("text", " "), lambda w: (F.char_length(w) + 1).cast("bigint"))
    df = df.select("doc_id", F.expr("doc_id div 4").alias("batch"), ids.alias("_ids"), (F.col("doc_id") % 3).cast("int").alias("_masked"))
    df = df.withColumn("n", F.size("_ids").cast("bigint"))
    df = df.withColumn("padded", F.max("n").over(Window.partitionBy("batch")))
    ids, mask, labels = B.pad_tokens(F.col("_ids"), F.col("padded").cast("int"), F.col("_masked"))
    return df.select("doc_id", "batch", "n", "padded", ids.alias("ids"), mask.alias("mask"), labels.alias("labels"))


@query(
    "pad_truncate_embedding",
    """SELECT vec_id, i::INT AS at, CASE WHEN i < len(embedding) THEN embedding[i + 1]::DOUBLE ELSE 0.0 END AS v FROM embeddings, range(0, 80) r(i)""",
)
def pad_truncate_embedding(spark: SparkSession, root: str) -> DataFrame:
    """Vectors cut or filled to 80 values."""
    df = table(spark, root, "embeddings", "vec_id", "embedding")
    return df.select("vec_id", F.posexplode(B.pad_truncate(F.col("embedding").cast("array<double>"), 80, F.lit(0.0))).alias("at", "v"))


@query(
    "collate_filter",
    f"""WITH {EPISODES} SELECT ep_key // 16 AS batch, count(*) AS n, bool_and(has_video) AS with_video, bool_and(instruction IS NOT NULL) AS with_text, bool_or(dataset IS NOT NULL) AS with_name FROM ep WHERE n_steps IS NOT NULL GROUP BY ALL""",
)
def collate_filter(spark: SparkSession, root: str) -> DataFrame:
    """Usable samples of each batch, and which optional parts all of them have."""
    df = episodes(spark, root, "dataset", "instruction", "has_video", "n_steps").where("n_steps IS NOT NULL")
    return df.groupBy(F.expr("ep_key div 16").alias("batch")).agg(
        F.count(F.lit(1)).alias("n"), F.bool_and("has_video").alias("with_video"), F.bool_and(F.col("instruction").isNotNull()).alias("with_text"), F.bool_or(F.col("dataset").isNotNull()).alias("with_name")
    )


_RANK = f"{EPISODES}, r AS (SELECT ep_key, dataset, row_number() OVER (PARTITION BY dataset ORDER BY ep_key) - 1 AS rn, count(*) OVER (PARTITION BY dataset) AS n FROM ep)"


def _ranked(spark: SparkSession, root: str) -> DataFrame:
    df = episodes(spark, root, "dataset")
    sizes = df.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))
    placed = ranked(df, ["dataset"], F.col("ep_key"), [F.col("ep_key")], "place").withColumn("rn", F.col("place") - 1)
    return placed.join(sizes, "dataset")


@query("round_robin_shard", f"WITH {_RANK} SELECT ep_key, rn % 3 AS shard FROM r")
def round_robin_shard(spark: SparkSession, root: str) -> DataFrame:
    return _ranked(spark, root).select("ep_key", (F.col("rn") % 3).alias("shard"))


@query("contiguous_chunks", f"WITH {_RANK} SELECT ep_key, floor(rn / ceil(n / 4.0))::BIGINT AS chunk FROM r")
def contiguous_chunks(spark: SparkSession, root: str) -> DataFrame:
    return _ranked(spark, root).select("ep_key", B.contiguous_chunk(F.col("rn"), F.col("n"), 4).alias("chunk"))


@query("limit_prefix", f"WITH {EPISODES} SELECT ep_key, dataset FROM ep ORDER BY ep_key LIMIT 25")
def limit_prefix(spark: SparkSession, root: str) -> DataFrame:
    """The first 25 episodes; the limit is the operator."""
    return episodes(spark, root, "dataset").orderBy("ep_key").limit(25)


@query("distributed_sampler", f"WITH {EPISODES}, u AS (SELECT ep_key, {_U.format('3-epoch-1', 'ep_key')} AS u FROM ep) SELECT ep_key, floor(u * 8)::BIGINT AS rank FROM u")
def distributed_sampler(spark: SparkSession, root: str) -> DataFrame:
    """The worker of each episode in an epoch, by hash; no global sort is needed."""
    u = F.conv(F.substring(F.md5(F.concat(F.lit("3-epoch-1|"), F.col("ep_key").cast("string"))), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)
    return episodes(spark, root, "dataset").select("ep_key", F.floor(u * 8).alias("rank"))


@query("embedding_pick", f"SELECT vec_id, floor({_U.format(5, 'vec_id')} * len(embedding))::INT AS at, embedding[floor({_U.format(5, 'vec_id')} * len(embedding))::INT + 1]::DOUBLE AS v FROM embeddings")
def embedding_pick(spark: SparkSession, root: str) -> DataFrame:
    """A random element of each list and its place."""
    at = F.floor(B.uniform(5, F.col("vec_id")) * F.size("embedding")).cast("int")
    return table(spark, root, "embeddings", "vec_id", "embedding").select("vec_id", at.alias("at"), F.get("embedding", at).cast("double").alias("v"))


@query(
    "labels_mask",
    f"""WITH {STEPS} SELECT ep_key, t, i::INT AS at, CASE WHEN i >= 3 AND (t + i) % 5 <> 0 THEN (ep_key + i)::INT ELSE -100 END AS label FROM st, range(0, 7) r(i)""",
)
def labels_mask(spark: SparkSession, root: str) -> DataFrame:
    """Labels of a token list for each step, whose answer begins at token 3 and some tokens of which are masked."""
    df = steps(spark, root)
    at = F.sequence(F.lit(0), F.lit(6))
    ids = F.transform(at, lambda i: (F.col("ep_key") + i).cast("int"))
    mask = F.transform(at, lambda i: ((F.col("t") + i) % 5 != 0).cast("int"))
    return df.select("ep_key", "t", F.posexplode(B.labels_of(ids, mask, F.lit(3))).alias("at", "label"))


@query("visible_length", f"WITH {EPISODES} SELECT ep_key, greatest(1, least(ep_key % 50, coalesce(n_steps, 0), 40))::BIGINT AS n_visible FROM ep")
def visible_length(spark: SparkSession, root: str) -> DataFrame:
    df = episodes(spark, root, "n_steps")
    n = B.visible_length(F.col("ep_key") % 50, F.coalesce("n_steps", F.lit(0)).cast("bigint"), F.lit(40))
    return df.select("ep_key", n.cast("bigint").alias("n_visible"))


@query("shape_probe_from_features", f"WITH {EPISODES} SELECT ep_key, (240 + ep_key % 13) + (240 + ep_key % 13) // 2 AS height FROM ep")
def shape_probe_from_features(spark: SparkSession, root: str) -> DataFrame:
    h = 240 + F.col("ep_key") % 13
    return episodes(spark, root, "dataset").select("ep_key", (h + F.floor(h / 2)).alias("height"))


# ---------------------------------------------------------------- schedules


@query(
    "lr_linear_warmup",
    "SELECT i AS step, round(CASE WHEN i <= 0 THEN 0.2 WHEN i <= 100 THEN 0.2 + (1.0 - 0.2) * i / 100.0 WHEN i < 1000 THEN 0.1 + (1.0 - 0.1) * (1000 - i) / 900.0 ELSE 0.1 END, 9)::DOUBLE AS factor FROM range(0, 1101) r(i)",
)
def lr_linear_warmup(spark: SparkSession, root: str) -> DataFrame:
    """From a start factor up to the greatest, then straight down to the least, which stays."""
    s = F.col("id")
    return spark.range(0, 1101).select(s.alias("step"), F.round(H.linear_warmup(s, 100, 1000, 0.2, 1.0, 0.1), 9).alias("factor"))


@query("lr_cosine", "SELECT i AS step, round(greatest(0.1, 0.5 * (1 + cos(pi() * i / 1000.0)))::DOUBLE, 9) AS factor FROM range(0, 1001) r(i)")
def lr_cosine(spark: SparkSession, root: str) -> DataFrame:
    return spark.range(0, 1001).withColumnRenamed("id", "step").select("step", F.round(H.cosine(F.col("step"), 1000, 0.1), 9).alias("factor"))


_FORMS = {  # name: extra step, shift or exponential mu, terminal, reverse
    "plain": (True, 5.0, None, None, False),
    "exponential": (False, None, 0.8, None, False),
    "terminal": (True, 3.0, None, 0.1, False),
    "reverse": (True, 5.0, None, None, True),
}


def _sigma_sql(name: str) -> str:
    extra, shift, mu, terminal, reverse = _FORMS[name]
    n = 50
    s = f"(1.0 - i / {n if extra else n - 1}.0)"
    sigma = f"CASE WHEN {s} = 0 THEN 0.0 ELSE exp({mu}) / (exp({mu}) + (1 / {s} - 1)) END" if mu is not None else f"{shift} * {s} / (1 + ({shift} - 1) * {s})"
    inner = f"SELECT i, ({sigma})::DOUBLE AS sigma FROM range(0, {n}) r(i)"
    if terminal is not None:
        inner = f"SELECT i, 1 - (1 - sigma) / (last_value(1 - sigma) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) / (1 - {terminal})) AS sigma FROM ({inner})"
    return f"SELECT '{name}' AS form, i AS step, {'1 - sigma' if reverse else 'sigma'} AS sigma FROM ({inner})"


@query(
    "fm_sigma_schedule",
    f"""WITH s AS ({" UNION ALL ".join(_sigma_sql(n) for n in _FORMS)}), y AS (SELECT *, exp(-2 * pow((sigma * 1000 - 25) / 50, 2)) AS y FROM s),
    l AS (SELECT form, min(y) AS low, count(*) AS n, sum(y) AS total FROM y GROUP BY form)
    SELECT form, step, round(sigma, 9) + 0.0 AS sigma, round(sigma * 1000, 6) + 0.0 AS timestep, round((y - low) * n / (total - n * low), 9) + 0.0 AS weight FROM y JOIN l USING (form)""",
)
def fm_sigma_schedule(spark: SparkSession, root: str) -> DataFrame:
    """Sigmas, time steps and training weights of a flow schedule in its forms: shifted, exponential, with a terminal value, reversed."""
    out = None
    for name, (extra, shift, mu, terminal, reverse) in _FORMS.items():
        one = H.sigma_schedule(spark, 50, extra_step=extra, shift=shift, exponential_mu=mu, terminal=terminal, reverse=reverse).withColumn("form", F.lit(name))
        out = one if out is None else out.unionByName(one)
    r = lambda c, d: F.round(c, d) + F.lit(0.0)
    return out.select("form", "step", r("sigma", 9).alias("sigma"), r("timestep", 6).alias("timestep"), r("weight", 9).alias("weight"))


_NOISE = "x AS (SELECT vec_id, (i - 1)::INT AS dim, embedding[i]::DOUBLE AS x, embedding[i % len(embedding) + 1]::DOUBLE AS n, 0.3 AS s FROM embeddings, range(1, 65) r(i) WHERE i <= len(embedding))"


@query("noise_mix", f"WITH {_NOISE} SELECT vec_id, dim, round((1 - s) * x + s * n, 9) + 0.0 AS mixed, round(n - x, 9) + 0.0 AS target, round((1 - s) * x + s * n + (n - x) * (0.1 - s), 9) + 0.0 AS stepped FROM x")
def noise_mix(spark: SparkSession, root: str) -> DataFrame:
    """Noisy sample, velocity target, and one Euler step of every element, with the vector's next element as its noise."""
    x, n = F.col("x"), F.col("n")
    mixed = H.noise_mix(x, n, F.lit(0.3))
    r = lambda c: F.round(c, 9) + 0.0
    both = F.transform("embedding", lambda v, i: F.struct(v.cast("double").alias("x"), F.get("embedding", (i + 1) % F.size("embedding")).cast("double").alias("n")))
    long = table(spark, root, "embeddings", "vec_id", "embedding").select("vec_id", F.posexplode(both).alias("dim", "b")).select("vec_id", "dim", "b.x", "b.n")
    return long.select("vec_id", "dim", r(mixed).alias("mixed"), r(n - x).alias("target"), r(H.euler_step(mixed, n - x, F.lit(0.3), F.lit(0.1))).alias("stepped"))


@query(
    "sincos_pos_embed",
    """SELECT p AS position, i AS at, round(CASE WHEN i < 8 THEN sin(p / pow(10000, i / 8.0)) ELSE cos(p / pow(10000, (i - 8) / 8.0)) END, 9) + 0.0 AS v FROM range(0, 32) a(p), range(0, 16) b(i)""",
)
def sincos_pos_embed(spark: SparkSession, root: str) -> DataFrame:
    df = spark.range(0, 32).withColumnRenamed("id", "position")
    return df.select("position", F.posexplode(H.sincos(F.col("position"), 16)).alias("at", "v")).select("position", F.col("at").cast("bigint").alias("at"), (F.round("v", 9) + 0.0).alias("v"))


#: Buckets of the grid of time steps.
BUCKETS = 10_000


@query("timestep_distribution")
def timestep_distribution(spark: SparkSession, root: str) -> DataFrame:
    """The inverse of a logit-normal distribution at quantiles from 1e-4 to 1 - 1e-4; Python, as there is no built-in quantile."""
    return H.logit_normal_grid(spark, BUCKETS).select("bucket", F.round("value", 9).alias("value"))


@query(
    "timestep_slice",
    f"""WITH g AS (SELECT i AS bucket, 1e-4::DOUBLE + i * ((1 - 1e-4::DOUBLE) - 1e-4::DOUBLE) / {BUCKETS - 1} AS value FROM range(0, {BUCKETS}) r(i)), s AS (SELECT * FROM g WHERE value >= 0.25 AND value < 0.75),
    n AS (SELECT count(*) AS n, min(bucket) AS first FROM s), {EPISODES}, u AS (SELECT ep_key, {_U.format(13, 'ep_key')} AS u FROM ep)
    SELECT ep_key, round(1e-4::DOUBLE + (first + floor(u * n)::BIGINT) * ((1 - 1e-4::DOUBLE) - 1e-4::DOUBLE) / {BUCKETS - 1}, 9) AS value FROM u, n""",
)
def timestep_slice(spark: SparkSession, root: str) -> DataFrame:
    """A time step of each episode by its quantile in the slice from 0.25 to 0.75 of the uniform grid."""
    grid = H.uniform_grid(spark, BUCKETS)
    part = H.slice_grid(grid, 0.25, 0.75)
    draws = episodes(spark, root, "dataset").select("ep_key", B.uniform(13, F.col("ep_key")).alias("quantile"))
    return H.sample_grid(draws, part, "quantile").select("ep_key", F.round("value", 9).alias("value"))


@query("config_projection", "SELECT dataset, task_grouping, fps FROM convert_config")
def config_projection(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "convert_config", "dataset", "task_grouping", "fps")


@query(
    "config_merge",
    "SELECT names AS dataset, coalesce(c.fps, 10) AS fps, coalesce(c.t5_max_length, 512) AS t5_max_length, m.target_action_dim FROM multi_dataset m LEFT JOIN convert_config c ON c.dataset = m.names",
)
def config_merge(spark: SparkSession, root: str) -> DataFrame:
    """A child's settings over its parent's."""
    parent = table(spark, root, "multi_dataset", "names", "target_action_dim")
    child = table(spark, root, "convert_config", F.col("dataset").alias("names"), "fps", "t5_max_length")
    return parent.join(child, "names", "left").select(
        F.col("names").alias("dataset"), F.coalesce("fps", F.lit(10)).alias("fps"), F.coalesce("t5_max_length", F.lit(512)).alias("t5_max_length"), "target_action_dim"
    )




@query(
    "retry_sampling",
    f"""WITH {EPISODES}, v AS (SELECT dataset, task_slug, ep_key, {_U.format(11, 'ep_key')} AS u FROM ep WHERE trim(coalesce(instruction, '')) <> '' AND n_steps >= 2 AND has_video)
    SELECT dataset, task_slug, ep_key FROM v QUALIFY row_number() OVER (PARTITION BY dataset, task_slug ORDER BY u, ep_key) = 1""",
)
def retry_sampling(spark: SparkSession, root: str) -> DataFrame:
    """One usable episode of each task, by hash. Unusable ones are left out before, so nothing is tried again; the pick is an aggregate."""
    df = episodes(spark, root, "dataset", "task_slug", "instruction", "n_steps", "has_video")
    usable = df.where((F.trim("instruction") != "") & (F.col("n_steps") >= 2) & F.col("has_video"))
    return usable.groupBy("dataset", "task_slug").agg(F.min_by("ep_key", F.struct(B.uniform(11, F.col("ep_key")), F.col("ep_key"))).alias("ep_key"))

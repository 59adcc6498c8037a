"""Queries of the core's data problems: implausible readings, skewed keys, small files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stepforge.operators.packing import OPEN_COST, TARGET_BYTES, latest_listing, pack_splits
from stepforge.operators.spikes import flag_rates, flag_readings
from stepforge.operators.treeagg import key_extremes
from stepforge.registry import query
from stepforge.tables import table

#: Widest signal: two arms of seven values.
WIDTH = 14


@query("p4_found")
def p4_found(spark: SparkSession, root: str) -> DataFrame:
    steps = table(spark, root, "steps", "ep_key", "dataset", "t", "qpos", "epos")
    return flag_readings(steps).select("ep_key", "t", "signal_kind", "dim")


@query("p4_rates")
def p4_rates(spark: SparkSession, root: str) -> DataFrame:
    """Readings, flagged ones by reason, and rates of each dataset, signal and dimension; also of those without a flag. Null is a dataset."""
    return flag_rates(table(spark, root, "steps", "ep_key", "dataset", "t", "qpos", "epos"))


def _slugs(spark: SparkSession, root: str) -> DataFrame:
    steps = table(spark, root, "steps", "task_slug", "ep_key", "qpos", "epos")
    return key_extremes(steps, "task_slug", "ep_key", ["qpos", "epos"], WIDTH)


@query(
    "p5_found",
    """
    SELECT task_slug FROM (SELECT task_slug, count(*) AS n FROM steps GROUP BY task_slug)
    WHERE task_slug IS NOT NULL AND n >= 0.05 * (SELECT count(*) FROM steps)
    """,
)
def p5_found(spark: SparkSession, root: str) -> DataFrame:
    # The window holds one row per slug, after the tree's last round; steps are read once.
    slugs = key_extremes(table(spark, root, "steps", "task_slug"), "task_slug", None, [], 0)
    share = slugs.withColumn("all_rows", F.sum("n_rows").over(Window.partitionBy()))
    return share.where(F.col("task_slug").isNotNull() & (F.col("n_rows") >= 0.05 * F.col("all_rows"))).select("task_slug")


_FINITE = "CASE WHEN isfinite({0}) THEN {0} END"


def _extremes_sql() -> str:
    columns = []
    for signal in ("qpos", "epos"):
        for i in range(WIDTH):
            x = _FINITE.format(f"{signal}[{i + 1}]::DOUBLE")
            columns += [f"min({x}) AS {signal}_min_{i}", f"max({x}) AS {signal}_max_{i}"]
    return f"""
    SELECT task_slug, count(*) AS n_rows, count(DISTINCT ep_key) AS n_entities, {", ".join(columns)}
    FROM steps GROUP BY task_slug
    """


@query("p5_slug_stats", _extremes_sql())
def p5_slug_stats(spark: SparkSession, root: str) -> DataFrame:
    """Rows, episodes and extremes per task_slug, complete for every slug."""
    return _slugs(spark, root).withColumn("n_rows", F.col("n_rows").cast("bigint"))


#: Kinds that are consolidated, and the ending of an unfinished file.
KINDS = ("qpos", "epos", "instructions", "umt5_wan")
UNFINISHED = r"\.(gstmp|tmp|part)$"
_GROUP = ["dataset", "split", "kind"]


def _packed(spark: SparkSession, root: str) -> DataFrame:
    files = table(
        spark, root, "episode_files", "file_id", "dataset", "split", "kind", "file_path", "n_bytes", "n_records", "modified_ts"
    ).where(F.col("kind").isin(*KINDS))
    return pack_splits(latest_listing(files, UNFINISHED), _GROUP)


_PACK_SQL = f"""
    WITH one AS (
        SELECT * FROM episode_files
        WHERE kind IN ('qpos', 'epos', 'instructions', 'umt5_wan')
          AND file_path IS NOT NULL AND NOT regexp_matches(file_path, '{UNFINISHED}')
        QUALIFY row_number() OVER (PARTITION BY file_path ORDER BY modified_ts DESC NULLS LAST, file_id) = 1),
    sized AS (SELECT *, coalesce(n_bytes, 0) + {OPEN_COST} AS padded FROM one),
    packed AS (
        SELECT *, CAST(floor((sum(padded) OVER (PARTITION BY dataset, split, kind ORDER BY file_id) - padded)
                             / {TARGET_BYTES - TARGET_BYTES // 8}) AS BIGINT) AS bin_no
        FROM sized WHERE padded <= {TARGET_BYTES // 8}
        UNION ALL SELECT *, -1 - file_id FROM sized WHERE padded > {TARGET_BYTES // 8})
"""


@query("p7_assignment", _PACK_SQL + "SELECT file_id, dataset, split, kind, bin_no, n_bytes, n_records FROM packed")
def p7_assignment(spark: SparkSession, root: str) -> DataFrame:
    """The output file (bin_no within dataset, split and kind) of each finished file."""
    return _packed(spark, root).select("file_id", "dataset", "split", "kind", "bin_no", "n_bytes", "n_records")


@query(
    "p7_bins",
    _PACK_SQL
    + """SELECT dataset, split, kind, bin_no, count(*) AS n_files, CAST(sum(coalesce(n_bytes, 0)) AS BIGINT) AS n_bytes,
    CAST(sum(coalesce(n_records, 0)) AS BIGINT) AS n_records FROM packed GROUP BY ALL""",
)
def p7_bins(spark: SparkSession, root: str) -> DataFrame:
    """Size and content of each output file."""
    return (
        _packed(spark, root)
        .groupBy(*_GROUP, "bin_no")
        .agg(
            F.count(F.lit(1)).alias("n_files"),
            F.sum(F.coalesce("n_bytes", F.lit(0))).cast("bigint").alias("n_bytes"),
            F.sum(F.coalesce("n_records", F.lit(0))).cast("bigint").alias("n_records"),
        )
    )

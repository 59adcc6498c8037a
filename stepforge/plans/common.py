"""Tables in the shape that the reference queries need, and the same in SQL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepforge.tables import table


def episodes(spark: SparkSession, root: str, *columns: str) -> DataFrame:
    """Each episode once, as last ingested."""
    wanted = [c for c in columns if c != "ep_key"]
    df = table(spark, root, "episodes", "ep_key", "ingested_ts", *[c for c in wanted if c != "ingested_ts"])
    return df.groupBy("ep_key").agg(F.max_by(F.struct(*wanted), "ingested_ts").alias("_e")).select("ep_key", "_e.*")


EPISODES = "ep AS (SELECT * FROM episodes QUALIFY row_number() OVER (PARTITION BY ep_key ORDER BY ingested_ts DESC) = 1)"


def stored_steps(spark: SparkSession, root: str, *columns: str, datasets: Sequence[str] = ()) -> DataFrame:
    """Step rows as stored, repeats included: for aggregates that a repeated row doesn't change. ``datasets`` is tested at the scan."""
    df = table(spark, root, "steps", "ep_key", "t", *[c for c in columns if c not in ("ep_key", "t")])
    return df.where(F.col("dataset").isin(*datasets)) if datasets else df


def steps(spark: SparkSession, root: str, *columns: str, together: bool = False, datasets: Sequence[str] = ()) -> DataFrame:
    """Each step once; repeated rows have the same values.

    With ``together`` rows are shuffled by episode, for windows over episodes: one shuffle serves both.
    Otherwise they are spread by episode and step, for aggregations. ``datasets`` is tested at the scan.
    """
    wanted = [c for c in columns if c not in ("ep_key", "t")]
    df = stored_steps(spark, root, *wanted, datasets=datasets)
    if together:
        df = df.repartition("ep_key")
    if not wanted:
        return df.distinct()
    return df.groupBy("ep_key", "t").agg(*[F.any_value(c, F.lit(True)).alias(c) for c in wanted])


STEPS = """st AS (SELECT ep_key, t, any_value(dataset) AS dataset, any_value(task_slug) AS task_slug, any_value(qpos) AS qpos,
    any_value(epos) AS epos FROM steps GROUP BY ep_key, t)"""


def readings(signal: str, df: DataFrame, *keys: str) -> DataFrame:
    """Long form (keys, dim, v) of an array signal; null arrays give no rows."""
    return df.select(*keys, F.posexplode(signal).alias("dim", "v")).withColumn("v", F.col("v").cast("double"))


def readings_sql(signal: str, source: str, keys: str) -> str:
    return f"SELECT {keys}, (i - 1)::INT AS dim, {signal}[i]::DOUBLE AS v FROM {source}, range(1, 65) r(i) WHERE i <= len({signal})"


def finite(v: str = "v") -> F.Column:
    return ~F.isnan(v) & (F.abs(F.col(v)) < F.lit(float("inf")))


def finite_or_null(v: F.Column) -> F.Column:
    """A reading that isn't a finite number is missing."""
    return F.when(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), v)


def significant(v: F.Column) -> F.Column:
    """Nine significant digits, so that the order of additions doesn't show; DIGITS is the same in SQL."""
    return F.format_string("%.8e", v).cast("double") + F.lit(0.0)


DIGITS = "(printf('%.8e', {0})::DOUBLE + 0.0)"


def files(spark: SparkSession, root: str) -> DataFrame:
    """Finished files of the inventory, each path once."""
    df = table(spark, root, "episode_files", "dataset", "split", "task_slug", "episode_id", "ep_key", "kind", "file_path", "n_bytes")
    return df.where(~F.col("file_path").endswith(".gstmp")).dropDuplicates(["file_path"])


FILES = """fl AS (SELECT file_path, any_value(dataset) AS dataset, any_value(split) AS split, any_value(task_slug) AS task_slug,
    any_value(episode_id) AS episode_id, any_value(ep_key) AS ep_key, any_value(kind) AS kind, any_value(n_bytes) AS n_bytes
    FROM episode_files WHERE NOT file_path LIKE '%.gstmp' GROUP BY file_path)"""


def sql_list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"

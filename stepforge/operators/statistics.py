"""Per-dimension statistics over long readings (group columns, dim, v)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Most (group, dim) rows of limits that are joined by broadcast.
LIMIT_ROWS = 1_000_000


def min_max(df: DataFrame, group: Sequence[str]) -> DataFrame:
    """Rows, minimum and maximum of each group; null and NaN must be left out before. No rows, no groups."""
    return df.groupBy(*group).agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))


def moments(df: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group, n, mean, m2) states, where m2 is the sum of squared distances from the mean."""
    return df.groupBy(*group).agg(
        F.count("v").alias("n"), F.avg("v").alias("mean"), (F.var_pop("v") * F.count("v")).alias("m2")
    )


def merge_moments(states: DataFrame, group: Sequence[str]) -> DataFrame:
    """Mean and population deviation of all rows of several moment states.

    First the mean of all rows, then the states' distances from it are added to what they hold themselves, so that a mean that is large
    against the deviation loses no digits. The means come by broadcast up to LIMIT_ROWS groups, else by a shuffle.
    """
    means = states.groupBy(*group).agg(F.sum("n").alias("_n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("_mean"))
    off = F.col("mean") - F.col("_mean")
    return _beside(states, means, group).groupBy(*group).agg(
        F.first("_n").alias("n"), F.first("_mean").alias("mean"), F.sqrt(F.sum(F.col("m2") + F.col("n") * off * off) / F.first("_n")).alias("std")
    )


def _beside(rows: DataFrame, figures: DataFrame, group: Sequence[str]) -> DataFrame:
    """Rows with the figures of their group; null group values are groups."""
    small = figures.limit(LIMIT_ROWS + 1).count() <= LIMIT_ROWS
    keyed = figures.select(*[F.col(g).alias(f"_key_{g}") for g in group], *[c for c in figures.columns if c not in group])
    same = None
    for g in group:
        one = F.col(g).eqNullSafe(F.col(f"_key_{g}"))
        same = one if same is None else same & one
    return rows.join(F.broadcast(keyed) if small else keyed, same).drop(*[f"_key_{g}" for g in group])


def beside_limits(df: DataFrame, limits: DataFrame, group: Sequence[str]) -> DataFrame:
    """Rows with the limits of their group; limits are broadcast up to LIMIT_ROWS groups, else shuffled. Null groups find nothing."""
    small = limits.limit(LIMIT_ROWS + 1).count() <= LIMIT_ROWS
    return df.join(F.broadcast(limits) if small else limits, list(group))


def histogram(df: DataFrame, limits: DataFrame, group: Sequence[str], bins: int) -> DataFrame:
    """(group, bin, n): counts in ``bins`` bins from ``low`` to ``high`` of ``limits``.

    The scale uses bins - 1 and a range of at least 1e-12, so only the maximum lies in the last bin. Limits
    are one row per group; they are broadcast up to LIMIT_ROWS groups, else shuffled.
    """
    joined = beside_limits(df, limits, group)
    width = F.greatest(F.col("high") - F.col("low"), F.lit(1e-12))
    at = F.floor((F.col("v") - F.col("low")) * (bins - 1) / width)
    return joined.groupBy(*group, F.greatest(F.lit(0), F.least(at, F.lit(bins - 1))).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def histogram_quantile(counts: DataFrame, limits: DataFrame, group: Sequence[str], bins: int, qs: Sequence[float]) -> DataFrame:
    """(group, q, value): left edge of the first bin at which the running count reaches q of all rows.

    Edges divide [low - 1e-12, high + 1e-12] into ``bins`` parts. A window holds the bins of a group.
    """
    w = Window.partitionBy(*group)
    upto = counts.withColumn("upto", F.sum("n").over(w.orderBy("bin"))).withColumn("whole", F.sum("n").over(w))
    each = upto.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in qs])))
    first = each.where(F.col("upto") >= F.col("q") * F.col("whole")).groupBy(*group, "q").agg(F.min("bin").alias("bin"))
    low, high = F.col("low") - 1e-12, F.col("high") + 1e-12
    return first.join(limits, list(group)).select(*group, "q", (low + F.col("bin") * (high - low) / bins).alias("value"))


def outlier_dims(df: DataFrame, key: Sequence[str], limit: float) -> DataFrame:
    """(key, dims, largest): the dimensions of each key with a reading beyond ``limit`` in size, and the largest size."""
    peaks = df.groupBy(*key, "dim").agg(F.max(F.abs("v")).alias("peak")).where(F.col("peak") > limit)
    return peaks.groupBy(*key).agg(F.array_join(F.sort_array(F.collect_set("dim")), ",").alias("dims"), F.max("peak").alias("largest"))


def masked_mean(error: Column, mask: Column) -> Column:
    """Mean of the errors under the mask; a mask without any row counts as one row."""
    return F.sum(error * mask) / F.greatest(F.sum(mask), F.lit(1.0))

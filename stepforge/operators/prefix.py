"""Running totals over groups of any size, without one task per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ids that share one block; the most rows that a task sorts at a time.
BLOCK = 1 << 16


def id_block(id_column: str | Column, width: int = BLOCK) -> Column:
    """Block number of a unique integer id; a block has at most ``width`` rows."""
    # Whole numbers, for a double can't tell large ids apart.
    n = (F.col(id_column) if isinstance(id_column, str) else id_column).cast("bigint")
    return F.floor((n - F.pmod(n, F.lit(width))) / F.lit(width)).cast("bigint")


#: Blocks that are added up by one task at a time, at each of the levels above the rows.
FAN = 1 << 20
LEVELS = 2


def running_total(
    df: DataFrame, group: Sequence[str], block: Column, order: Sequence[Column], value: str, out: str, fan: int = FAN, levels: int = LEVELS
) -> DataFrame:
    """Add ``out``: the sum of the integer column ``value`` over all rows of the group before this one.

    Rows of a group are ordered by (``block``, ``order``). Block totals are
    pre-aggregated and summed first, then each block is summed by itself, so a
    group that holds a third of all rows is spread over as many tasks as it has
    blocks. Blocks are summed in the same way: ``fan`` neighbours at a time below the totals of these, for ``levels``
    levels. With the defaults a task sums at most 2 ** 20 blocks even if ids are spread over all 64-bit numbers, so
    that each row is a block of its own. The order must be total within a block, else ties are broken at will.

    Nulls: a null group value is a group of its own; a null ``value`` counts as 0.
    An empty input gives an empty result. The columns ``_group`` and ``_block`` are
    used inside and must not exist.
    """
    rows = df.withColumn("_group", F.struct(*group)).withColumn("_block", F.coalesce(block, F.lit(0).cast("bigint")))
    amount = F.coalesce(F.col(value), F.lit(0)).cast("bigint")
    totals = rows.groupBy("_group", "_block").agg(F.sum(amount).alias("_total"))
    before_row = Window.partitionBy("_group", "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.join(_bases(totals, fan, levels), ["_group", "_block"])
        .withColumn(out, F.col("_base") + F.coalesce(F.sum(amount).over(before_row), F.lit(0)))
        .drop("_group", "_block", "_base")
    )


def _bases(totals: DataFrame, fan: int, levels: int) -> DataFrame:
    """(_group, _block, _base): the total of the group's blocks before each one."""
    before = lambda *by: Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    if not levels:
        return totals.withColumn("_base", F.coalesce(F.sum("_total").over(before("_group")), F.lit(0))).drop("_total")
    above = F.floor(F.col("_block") / F.lit(float(fan))).cast("bigint")
    parts = totals.withColumn("_above", above)
    upper = parts.groupBy("_group", F.col("_above").alias("_block")).agg(F.sum("_total").alias("_total"))
    bases = _bases(upper, fan, levels - 1).select("_group", F.col("_block").alias("_above"), F.col("_base").alias("_start"))
    inner = parts.withColumn("_inner", F.coalesce(F.sum("_total").over(before("_group", "_above")), F.lit(0)))
    return inner.join(bases, ["_group", "_above"]).select("_group", "_block", (F.col("_start") + F.col("_inner")).alias("_base"))

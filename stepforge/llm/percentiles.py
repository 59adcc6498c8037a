"""Exact percentiles of very large columns by bisection, and mergeable states with bounded error."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepforge.session import durable

#: Parts into which a pass cuts each interval: as many as four halvings.
CELLS = 16
#: Most intervals (groups times percentiles) that are sent to every task; more are joined by a shuffle.
MAX_INTERVALS = 1_000_000
#: Parts over which the rows of a group are spread in that shuffle.
SPREAD = 64
#: Cells of a state to each doubling of the value: an error of at most 2 ** (1 / 128) - 1 = 0.54%.
STATE_CELLS = 64
_SHIFT = 100
#: Where infinite values are; the scaled finite ones lie within 780.
_FAR = 800.0


def scale(value: Column) -> Column:
    """A monotone function of a finite double: signed logarithm, linear next to 0."""
    size = F.abs(value)
    log = F.when(size > 1, F.ln(size) + F.lit(_SHIFT * math.log(2))).otherwise(F.log1p(size * F.lit(2.0**_SHIFT)))
    return F.signum(value) * log


def long_values(stats: DataFrame, arrays: Sequence[str], width: str, group: Sequence[str]) -> DataFrame:
    """(group..., stat, dim, v): the elements of array columns below the row's ``width``; nulls and NaN are left out.

    Null arrays have no values; elements at or beyond ``width`` don't count, nor do rows with a null
    width. Infinite values are values: they rank first or last. -0.0 is 0.0.
    """
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("stat"), F.col(a).alias("x")) for a in arrays]))
    rows = stats.select(*group, F.col(width).alias("_width"), each.alias("_s"))
    rows = rows.select(*group, "_width", F.col("_s.stat").alias("stat"), F.posexplode("_s.x").alias("dim", "v"))
    return rows.where((F.col("dim") < F.col("_width")) & F.col("v").isNotNull() & ~F.isnan("v")).select(
        *group, "stat", "dim", (F.col("v").cast("double") + F.lit(0.0)).alias("v")
    )


def _rank(n: Column, p: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(n * p)).cast("bigint")


def _cell(cells: int) -> Column:
    """The part of its interval in which a value lies; an interval with two values always has two parts with rows.

    Parts are even in the scaled value while that tells values apart, then in the value itself, halved so that no range overflows.
    """
    scaled = (F.col("_x") - F.col("x0")) / (F.col("x1") - F.col("x0"))
    plain = (F.col("v") / 2 - F.col("v0") / 2) / (F.col("v1") / 2 - F.col("v0") / 2)
    return F.least(F.floor(F.when(F.col("x1") > F.col("x0"), scaled).otherwise(plain) * cells), F.lit(cells - 1))


def exact_percentiles(values: DataFrame, group: Sequence[str], percentiles: Sequence[float], cells: int = CELLS) -> DataFrame:
    """(group..., p, n, value): for each p the value of rank max(1, ceil(p * n)), exactly.

    ``values`` has the group columns and v. An interval of values is kept per group and percentile. A pass counts the rows
    below ``cells`` - 1 points inside each interval, with partial aggregation, and keeps the part that
    holds the wanted rank, cut to the values that it has; passes go on until each interval holds one value. No
    rows are ranked, and only counts are shuffled. Percentiles of one group that have one interval are counted
    together. Up to MAX_INTERVALS intervals are broadcast; more are joined by a shuffle that spreads each group's rows.

    Null group values form groups. Null and NaN values must be left out before. Groups without rows and
    an empty input give no rows.
    """
    finite = F.abs("v") < F.lit(float("inf"))
    keyed = values.select(F.struct(*group).alias("_g"), "v").withColumn(
        "_x", F.when(finite, scale(F.col("v"))).when(F.col("v") > 0, F.lit(_FAR)).otherwise(F.lit(-_FAR))
    )
    ends = keyed.groupBy("_g").agg(
        F.count(F.lit(1)).alias("n"), F.min("_x").alias("x0"), F.max("_x").alias("x1"), F.min("v").alias("v0"), F.max("v").alias("v1")
    )
    ps = F.explode(F.array(*[F.lit(float(p)) for p in percentiles])).alias("p")
    interval = ["x0", "x1", "v0", "v1"]
    # below: rows under the interval.
    state = durable(
        ends.select("_g", "n", *interval, ps).select(
            "_g", "p", "n", _rank(F.col("n"), F.col("p")).alias("rank"), *interval, F.lit(0).cast("bigint").alias("below")
        )
    )
    while True:
        # An interval with two values has ends that differ.
        open_ones = state.where(F.col("v1") > F.col("v0"))
        n_open = open_ones.limit(MAX_INTERVALS + 1).count()
        if not n_open:
            break
        parts = open_ones.groupBy("_g", *interval).agg(F.first("below").alias("below"))
        counts = (
            _beside(keyed, parts, n_open <= MAX_INTERVALS)
            .where((F.col("v") >= F.col("v0")) & (F.col("v") <= F.col("v1")))
            .groupBy("_g", *interval, "below", _cell(cells).alias("_cell"))
            .agg(F.count(F.lit(1)).alias("m"), F.min("_x").alias("a0"), F.max("_x").alias("a1"), F.min("v").alias("b0"), F.max("v").alias("b1"))
        )
        w = Window.partitionBy("_g", *interval).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
        placed = counts.withColumn("_under", F.col("below") + F.coalesce(F.sum("m").over(w), F.lit(0))).drop("below")
        narrowed = (
            open_ones.drop("below")
            .join(placed, ["_g", *interval])
            .where((F.col("rank") > F.col("_under")) & (F.col("rank") <= F.col("_under") + F.col("m")))
            .select("_g", "p", "n", "rank", F.col("a0").alias("x0"), F.col("a1").alias("x1"), F.col("b0").alias("v0"), F.col("b1").alias("v1"), F.col("_under").alias("below"))
        )
        state = durable(state.where(~(F.col("v1") > F.col("v0"))).unionByName(narrowed))
    return state.select(*[F.col("_g")[c].alias(c) for c in group], "p", "n", F.col("v0").alias("value"))


def _beside(keyed: DataFrame, parts: DataFrame, small: bool) -> DataFrame:
    """Each row with the intervals of its group."""
    if small:
        return keyed.join(F.broadcast(parts), "_g")
    spread = parts.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    return keyed.withColumn("_part", F.pmod(F.xxhash64("v"), F.lit(SPREAD)).cast("int")).join(spread, ["_g", "_part"]).drop("_part")


# ---------------------------------------------------------------- mergeable states


def state_cells(values: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group..., cell, n): counts on a fixed logarithmic grid; states of parts of the data are merged by adding n."""
    x = scale(F.col("v")) / F.lit(math.log(2) / STATE_CELLS)
    limit = 1 << 30
    cell = F.when(F.abs("v") < F.lit(float("inf")), F.floor(x)).when(F.col("v") > 0, F.lit(limit)).otherwise(F.lit(-limit))
    return values.groupBy(*group, cell.cast("int").alias("cell")).agg(F.count(F.lit(1)).alias("n"))


def merge_states(states: DataFrame, group: Sequence[str]) -> DataFrame:
    """The state of all rows of several states, by group."""
    return states.groupBy(*group, "cell").agg(F.sum("n").alias("n"))


def state_percentiles(states: DataFrame, group: Sequence[str], percentiles: Sequence[float]) -> DataFrame:
    """(group..., p, n, value): percentiles of a merged state.

    The value is the middle of the cell that holds the wanted rank: it is within 0.54% of the exact
    percentile (in absolute terms 2**-100 next to 0). Infinite cells give infinite values.
    """
    w = Window.partitionBy(*group)
    upto = states.withColumn("_upto", F.sum("n").over(w.orderBy("cell"))).withColumn("_all", F.sum("n").over(w))
    wanted = upto.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in percentiles])))
    rank = _rank(F.col("_all"), F.col("p"))
    x = (F.col("cell") + 0.5) * F.lit(math.log(2) / STATE_CELLS)
    size = F.when(F.abs(x) > _SHIFT * math.log(2), F.exp(F.abs(x) - F.lit(_SHIFT * math.log(2)))).otherwise(
        F.expm1(F.abs(x)) * F.lit(2.0**-_SHIFT)
    )
    limit = 1 << 30
    value = (
        F.when(F.col("cell") == limit, F.lit(float("inf")))
        .when(F.col("cell") == -limit, F.lit(float("-inf")))
        .otherwise(F.signum(x) * size)
    )
    return wanted.where((rank > F.col("_upto") - F.col("n")) & (rank <= F.col("_upto"))).select(
        *group, "p", F.col("_all").alias("n"), value.alias("value")
    )

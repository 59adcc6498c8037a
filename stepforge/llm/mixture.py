"""Mixing sources to target shares of the total size by systematic sampling."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepforge.operators.prefix import id_block, running_total

#: Expected copies are whole numbers of this unit, so that running totals are exact.
UNIT = 1 << 30
#: Most sources; their rates are sent to every task.
MAX_SOURCES = 100_000


@dataclass(frozen=True)
class Source:
    """A source's plan: what it holds, what it shall give, and the expected copies of each item."""

    name: str
    weight: float
    max_repeats: int
    size: int
    target_share: float
    target_size: float
    rate: int

    def offset(self, seed: int) -> int:
        """The source's random start, below UNIT."""
        return int(hashlib.md5(f"{seed}|{self.name}".encode()).hexdigest()[:8], 16) // 4


def distinct_items(items: DataFrame, key: str, source: str, size: str, version: str) -> DataFrame:
    """One row (key, source, size) per key: the latest version that has a positive size.

    Null keys and sources, and keys without any positive size, are left out: they can't be weighed.
    """
    usable = items.where(F.col(key).isNotNull() & F.col(source).isNotNull() & (F.col(size) > 0))
    return (
        usable.groupBy(key)
        .agg(F.max_by(F.struct(source, size), F.struct(version, size, source)).alias("_latest"))
        .select(key, F.col("_latest")[source].alias(source), F.col("_latest")[size].cast("bigint").alias(size))
    )


def plan_sources(
    items: DataFrame, sources: DataFrame, source: str, size: str, total: float | None = None
) -> list[Source]:
    """Target sizes of the sources (names, weights, max_repeats).

    Weights are relative; null or non-positive ones, and sources without items, get nothing, and
    the shares of the others are theirs among the rest. ``total`` is the wanted size; None: the
    largest at which every source can reach its share within max_repeats (null: 1). With a given
    total a source gives at most max_repeats times its size, and falls short of its share.
    """
    wanted = sources.select("names", "weights", "max_repeats").limit(MAX_SOURCES + 1).collect()
    if len(wanted) > MAX_SOURCES:
        raise ValueError("too many sources")
    if len({w.names for w in wanted}) < len(wanted):
        raise ValueError("a source has two weights")
    usable = {w.names: w for w in wanted if w.names is not None and w.weights is not None and w.weights > 0}
    held = {
        r[source]: int(r["n"])
        for r in items.where(F.col(source).isin(sorted(usable))).groupBy(source).agg(F.sum(size).alias("n")).collect()
    }
    usable = {n: usable[n] for n in sorted(usable) if held.get(n)}
    if not usable:
        return []
    weight = sum(w.weights for w in usable.values())
    repeats = {n: 1 if w.max_repeats is None else max(0, w.max_repeats) for n, w in usable.items()}
    share = {n: w.weights / weight for n, w in usable.items()}
    if total is None:
        total = min(repeats[n] * held[n] / share[n] for n in usable)
    plans = []
    for n, w in usable.items():
        target = total * share[n]
        rate = min(int(target / held[n] * UNIT + 0.5), repeats[n] * UNIT)
        plans.append(Source(n, w.weights, repeats[n], held[n], share[n], target, rate))
    return plans


def mix(items: DataFrame, plans: list[Source], key: str, source: str, size: str, seed: int = 0) -> DataFrame:
    """(key, source, size, copy_no): an item once per integer boundary that its expected copies cross.

    Within a source the expected copies of the items before it are added up (in blocks of ids,
    longest items first, so that the sizes taken are even) and one random offset is added; an item is
    emitted once for each whole number between its own start and end. So an item's copies differ
    from their expectation by less than one and never pass max_repeats.

    Items need unique integer keys (distinct_items). No plans or no items give no rows.
    """
    spark = items.sparkSession
    rates = spark.createDataFrame(
        [(p.name, p.rate, p.offset(seed)) for p in plans], f"`{source}` string, _rate bigint, _offset bigint"
    )
    rated = items.join(F.broadcast(rates), source)
    placed = running_total(rated, [source], id_block(key), [F.col(size).desc(), F.col(key)], "_rate", "_before")
    copies = F.expr(f"(_before + _offset + _rate) div {UNIT} - (_before + _offset) div {UNIT}")
    return (
        placed.withColumn("_copies", copies)
        .where("_copies > 0")
        .select(key, source, size, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_copies"))).alias("copy_no"))
    )


def mixture_report(mixed: DataFrame, plans: list[Source], source: str, size: str) -> DataFrame:
    """Per planned source: size held, target and reached size and share, and the most copies of an item."""
    spark = mixed.sparkSession
    planned = spark.createDataFrame(
        [(p.name, p.max_repeats, p.size, p.target_share, p.target_size) for p in plans],
        f"`{source}` string, max_repeats int, held bigint, target_share double, target_size double",
    )
    reached = mixed.groupBy(source).agg(
        F.count(F.lit(1)).alias("n_items"), F.sum(size).alias("reached_size"), F.max("copy_no").alias("most_copies")
    )
    # One row per planned source, of which there are at most MAX_SOURCES.
    whole = F.sum("reached_size").over(Window.partitionBy())
    return (
        planned.join(reached, source, "left")
        .withColumn("_whole", whole)
        .select(
            source, "max_repeats", "held", "target_share", "target_size",
            F.coalesce("n_items", F.lit(0)).cast("bigint").alias("n_items"),
            F.coalesce("reached_size", F.lit(0)).cast("bigint").alias("reached_size"),
            (F.coalesce("reached_size", F.lit(0)) / F.col("_whole")).alias("reached_share"),
            F.coalesce("most_copies", F.lit(0)).cast("bigint").alias("most_copies"),
        )
    )

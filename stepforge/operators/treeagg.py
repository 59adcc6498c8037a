"""Per-key results by multi-level tree aggregation."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: States that one reducer merges per key and round.
FAN_IN = 32


def tree_aggregate(
    df: DataFrame,
    key: str,
    entity: str | None,
    first: Mapping[str, Column],
    merge: Mapping[str, Callable[[str], Column]],
    entities: str = "n_entities",
    fan_in: int = FAN_IN,
    rounds: int | None = None,
) -> DataFrame:
    """One row per ``key`` with merged states and, unless ``entity`` is None, the exact number of its distinct ``entity`` values.

    Leaves are the input's chunks: each partition, a fixed number of bytes of the scan, combines its own rows of a key
    into one state. Then rounds merge at most ``fan_in`` states of a key each, as many rounds as the
    logarithm of the number of chunks says, so no reducer receives all partial states of a key. Entities are
    made distinct first, spread by both values, and counted by slots that join the same rounds.

    ``first`` makes a state column from rows, ``merge`` says how two states become one
    (a function of the column's name). A null key is a key; null entities are not counted.
    No rows give no rows.
    """
    if rounds is None:
        rounds = max(1, math.ceil(math.log(max(2, df.rdd.getNumPartitions())) / math.log(fan_in)))
    slots = fan_in**rounds
    chunks = df.withColumn("_slot", F.pmod(F.spark_partition_id(), F.lit(slots)).cast("bigint"))
    states = chunks.groupBy(key, "_slot").agg(*[c.alias(n) for n, c in first.items()])
    merged = dict(merge)
    if entity is not None:
        distinct = df.where(F.col(entity).isNotNull()).select(key, entity).distinct()
        slot = F.pmod(F.xxhash64(entity), F.lit(slots)).alias("_slot")
        counted = distinct.groupBy(key, slot).agg(F.count(F.lit(1)).alias(entities))
        states = states.withColumn(entities, F.lit(0).cast("bigint")).unionByName(counted, allowMissingColumns=True)
        merged[entities] = F.sum
    for _ in range(rounds - 1):
        states = states.withColumn("_slot", F.floor(F.col("_slot") / fan_in)).groupBy(key, "_slot").agg(*[fn(n).alias(n) for n, fn in merged.items()])
    return states.groupBy(key).agg(*[fn(n).alias(n) for n, fn in merged.items()])


def finite(value: Column) -> Column:
    """The value, or null if it is not a finite number."""
    return F.when(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), value)


def key_extremes(
    df: DataFrame, key: str, entity: str | None, signals: Sequence[str], width: int, fan_in: int = FAN_IN, rounds: int | None = None
) -> DataFrame:
    """Rows, entities (unless ``entity`` is None) and per-dimension finite minimum and maximum of array ``signals`` of each key.

    Columns: key, n_rows, n_entities, and for each signal and dimension below ``width``
    ``{signal}_min_{i}`` and ``{signal}_max_{i}`` (null where no finite reading exists). Unused
    columns are pruned by the planner. Repeated rows count in n_rows, as they are stored.
    """
    first: dict[str, Column] = {"n_rows": F.count(F.lit(1))}
    merge: dict[str, Callable[[str], Column]] = {"n_rows": F.sum}
    for signal in signals:
        for i in range(width):
            reading = finite(F.get(F.col(signal), F.lit(i)).cast("double"))
            for what, fn in (("min", F.min), ("max", F.max)):
                first[f"{signal}_{what}_{i}"] = fn(reading)
                merge[f"{signal}_{what}_{i}"] = fn
    return tree_aggregate(df, key, entity, first, merge, fan_in=fan_in, rounds=rounds)

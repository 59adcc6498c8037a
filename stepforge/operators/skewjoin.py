"""Joins of rows with per-key figures where one key may hold a third of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it holds at least this part of the rows; so there are at most 1 / HOT_SHARE hot keys.
HOT_SHARE = 1 / 2000


def lookup_by_key(rows: DataFrame, keyed: DataFrame, key: str, size: str, spread: str, n_rows: int) -> DataFrame:
    """Left join of ``rows`` with ``keyed`` (unique ``key``; ``size``: how many rows have that key).

    Hot keys, at most 1 / HOT_SHARE of them by their share of ``n_rows``, come by broadcast; the
    rest by a shuffle on the key, in which the rows that are already served are spread by the
    column ``spread``. So no task gets all rows of a hot key, and ``rows`` is read once.

    A null key finds nothing. The other columns of ``keyed`` are added, null where nothing was found;
    they must not be columns of ``rows``.
    """
    values = [c for c in keyed.columns if c != key]
    least = max(1, int(n_rows * HOT_SHARE))
    packed = keyed.select(F.col(key), F.col(size).alias("_size"), F.struct(*values).alias("_v"))
    hot = packed.where(F.col("_size") > least).select(F.col(key), F.col("_v").alias("_hot"))
    cold = packed.where(F.col("_size") <= least).select(
        F.lit(True).alias("_open"), F.col(key).alias("_key"), F.col("_v").alias("_cold"), F.lit(0).cast("bigint").alias("_spread")
    )
    served = rows.join(F.broadcast(hot), key, "left").withColumn("_open", F.col("_hot").isNull() & F.col(key).isNotNull())
    served = served.withColumn("_spread", F.when(F.col("_open"), F.lit(0)).otherwise(F.xxhash64(spread)).cast("bigint"))
    found = served.join(
        cold,
        (served[key] == cold["_key"]) & (served["_spread"] == cold["_spread"]) & (served["_open"] == cold["_open"]),
        "left",
    )
    value = F.coalesce("_hot", "_cold")
    kept = [served[c] for c in rows.columns]
    return found.select(*kept, *[value[c].alias(c) for c in values])

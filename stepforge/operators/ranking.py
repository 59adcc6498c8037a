"""Ranks within groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepforge.operators.prefix import BLOCK, id_block, running_total


def ranked(df: DataFrame, group: Sequence[str], position: Column, order: Sequence[Column], out: str, width: int = BLOCK) -> DataFrame:
    """Add ``out``: the place (from 1) of each row in its group, ordered by (``position``, ``order``).

    ``position`` is an integer that leads the order; rows are ranked in blocks of ``width`` of its
    values, so a group is one task's work only if its rows share few positions. A null position comes first.
    Ties in the whole order are broken at will.
    """
    block = F.coalesce(id_block(position, width), F.lit(-(1 << 62)))
    counted = running_total(df.withColumn("_one", F.lit(1).cast("bigint")), group, block, [position, *order], "_one", "_before")
    return counted.withColumn(out, F.col("_before") + 1).drop("_one", "_before")

"""Matching of episode files by key: complete episodes, pending work, upserts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepforge.operators.ranking import ranked


def complete_keys(files: DataFrame, key: Sequence[str], kind: str, required: Sequence[str]) -> DataFrame:
    """Keys that have a file of every required kind.

    One aggregation with a flag per kind instead of a join per kind; the flags are combined on the map side,
    so repeated listings cost nothing.
    """
    flags = [F.max(F.col(kind) == k).alias(f"_has{i}") for i, k in enumerate(required)]
    have = files.where(F.col(kind).isin(*required)).groupBy(*key).agg(*flags)
    for i in range(len(required)):
        have = have.where(f"_has{i}")
    return have.select(*key)


def pending(wanted: DataFrame, existing: DataFrame, key: Sequence[str], overwrite: bool = False) -> DataFrame:
    """Rows of ``wanted`` without a counterpart in ``existing``; all of them with ``overwrite``. Null keys are never done."""
    return wanted if overwrite else wanted.join(existing.select(*key), list(key), "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Old and new rows by key; where both have one, the new values count unless they are null.

    Keys are expected to be unique on each side; null keys match nothing and are kept.
    """
    renamed = new.select(*key, *[F.col(v).alias(f"_new_{v}") for v in values])
    joined = old.join(renamed, list(key), "full_outer")
    return joined.select(*key, *[F.coalesce(f"_new_{v}", v).alias(v) for v in values])


def replace_groups(old: DataFrame, new: DataFrame, group: Sequence[str]) -> DataFrame:
    """Old rows whose group ``new`` doesn't have, and all rows of ``new``: a group is replaced as a whole. Null groups replace nothing."""
    return old.join(new.select(*group).distinct(), list(group), "left_anti").unionByName(new)


def patch(old: DataFrame, new: DataFrame, key: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Old rows with the values that ``new`` has for them; new keys aren't added."""
    renamed = new.select(*key, *[F.col(v).alias(f"_new_{v}") for v in values])
    kept = [c for c in old.columns if c not in values]
    return old.join(renamed, list(key), "left").select(*kept, *[F.coalesce(f"_new_{v}", v).alias(v) for v in values])


def path_parts(path: Column) -> dict[str, Column]:
    """dataset, split, task, kind, stem and ending of root/dataset/split/task/kind/name.ending."""
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    return {
        "dataset": F.try_element_at(parts, F.lit(-5)),
        "split": F.try_element_at(parts, F.lit(-4)),
        "task": F.try_element_at(parts, F.lit(-3)),
        "kind": F.try_element_at(parts, F.lit(-2)),
        "stem": F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1),
        "ending": F.regexp_extract(name, r"\.([^.]*)$", 1),
    }


def subset_of(folder: Column, mapping: Mapping[str, str]) -> Column:
    """The subset that ``mapping`` gives a folder, else the one in its name, else null."""
    low = F.lower(folder)
    named = F.when(low.contains("clean"), F.lit("clean")).when(low.contains("randomized"), F.lit("randomized"))
    out = named
    for name, subset in mapping.items():
        out = F.when(folder == name, F.lit(subset)).otherwise(out)
    return out


def aligned(left: DataFrame, right: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """(keys, row, qpos_{order}, epos_{order}): the n-th row of one signal with the n-th of the other; what is over is trimmed.

    Rows are numbered in blocks, so a recording of any length is spread.
    """
    sides = []
    for df, name in ((left, f"qpos_{order}"), (right, f"epos_{order}")):
        placed = ranked(df, list(keys), F.col(order), [F.col(order)], "row")
        sides.append(placed.select(*keys, "row", F.col(order).alias(name)))
    return sides[0].join(sides[1], [*keys, "row"])


def misaligned(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n_left, n_right) where the two signals differ in length; one that is missing has length 0."""
    both = left.select(*keys, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(right.select(*keys, F.lit(0).alias("_l"), F.lit(1).alias("_r")))
    return both.groupBy(*keys).agg(F.sum("_l").alias("n_left"), F.sum("_r").alias("n_right")).where("n_left <> n_right")

"""Deterministic sampling, padding and batching of samples."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, key: Column) -> Column:
    """A number in [0, 1) that depends only on the seed and the key."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def pad_last(values: Column, width: int, fill: Column) -> Column:
    """An array filled up to ``width``; a longer one raises an error, null stays null."""
    error = F.raise_error(F.concat(F.lit("more than "), F.lit(str(width)), F.lit(" values")))
    padded = F.concat(values, F.array_repeat(fill, F.lit(width) - F.size(values)))
    return F.when(values.isNull(), values).when(F.size(values) > width, error.cast("array<double>")).otherwise(padded)


def pad_truncate(values: Column, width: int, fill: Column) -> Column:
    """An array cut or filled to ``width``."""
    cut = F.slice(values, 1, width)
    return F.concat(cut, F.array_repeat(fill, F.greatest(F.lit(width) - F.size(cut), F.lit(0))))


def labels_of(ids: Column, mask: Column, answer: Column, ignored: int = -100) -> Column:
    """Ids from the answer's start on, where the mask is set; ``ignored`` elsewhere."""
    return F.transform(ids, lambda x, i: F.when((i >= answer) & (F.get(mask, i) == 1), x).otherwise(F.lit(ignored)))


def visible_length(answer: Column, mask_sum: Column, length: Column) -> Column:
    """Tokens before the answer that aren't masked: between 1 and ``length``."""
    return F.greatest(F.lit(1), F.least(answer, mask_sum, length))


def contiguous_chunk(rank: Column, total: Column, parts: int) -> Column:
    """The part of a row (rank from 0) when ``total`` rows are cut into slices of equal size."""
    return F.floor(rank / F.ceil(total / F.lit(float(parts))))


def pad_tokens(ids: Column, length: Column, prompt: Column) -> tuple[Column, Column, Column]:
    """Ids padded to ``length`` with 0, their mask with 0, and labels with -100, which the first ``prompt`` tokens have as well."""
    n = F.size(ids)
    fill = lambda x: F.array_repeat(x, length - n)
    labels = F.transform(ids, lambda x, i: F.when(i >= prompt, x).otherwise(F.lit(-100)).cast("bigint"))
    return (
        F.concat(ids, fill(F.lit(0).cast("bigint"))),
        F.concat(F.transform(ids, lambda x: F.lit(1)), fill(F.lit(0))),
        F.concat(labels, fill(F.lit(-100).cast("bigint"))),
    )

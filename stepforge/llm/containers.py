"""Filling containers of a fixed number of tokens, by the configuration linear program of the lengths.

Only the length histogram, which has at most as many entries as a container has tokens, is
solved: multiplicative weights on the lengths, with patterns priced by knapsack dynamic
programming. The fractional pattern counts are rounded, what is left is packed by patterns that
fill a container best, and texts are dealt to the slots of their length by rank.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepforge.operators.prefix import id_block, running_total
from stepforge.session import durable

#: Vocabulary whose tokens are counted.
TOKENIZER = os.environ.get("STEPFORGE_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")


# Fixed value: how the byte-level vocabulary splits a text into words.
WORDS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


@lru_cache(maxsize=4)
def _counter(path: str) -> Callable[[list[str]], list[int]]:
    """A function that counts the tokens of texts, by the kind of vocabulary file; loaded once a worker."""
    if path.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, file)}
        own = tiktoken.Encoding("own", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(own.encode_ordinary(t)) for t in texts]
    if path.endswith(".json"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        return lambda texts: [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    from sentencepiece import SentencePieceProcessor

    pieces = SentencePieceProcessor(model_file=path)
    return lambda texts: [len(x) for x in pieces.encode(texts, num_threads=1)]


def _count_tokens(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    count = _counter(path)
    for batch in batches:
        texts = batch.column(1).to_pylist()
        sizes: list[int] = []
        for at in range(0, len(texts), 256):
            sizes += count([t or "" for t in texts[at : at + 256]])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["doc_id", "n_all"])


def token_counts(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_all): tokens of each text, 0 for null and empty ones."""
    return documents.select("doc_id", "text").mapInArrow(lambda it: _count_tokens(it, path), "doc_id bigint, n_all bigint")


# ---------------------------------------------------------------- the linear program


@dataclass(frozen=True)
class Pattern:
    """A way to fill a container: how many pieces of each length, and how many containers have it."""

    counts: tuple[tuple[int, int], ...]
    times: int


def _knapsack(prices: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Greatest total price within each room up to the capacity, and the place of the last length taken there (-1: none).

    Lengths may be repeated. The work is the capacity times the number of distinct lengths.
    """
    best = np.zeros(capacity + 1)
    take = np.full(capacity + 1, -1)
    fit = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if fit[c]:
            options = best[c - lengths[: fit[c]]] + prices[: fit[c]]
            k = int(options.argmax())
            if options[k] > best[c]:
                best[c], take[c] = options[k], k
    return best, take


def _filling(take: np.ndarray, lengths: np.ndarray, room: int) -> dict[int, int]:
    """Places of the lengths that the knapsack puts into a room, and how often."""
    out: dict[int, int] = {}
    while room > 0:
        k = int(take[room])
        if k < 0:
            room -= 1
        else:
            out[k] = out.get(k, 0) + 1
            room -= int(lengths[k])
    return out


@dataclass(frozen=True)
class Steps:
    """Steps of the linear program: the levels to which all lengths are covered one after the other, the price updates
    for each, the rate of the weights, and the part of a level by which a length may be covered beyond it."""

    levels: int = 3
    updates: int = 200
    rate: float = 0.5
    beyond: float = 0.5


def fractional(counts: np.ndarray, capacity: int, steps: Steps = Steps()) -> tuple[dict[tuple, float], float]:
    """Multiplicative weights: pattern amounts that cover every length fully, and the dual bound of containers.

    A length's price is its part of the capacity, which is nearly the dual optimum, times an exponential weight of how far it
    is covered beyond the level that is to be reached; one that is covered as far as allowed costs nothing and is in no pattern.
    One knapsack table prices, for each length still below the level, the best pattern that has it; the pattern is
    used until the length is at the level or one of its members is too far beyond, then the weights change. Each
    price vector, divided by its best pattern, is a dual solution.
    """
    lengths = np.flatnonzero(counts) + 1
    n = counts[lengths - 1].astype(float)
    covered = np.zeros(len(lengths))
    x: dict[tuple, float] = {}
    bound = 0.0
    step = 1 / steps.levels
    for r in range(1, steps.levels + 1):
        level = r * step
        room = min(level + steps.beyond * step, 1.0) * n
        update = 0
        while (level * n - covered > 1e-9 * n).any():
            update += 1
            price = lengths / capacity * np.exp(np.clip(-steps.rate * (covered / n - level) / step, -50, 2))
            price[covered >= room - 1e-9 * n] = 0.0
            best, take = _knapsack(price, lengths, capacity)
            bound = max(bound, float((price * n).sum() / best[capacity]))
            missing = level * n - covered
            for v in np.argsort(-missing * price, kind="stable"):
                wanted = level * n[v] - covered[v]
                if wanted <= 1e-9 * n[v]:
                    continue
                pattern = _filling(take, lengths, capacity - int(lengths[v]))
                pattern[int(v)] = pattern.get(int(v), 0) + 1
                amount = min(wanted / pattern[int(v)], *((room[k] - covered[k]) / m for k, m in pattern.items()))
                # Small moves wait for other prices, until there have been many.
                if amount <= (0.02 * wanted / pattern[int(v)] if update < steps.updates else 0):
                    continue
                for k, m in pattern.items():
                    covered[k] += amount * m
                key = tuple(sorted((int(lengths[k]), m) for k, m in pattern.items()))
                x[key] = x.get(key, 0.0) + amount
    return x, bound


def _best_fill(left: np.ndarray, capacity: int) -> dict[int, int]:
    """The longest length left and, below it, the lengths left that fill the rest best (each at most as often as left)."""
    top = int(np.flatnonzero(left)[-1]) + 1
    out = {top: 1}
    room = capacity - top
    while room > 0:
        remaining = left[:room].copy()
        for v, k in out.items():
            if v <= room:
                remaining[v - 1] -= k
        usable = np.flatnonzero(remaining > 0)
        if not len(usable):
            break
        # Whether two lengths fill the room exactly; else the longest that fits.
        small = usable + 1
        exact = np.isin(room - small, np.append(small, 0))
        twice = 2 * small == room
        exact &= ~twice | (remaining[small - 1] > 1)
        pick = int(small[np.flatnonzero(exact)[-1]]) if exact.any() else int(small[-1])
        out[pick] = out.get(pick, 0) + 1
        room -= pick
    return out


def solve(counts: np.ndarray, capacity: int, steps: Steps = Steps()) -> tuple[list[Pattern], float]:
    """Patterns that hold each length exactly as often as ``counts`` (index: length - 1) says, and a lower bound.

    Amounts of patterns that leave no room are rounded up, the longest lengths first, as far as pieces are left; those of others
    are rounded down to nothing, and what then remains is packed by patterns that fill a container best. The bound is the larger
    of the dual value and the total length over the capacity.
    """
    counts = np.asarray(counts, np.int64)
    left = counts.copy()
    patterns: list[Pattern] = []
    full = int(left[capacity - 1]) if len(left) >= capacity else 0
    if full:
        patterns.append(Pattern(((capacity, 1),), full))
        left[capacity - 1] = 0
    bound = full + float((left * (np.arange(len(left)) + 1)).sum() / capacity)
    if left.any():
        x, dual = fractional(left, capacity, steps)
        bound = max(bound, full + dual)
        for key, amount in sorted(x.items(), key=lambda p: (-p[0][-1][0], -p[1], p[0])):
            times = min([int(np.ceil(amount)), *(int(left[v - 1]) // k for v, k in key)])
            if times > 0 and sum(v * k for v, k in key) == capacity:
                patterns.append(Pattern(key, times))
                for v, k in key:
                    left[v - 1] -= times * k
    return patterns + _packed(left, capacity), bound


def _packed(left: np.ndarray, capacity: int) -> list[Pattern]:
    """Patterns that fill containers best, for all that is left."""
    left, patterns = left.copy(), []
    while left.any():
        fill = _best_fill(left, capacity)
        times = max(1, min(int(left[v - 1]) // k for v, k in fill.items()))
        patterns.append(Pattern(tuple(sorted(fill.items())), times))
        for v, k in fill.items():
            left[v - 1] -= times * k
    return patterns


# ---------------------------------------------------------------- dealing texts to slots


def _slots(patterns: list[Pattern]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: first rank, pieces a container, and first container of each pattern that has it."""
    out: dict[int, list[list[int]]] = {}
    container = 0
    for p in patterns:
        for length, k in p.counts:
            rows = out.setdefault(length, [])
            start = rows[-1][3] if rows else 0
            rows.append([start, k, container, start + k * p.times])
        container += p.times
    return {v: tuple(np.array([r[i] for r in rows], np.int64) for i in range(3)) for v, rows in out.items()}


def _deal(batches: Iterator[pa.RecordBatch], slots: dict) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.column("n_tokens").to_numpy()
        rank = batch.column("_rank").to_numpy()
        out = np.zeros(len(n), np.int64)
        for length in np.unique(n):
            chosen = n == length
            start, each, first = slots[int(length)]
            k = np.searchsorted(start, rank[chosen], side="right") - 1
            out[chosen] = first[k] + (rank[chosen] - start[k]) // each[k]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("piece"), batch.column("n_tokens"), pa.array(out)],
            ["doc_id", "piece", "n_tokens", "container_id"],
        )


def fill_containers(documents: DataFrame, capacity: int, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, piece, n_tokens, container_id): the container of each piece of each text.

    ``documents`` needs unique doc_id and text. A text of at most ``capacity`` tokens is one piece;
    a longer one has full pieces, which fill containers by themselves, and a rest; piece p starts
    at token p * capacity. Null and empty texts have one piece of 0 tokens and a null container. No container
    holds more than ``capacity`` tokens. No documents give no rows.

    Tokens are counted once and kept in the shared checkpoint folder. Ranks within a length are running
    totals over blocks of ids, so a length that a third of all texts has is spread over many tasks.
    """
    if capacity < 1:
        raise ValueError("a container holds at least one token")
    sizes = durable(token_counts(documents, path))
    whole, rest = F.floor(F.col("n_all") / capacity), F.col("n_all") % capacity
    histogram = sizes.agg(F.sum(whole)).first()[0] or 0
    counts = np.zeros(capacity, np.int64)
    counts[capacity - 1] = int(histogram)
    for r in sizes.where(rest > 0).groupBy(rest.alias("v")).agg(F.count(F.lit(1)).alias("n")).collect():
        counts[r.v - 1] += r.n
    slots = _slots(solve(counts, capacity)[0])
    last = F.when(rest > 0, whole).otherwise(F.greatest(whole - 1, F.lit(0)))
    pieces = sizes.select("doc_id", "n_all", F.explode(F.sequence(F.lit(0).cast("bigint"), last.cast("bigint"))).alias("piece"))
    pieces = pieces.withColumn("n_tokens", F.least(F.col("n_all") - F.col("piece") * capacity, F.lit(capacity)).cast("bigint"))
    held = pieces.where("n_tokens > 0").withColumn("_one", F.lit(1).cast("bigint"))
    ranked = running_total(held, ["n_tokens"], id_block("doc_id"), [F.col("doc_id"), F.col("piece")], "_one", "_rank")
    dealt = ranked.select("doc_id", "piece", "n_tokens", "_rank").mapInArrow(
        lambda it: _deal(it, slots), "doc_id bigint, piece bigint, n_tokens bigint, container_id bigint"
    )
    return dealt.unionByName(
        pieces.where("n_tokens = 0").select("doc_id", "piece", "n_tokens", F.lit(None).cast("bigint").alias("container_id"))
    )


def container_summary(assigned: DataFrame, capacity: int) -> DataFrame:
    """One row: pieces, tokens, containers, the fewest containers that could hold the tokens, and the part of the room used."""
    by = assigned.where(F.col("container_id").isNotNull()).groupBy("container_id").agg(
        F.count(F.lit(1)).alias("pieces"), F.sum("n_tokens").alias("used")
    )
    return by.agg(
        F.sum("pieces").alias("n_pieces"),
        F.sum("used").alias("n_tokens"),
        F.count(F.lit(1)).alias("n_containers"),
        F.ceil(F.sum("used") / capacity).alias("least_containers"),
        F.max("used").alias("fullest"),
        (F.sum("used") / (F.count(F.lit(1)) * F.lit(capacity))).alias("used_part"),
    )

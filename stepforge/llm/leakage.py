"""Evaluation items that leaked into documents, by a prefix-filtered join on word shingles.

One pass over the texts emits the shingles that some item has. Their frequency over all documents
orders the shingles of each item by rarity; only the rarest ones, the item's prefix, are joined with
the documents, and a document that shares too few of them is no candidate. Candidates are held
against length and positional bounds and verified by aligning the item with item-sized bands of
the document.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepforge.operators.skewjoin import lookup_by_key
from stepforge.session import durable


@dataclass(frozen=True)
class LeakRules:
    """What counts as leaked; defaults follow the problem's statement."""

    shingle: int = 5
    #: Part of the item's own words that must stand in the document, in at most two passages.
    part: float = 0.5
    #: Cost of a changed, added or missing word in an alignment, in matched words.
    edit_cost: int = 6
    #: Most edits to each word of a passage.
    edits: float = 0.14
    #: Shortest passage, in words; items of fewer than four times as many own words need a quarter of these.
    passage: int = 8
    #: A run of so many words of an item that so many items share is a preamble, not content.
    preamble: int = 18
    preamble_items: int = 3
    #: Part of the shingles that a leak must share which must be in the prefix. Near 0 gives the shortest prefix,
    #: 1 all shingles; a longer one joins more rows and leaves fewer candidates.
    overlap: float = 0.75


#: Words of items whose shingles are looked for in one pass over the documents.
BLOCK_WORDS = 2_000_000
#: Most rows of prefixes and most candidates that are joined by broadcast; more are shuffled.
BROADCAST_ROWS = 1_000_000

# A tag begins with a letter, a slash or a sign of declarations; "a < b" is text.
_MARKUP = re.compile(r"<[A-Za-z/!?][^<>]*>|&[a-zA-Z]{2,8};|&#\d{1,6};")
_WORD = re.compile(r"[^\W_]+", re.UNICODE)


def item_words(text: str) -> list[str]:
    """Words without case, punctuation, line breaks and markup."""
    if "<" in text or "&" in text:
        text = _MARKUP.sub(lambda m: " " if m.group()[0] == "<" else html.unescape(m.group()), text)
    return _WORD.findall(text.casefold())


#: Distinct words whose numbers a task keeps at hand.
_KNOWN_WORDS = 300_000
_numbers: dict[str, int] = {}


def word_numbers(words: list[str]) -> np.ndarray:
    """A 64-bit number of each word, the same in every task; never 0."""
    if len(_numbers) > _KNOWN_WORDS:
        _numbers.clear()
    out = []
    for w in words:
        n = _numbers.get(w)
        if n is None:
            n = _numbers[w] = xxhash.xxh64_intdigest(w) | 1
        out.append(n)
    return np.array(out, np.uint64)


_BASE = np.uint64(0x9E3779B97F4A7C15)


def _codes(ids: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit number of each shingle of word numbers; none in a text shorter than a shingle.

    Equal numbers of different shingles, if there are any, only make candidates that alignment drops.
    """
    if len(ids) < width or not width:
        return np.empty(0, np.int64)
    code = np.full(len(ids) - width + 1, width, np.uint64)
    for k in range(width):
        code = (code ^ ids[k : len(ids) - width + 1 + k]) * _BASE
        code ^= code >> np.uint64(29)
    return code.view(np.int64)


class Item:
    """An item's words, which of them are its own, and its shingles that touch own words, with their places."""

    def __init__(self, ids: np.ndarray, shared: list[int], rules: LeakRules) -> None:
        self.ids = ids
        own = np.ones(len(ids), bool)
        for at in shared:
            own[at : at + rules.preamble] = False
        self.own = own if own.any() else np.ones(len(ids), bool)
        #: An item shorter than a shingle is one shingle as a whole.
        self.width = min(rules.shingle, len(ids))
        codes = _codes(ids, self.width)
        touches = np.convolve(self.own, np.ones(self.width, int))[self.width - 1 : len(ids)] > 0
        self.places = np.flatnonzero(touches) if touches.any() else np.arange(len(codes))
        self.codes = codes[self.places]
        self.n_own = int(self.own.sum())
        self.distinct = np.unique(self.codes)
        held = int(np.ceil(self.n_own * rules.part))
        # Two passages lose 2 * (shingle - 1) shingles at their ends, an edit in ten words up to `shingle` each.
        self.need = max(1, min(len(self.distinct), held - 2 * (rules.shingle - 1) - rules.shingle * int(np.ceil(held / 10))))
        #: Of the ``need`` shared shingles so many must be among the rarest ``prefix``.
        self.least = max(1, int(self.need * rules.overlap))
        self.prefix = len(self.distinct) - self.need + self.least


# ---------------------------------------------------------------- verification of a candidate


class Document:
    """A document's words and, for each width of a shingle, its codes in order of value with their places."""

    def __init__(self, ids: np.ndarray) -> None:
        self.ids = ids
        self._sorted: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def codes(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        if width not in self._sorted:
            codes = _codes(self.ids, width)
            order = np.argsort(codes, kind="stable")
            self._sorted[width] = codes[order], order
        return self._sorted[width]


@dataclass
class _Pair:
    """A candidate within the bounds: an item, a document, and where they may be aligned."""

    item: Item
    doc: np.ndarray
    bands: list[_Band]
    shortest: int


def _within_bounds(item: Item, document: Document, rules: LeakRules) -> _Pair | None:
    """Bounds by shared shingles, length, and position.

    Within a passage the distance between a shingle's places in document and item drifts by no more than the edits
    allow, so shared shingles are grouped by this distance. With an edit to ten words at least half of a passage's words
    stand in shared shingles, and all of them are words of the part of the document that the group can reach; so
    the two largest groups must cover half of what is wanted, and reach all of it.
    """
    wanted = rules.part * item.n_own
    doc = document.ids
    if len(doc) < wanted:
        return None
    codes, order = document.codes(item.width)
    first = np.searchsorted(codes, item.codes, "left")
    n = np.searchsorted(codes, item.codes, "right") - first
    hit = np.flatnonzero(n)
    if len(hit) < item.need or len(set(item.codes[hit].tolist())) < item.need:
        return None
    n = n[hit]
    inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    at = order[np.repeat(first[hit], n) + inner]
    bands = _bands(at, np.repeat(item.places[hit], n), item, rules)
    if 2 * sum(sorted((b.cover for b in bands), reverse=True)[:2]) < wanted:
        return None
    for b in bands:
        b.there = np.isin(item.ids, doc[max(0, b.low) : max(0, b.high + len(item.ids))]) & item.own
        b.words = min(2 * b.cover, int(np.count_nonzero(b.there)))
    if sum(sorted((b.words for b in bands), reverse=True)[:2]) < wanted:
        return None
    return _Pair(item, doc, bands, max(1, min(rules.passage, item.n_own // 4)))


def held_words(pairs: list[_Pair], rules: LeakRules) -> list[int]:
    """Own words of each pair's item that stand in its document in at most two passages, in order.

    All groups that can hold the larger passage are aligned together, then those that can hold another before or after it.
    """
    tasks, owner = [], []
    for k, p in enumerate(pairs):
        for b in p.bands:
            # The larger of two passages has at least half of what is wanted.
            if 2 * b.words >= rules.part * p.item.n_own:
                tasks.append(_Task(p.item.ids, p.doc, b.low, b.high, p.shortest))
                owner.append(k)
    best: list[_Passage | None] = [None] * len(pairs)
    for k, found in zip(owner, _passages(tasks, rules), strict=True):
        if found is not None and (best[k] is None or found.score > best[k].score):
            best[k] = found
    held = [int(p.item.own[f.matched].sum()) if f else 0 for p, f in zip(pairs, best, strict=True)]
    tasks, owner = [], []
    for k, (p, f) in enumerate(zip(pairs, best, strict=True)):
        wanted = rules.part * p.item.n_own
        if f is None or held[k] >= wanted:
            continue
        for b in p.bands:
            if held[k] + np.count_nonzero(b.there[: f.i0]) >= wanted and ((b.at < f.j0) & (b.place < f.i0)).any():
                tasks.append(_Task(p.item.ids[: f.i0], p.doc[: f.j0], b.low, b.high, p.shortest))
                owner.append((k, 0))
            reach = p.item.width
            if held[k] + np.count_nonzero(b.there[f.i1 :]) >= wanted and ((b.at + reach > f.j1) & (b.place + reach > f.i1)).any():
                shift = f.j1 - f.i1
                tasks.append(_Task(p.item.ids[f.i1 :], p.doc[f.j1 :], b.low - shift, b.high - shift, p.shortest))
                owner.append((k, f.i1))
    more = [0] * len(pairs)
    for (k, start), found in zip(owner, _passages(tasks, rules), strict=True):
        if found is not None:
            more[k] = max(more[k], int(pairs[k].item.own[found.matched + start].sum()))
    return [a + b for a, b in zip(held, more, strict=True)]


@dataclass
class _Band:
    """Shared shingles of about one distance between their places; the distances that an alignment may take."""

    low: int
    high: int
    at: np.ndarray
    place: np.ndarray
    cover: int
    #: Own words of the item that the part of the document has, and the most that an alignment here can hold.
    there: np.ndarray | None = None
    words: int = 0


def _bands(at: np.ndarray, place: np.ndarray, item: Item, rules: LeakRules) -> list[_Band]:
    drift = max(2, int(np.ceil(rules.edits * len(item.ids))))
    bins = (at - place) // drift
    order = np.argsort(bins, kind="stable")
    at, place, bins = at[order], place[order], bins[order]
    present, start = np.unique(bins, return_index=True)
    end = np.append(start[1:], len(bins))
    out = []
    for k, b in enumerate(present):
        pair = k + 1 < len(present) and present[k + 1] == b + 1
        # A bin is part of the group with the next one; alone if neither neighbour is there.
        if not pair and k > 0 and present[k - 1] == b - 1:
            continue
        s, e = start[k], end[k + 1] if pair else end[k]
        words = np.zeros(len(item.ids) + item.width, bool)
        for w in range(item.width):
            words[place[s:e] + w] = True
        cover = int((words[: len(item.ids)] & item.own).sum())
        distance = at[s:e] - place[s:e]
        out.append(_Band(int(distance.min()) - drift, int(distance.max()) + drift, at[s:e], place[s:e], cover))
    return out


@dataclass
class _Passage:
    score: int
    i0: int
    i1: int
    j0: int
    j1: int
    matched: np.ndarray


@dataclass
class _Task:
    """An alignment among distances (document place less item place) from ``low`` to ``high``."""

    item: np.ndarray
    doc: np.ndarray
    low: int
    high: int
    shortest: int

    def __post_init__(self) -> None:
        self.low, self.high = max(self.low, -len(self.item)), min(self.high, len(self.doc))


#: Cells of alignments that are computed together, and candidates that wait for it.
_CELLS = 1_000_000
_TOGETHER = 512


def _passages(tasks: list[_Task], rules: LeakRules) -> list[_Passage | None]:
    """The best local alignment of each task, if it has few edits.

    Alignments of about one size are computed together. Memory and time of each are item words times the width of the
    band, however long the document is.
    """
    out: list[_Passage | None] = [None] * len(tasks)
    real = [k for k, t in enumerate(tasks) if min(len(t.item), len(t.doc)) >= t.shortest and t.high >= t.low]
    real.sort(key=lambda k: (len(tasks[k].item), tasks[k].high - tasks[k].low))
    at = 0
    while at < len(real):
        end, width = at, 0
        while end < len(real):
            t = tasks[real[end]]
            wide = max(width, t.high - t.low + 1)
            if end > at and (end - at + 1) * (len(t.item) + 1) * wide > _CELLS:
                break
            end, width = end + 1, wide
        for k, found in zip(real[at:end], _align([tasks[k] for k in real[at:end]], width, rules), strict=True):
            out[k] = found
        at = end
    return out


def _align(tasks: list[_Task], width: int, rules: LeakRules) -> list[_Passage | None]:
    n, cost = max(len(t.item) for t in tasks), rules.edit_cost
    # Word of the document at distance c + low of item word i: part[i + c]. What isn't there equals nothing.
    part = np.zeros((len(tasks), n + width), np.uint64)
    item = np.full((len(tasks), n), 2, np.uint64)
    for k, t in enumerate(tasks):
        a, b = max(0, t.low), min(len(t.doc), t.low + n + width)
        part[k, a - t.low : max(a, b) - t.low] = t.doc[a : max(a, b)]
        item[k, : len(t.item)] = t.item
    small = np.int16 if cost * (width + 1) + n < 32_000 else np.int32
    score = np.zeros((n + 1, len(tasks), width), small)
    ramp = (cost * np.arange(width)).astype(small)
    for i in range(1, n + 1):
        above = score[i - 1]
        row = (part[:, i - 1 : i - 1 + width] == item[:, i - 1 : i]) * small(1 + cost)
        row += above
        row -= small(cost)
        np.maximum(row[:, :-1], above[:, 1:] - small(cost), out=row[:, :-1])
        np.maximum(row, small(0), out=row)
        row += ramp
        np.maximum.accumulate(row, axis=1, out=score[i])
        score[i] -= ramp
    tops = score.max(axis=2).T
    return [
        _traced(score[:, k], int(tops[k].argmax()), part[k], t, rules) if tops[k].max() >= max(1, t.shortest // 2) else None
        for k, t in enumerate(tasks)
    ]


def _traced(score: np.ndarray, i: int, part: np.ndarray, t: _Task, rules: LeakRules) -> _Passage | None:
    cost, width = rules.edit_cost, score.shape[1]
    c = int(score[i].argmax())
    top, i1, j1 = int(score[i, c]), i, i + c + t.low
    rows, words, item = score[: i + 1].tolist(), part.tolist(), t.item.tolist()
    matched, edits = [], 0
    while i and rows[i][c] > 0:
        now = rows[i][c]
        same = words[i - 1 + c] == item[i - 1]
        if now == rows[i - 1][c] + (1 if same else -cost):
            if same:
                matched.append(i - 1)
            else:
                edits += 1
            i -= 1
        elif c + 1 < width and now == rows[i - 1][c + 1] - cost:
            edits, i, c = edits + 1, i - 1, c + 1
        else:
            edits, c = edits + 1, c - 1
    if len(matched) < t.shortest or edits > rules.edits * (len(matched) + edits):
        return None
    return _Passage(top, i, i1, i + c + t.low, j1, np.array(matched[::-1]))


# ---------------------------------------------------------------- items


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = [word_numbers(item_words(text)) for text in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([i.view(np.int64).tolist() for i in ids], pa.list_(pa.int64()))], ["key", "words"]
        )


def _runs(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, places, codes = [], [], []
        for key, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = _codes(np.array(words, np.int64).view(np.uint64), width)
            keys += [key] * len(found)
            places += range(len(found))
            codes += found.tolist()
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(places, pa.int32()), pa.array(codes, pa.int64())], ["key", "at", "code"])


def _item_shingles(batches: Iterator[pa.RecordBatch], rules: LeakRules) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for key, words, shared in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            item = Item(np.array(words, np.int64).view(np.uint64), shared or [], rules)
            rows += [(key, s, item.width, item.least, item.prefix) for s in item.distinct.tolist()]
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["key", "shingle", "width", "least", "prefix"]
        )


def item_table(items: DataFrame, rules: LeakRules = LeakRules()) -> DataFrame:
    """(key, item_id, words, shared): the word numbers of each item and where runs begin that are a preamble.

    Runs are counted over all items, so blocks of items don't change what is a preamble. A run that a third of the
    items share is spread by ``lookup_by_key``.
    """
    asked = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text").distinct()
    keyed = asked.withColumn("key", F.xxhash64("item_id", "text"))
    words = keyed.select("key", "text").mapInArrow(_parsed, "key bigint, words array<bigint>")
    parsed = durable(keyed.select("key", "item_id").join(words.where(F.size("words") > 0), "key"))
    runs = parsed.select("key", "words").mapInArrow(lambda it: _runs(it, rules.preamble), "key bigint, at int, code bigint")
    held = runs.groupBy("code", "key").agg(F.count(F.lit(1)).alias("n")).groupBy("code").agg(F.sum("n").alias("n_runs"), F.count(F.lit(1)).alias("n_items"))
    common = held.where(F.col("n_items") >= rules.preamble_items).select("code", "n_runs", F.lit(True).alias("common"))
    found = lookup_by_key(runs, common, "code", "n_runs", "key", runs.count()).where("common")
    places = found.groupBy("key").agg(F.sort_array(F.collect_set("at")).alias("shared"))
    return durable(parsed.join(places, "key", "left"))


# ---------------------------------------------------------------- documents


class _Lookup:
    """The words and shingles of a block of items, in a form that a task can look up quickly."""

    def __init__(self, texts: list[str], by_width: dict[int, np.ndarray]) -> None:
        words = sorted({w for text in texts for w in item_words(text)})
        self.vocabulary = dict(zip(words, word_numbers(words).tolist(), strict=True))
        self.by_width = by_width

    def found(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of the text and shingle, each pair once, of the shingles in a list of texts that some item has."""
        gap = [0] * max(self.by_width, default=1)
        get = self.vocabulary.get
        ids: list[int] = []
        starts = []
        for text in texts:
            starts.append(len(ids))
            ids += [get(w, 0) for w in item_words(text)]
            ids += gap  # no shingle crosses from text to text
        numbers, begin = np.array(ids, np.uint64), np.array(starts)
        known = np.concatenate([[0], np.cumsum(numbers != 0)])
        pairs = []
        for width, codes in self.by_width.items():
            # Only runs of words that the items have can be shingles of items.
            at = np.flatnonzero(known[width:] - known[:-width] == width)
            code = _codes(numbers, width)[at]
            where = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
            same = codes[where] == code
            pairs.append(np.stack([np.searchsorted(begin, at[same], "right") - 1, code[same]], axis=1))
        both = np.concatenate(pairs) if pairs else np.empty((0, 2), np.int64)
        both = both[np.lexsort((both[:, 1], both[:, 0]))]
        new = np.ones(len(both), bool)
        new[1:] = (both[1:] != both[:-1]).any(axis=1)
        return both[new, 0], both[new, 1]


def _hits(batches: Iterator[pa.RecordBatch], lookup: _Lookup, part: int = 500) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for s in range(0, batch.num_rows, part):
            some = batch.slice(s, part)
            rows = [(d, t) for d, t in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True) if t and d is not None]
            if not rows:
                continue
            which, code = lookup.found([t for _, t in rows])
            docs = np.array([d for d, _ in rows], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(docs[which], pa.int64()), pa.array(code, pa.int64())], ["doc_id", "shingle"])


def _verified(batches: Iterator[pa.RecordBatch], rules: LeakRules) -> Iterator[pa.RecordBatch]:
    text_before, doc = None, Document(np.empty(0, np.uint64))
    items: dict[int, Item] = {}
    n_words = 0
    for batch in batches:
        rows: list[tuple] = []
        found: list[tuple] = []
        pairs: list[_Pair] = []

        def settle(rows: list = rows, found: list = found, pairs: list = pairs) -> None:
            for (d, i, n_own), held in zip(found, held_words(pairs, rules), strict=True):
                if held >= rules.part * n_own:
                    rows.append((d, i, held, held / n_own))
            found.clear()
            pairs.clear()

        ids, texts, keys, item_ids, words, shared = (batch.column(c) for c in ("doc_id", "text", "key", "item_id", "words", "shared"))
        for r, (d, key, i) in enumerate(zip(ids.to_pylist(), keys.to_pylist(), item_ids.to_pylist(), strict=True)):
            # The candidates of one document come one after the other.
            text = texts[r].as_py()
            if text != text_before:
                text_before, doc = text, Document(word_numbers(item_words(text)))
            item = items.get(key)
            if item is None:
                if n_words > BLOCK_WORDS:
                    items, n_words = {}, 0
                item = items[key] = Item(words[r].values.to_numpy().view(np.uint64), shared[r].as_py() or [], rules)
                n_words += len(item.ids)
            pair = _within_bounds(item, doc, rules)
            if pair is not None:
                found.append((d, i, item.n_own))
                pairs.append(pair)
                if len(pairs) >= _TOGETHER:
                    settle()
        settle()
        columns = list(zip(*rows, strict=True)) or [[], [], [], []]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "n_words", "part"])


def shared_shingles(documents: DataFrame, items: DataFrame, shingles: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, shingle): the shingles of items that each document has; each document's text is read once a block of items."""
    asked = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text").distinct()
    keyed = asked.withColumn("key", F.xxhash64("item_id", "text"))
    size = keyed.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    blocks = max(1, -(-int(size) // block_words))
    out = None
    for b in range(blocks):
        mine = F.pmod(F.xxhash64("key"), F.lit(blocks)) == b
        by_width: dict[int, list[int]] = {}
        for r in shingles.where(mine).select("width", "shingle").distinct().collect():
            by_width.setdefault(r.width, []).append(r.shingle)
        texts = [r.text for r in keyed.where(mine).select("text").collect()]
        lookup = _Lookup(texts, {w: np.sort(np.array(s, np.int64)) for w, s in sorted(by_width.items())})
        hits = documents.select("doc_id", "text").mapInArrow(lambda it, lookup=lookup: _hits(it, lookup), "doc_id bigint, shingle bigint")
        out = hits if out is None else out.unionByName(hits)
    return out


def item_prefixes(shingles: DataFrame, frequency: DataFrame) -> DataFrame:
    """(key, shingle, least): each item's rarest shingles by ``frequency`` (shingle, n_docs); a window holds one item's."""
    rarity = Window.partitionBy("key").orderBy(F.coalesce("n_docs", F.lit(0)), "shingle")
    ranked = shingles.join(frequency, "shingle", "left").withColumn("_rank", F.row_number().over(rarity))
    return ranked.where(F.col("_rank") <= F.col("prefix")).select("key", "shingle", "least")


def prefix_candidates(hits: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(doc_id, key): documents that share enough of an item's prefix. One document's hits stay in one task up to the sum."""
    small = prefixes.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    joined = hits.join(F.broadcast(prefixes) if small else prefixes, "shingle")
    shared = joined.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("_n"), F.first("least").alias("_least"))
    return shared.where(F.col("_n") >= F.col("_least")).select("doc_id", "key")


def leaked_items(documents: DataFrame, items: DataFrame, rules: LeakRules = LeakRules(), block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, n_words, part): the items that leaked into each document.

    ``documents`` needs doc_id and text, ``items`` item_id and text. The rarity of the items' shingles
    is counted over all documents. Items are the stated query set: the words and shingles of a block of at most
    ``block_words`` words are sent to every task, each block for one pass over the documents; blocks
    don't change the result. Only documents with a candidate are parsed again. Prefixes and candidates are broadcast up to
    BROADCAST_ROWS rows, items up to BLOCK_WORDS words, else shuffled.

    Null and empty texts and null ids have no leaks. Items without words never leak; items shorter than a
    shingle are matched as a whole. A repeated document id is reported for each of its rows, an item id with several texts for
    each text. Texts are read whole. No documents or no items give no rows.
    """
    known = item_table(items, rules)
    shingles = durable(
        known.select("key", "words", "shared").mapInArrow(
            lambda it: _item_shingles(it, rules), "key bigint, shingle bigint, width int, least int, prefix int"
        )
    )
    hits = durable(shared_shingles(documents, items, shingles, block_words))
    frequency = hits.groupBy("shingle").agg(F.count(F.lit(1)).alias("n_docs"))
    candidates = prefix_candidates(hits, item_prefixes(shingles, frequency))
    pairs = durable(candidates)
    small = pairs.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    texts = documents.where(F.col("text").isNotNull()).select("doc_id", "text")
    asked = texts.join(F.broadcast(pairs) if small else pairs, "doc_id")
    few = (known.agg(F.sum(F.size("words"))).first()[0] or 0) <= BLOCK_WORDS
    asked = asked.join(F.broadcast(known) if few else known, "key")
    return asked.select("doc_id", "text", "key", "item_id", "words", "shared").mapInArrow(
        lambda it: _verified(it, rules), "doc_id bigint, item_id bigint, n_words int, part double"
    )

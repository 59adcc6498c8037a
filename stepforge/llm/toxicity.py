"""Abusive, hateful and sexual passages: maximum-scoring segments over token log-odds.

Each token has a log-odds weight for abusive against ordinary text, estimated with Dirichlet priors:
the corpus gives the prior of ordinary words, a small word list that of abusive ones. A linear scan
finds all maximal segments of a text, and the extreme-value law of the best segment in harmless
texts says how unlikely a document's best segment is.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate, chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepforge.llm.lexicon import LEET, LOOKALIKES, MILD, PAIRS, STRONG
from stepforge.session import durable


@dataclass(frozen=True)
class ToxicityRules:
    """Parameters of training and scoring."""

    #: Most labelled documents that are used to fit; a sample by id hash beyond that.
    labelled: int = 20_000
    #: Mass of the corpus prior of each class, and the counts that listed words add to the abusive class.
    prior: float = 400.0
    #: Words of a corpus from which on its prior has its full mass.
    corpus: int = 100_000
    strong: float = 6.0
    mild: float = 1.0
    pair: float = 2.0
    #: Weights of listed words before anything is learned.
    strong_start: float = 4.5
    mild_start: float = 1.2
    #: Weight that a disguised listed word gains, and that of a sentence's end.
    disguise: float = 3.0
    stop: float = -2.0
    #: Taken from every token's weight, so that harmless text scores below 0 on average.
    drift: float = 0.5
    #: Standard errors by which a log-odds is drawn towards 0.
    doubt: float = 1.0
    #: Bounds of one token's weight.
    least: float = -0.9
    most: float = 6.0
    #: Bound of a word that no list has, so that one such word alone is never a passage.
    learned: float = 3.5
    rounds: int = 4
    #: A document counts if its best segment is rarer than this among harmless texts.
    alpha: float = 1e-3


# ---------------------------------------------------------------- tokens

_HIDDEN = "​‌‍⁠﻿­"
_SIGN = r"@$*!+|€"
_SPACED = re.compile(rf"(?<![\w{_SIGN}])(?:[^\W_]|[{_SIGN}])(?:([ .\-_·])(?:[^\W_]|[{_SIGN}]))(?:\1(?:[^\W_]|[{_SIGN}])){{1,}}(?![\w{_SIGN}])")
_TOKEN = re.compile(rf"(?:[^\W_]|[{_SIGN}{_HIDDEN}])+|[.!?;:\n]+")
_TAG = re.compile(r"<[A-Za-z/!?][^<>]*>")
#: A letter or sign by itself at one end of a part.
_LETTER = re.compile(rf"^(?:[^\W_]|[{_SIGN}])(?![\w{_SIGN}])|(?<![\w{_SIGN}])(?:[^\W_]|[{_SIGN}])$")
#: Stands for a line's end among the parts of a text.
_BREAK = "\ue000"
_LONG = re.compile(r"(.)\1{2,}")
_TWICE = re.compile(r"(.)\1+")
#: What a sentence's end is in a token list.
STOP = "\n"


def _squeeze(word: str) -> str:
    return _TWICE.sub(r"\1", word)


class Spelling:
    """Finds the word behind a disguised spelling, among the words given."""

    def __init__(self, words: Iterable[str]) -> None:
        self.words = frozenset(words)
        self.parts: dict[str, tuple[str, ...]] = {}
        self.disguised: set[str] = set()
        self.single: set[str] = set()
        self.squeezed: dict[str, str] = {}
        self.by_length: dict[int, list[str]] = {}
        for w in sorted(self.words):
            self.squeezed.setdefault(_squeeze(w), w)
            self.by_length.setdefault(len(w), []).append(w)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"parts": {}, "disguised": set(), "single": set()}  # what a task has seen stays with it

    def learn(self, part: str) -> tuple[str, ...]:
        """The words of a part of a text; it is also kept whether one is disguised, or a letter may belong to a word spelled with spaces."""
        if len(self.parts) >= _KNOWN_PARTS:
            self.parts.clear()
            self.disguised.clear()
            self.single.clear()
        if part == _BREAK:
            both: tuple = ((STOP, False),)
        else:
            both = _part_tokens(part, self)
        words = self.parts[part] = tuple(w for w, _ in both)
        if any(h for _, h in both) or _SPACED.search(part):
            self.disguised.add(part)
        if _LETTER.search(part):
            self.single.add(part)
        return words

    def find(self, raw: str) -> str | None:
        """The word that ``raw`` stands for, or None."""
        for one in ("i", "l"):
            text = "".join((one if c in "1!|" else LEET.get(c, c)) for c in raw)
            if "*" in text:
                if sum(c.isalpha() for c in text) >= 2 and text[0] != "*":
                    pattern = re.compile("".join("." if c == "*" else re.escape(c) for c in text))
                    for w in self.by_length.get(len(text), ()):
                        if w in STRONG and pattern.fullmatch(w):
                            return w
                continue
            if text in self.words:
                return text
            w = self.squeezed.get(_squeeze(text))
            if w is not None and (_LONG.search(raw) or len(text) >= 5):
                return w
        return None


#: Most parts of text whose words a task keeps at hand.
_KNOWN_PARTS = 300_000


def _part_tokens(part: str, spelling: Spelling) -> tuple[tuple[str, bool], ...]:
    """The words of a part of a text without white space, in lower case, and whether each was disguised."""
    out: list[tuple[str, bool]] = []
    for m in _TOKEN.finditer(part):
        raw = m.group()
        if raw[0] in ".!?;:" and not any(c.isalnum() for c in raw):
            out.append((STOP, False))
            continue
        plain = raw if raw.isascii() else raw.translate(LOOKALIKES)
        bare = plain if plain.isascii() else "".join(c for c in plain if c not in _HIDDEN)
        core = bare.strip("!+|") if bare.strip("!+|").isalpha() else bare.rstrip("!")
        if not core:
            continue
        if core.isalpha() and not _LONG.search(core):
            out.append((core, core in spelling.words and (len(bare) < len(plain) or plain != raw)))
            continue
        found = spelling.find(core) if any(c.isalpha() for c in core) else None
        if found is None and core != bare:
            found = spelling.find(bare)
        if found is not None:
            out.append((found, True))
        else:
            out.append(("0" if core[0].isdigit() else core, False))
    return tuple(out)


def tokens(text: str, spelling: Spelling) -> tuple[list[str], list[bool]]:
    """Words in lower case with sentence ends, and which words were disguised.

    Parts between white space are looked up; only texts with a disguised part or a row of single letters go word by word.
    """
    text = unicodedata.normalize("NFKC", text).lower()
    if "<" in text:
        text = _TAG.sub("\n", text)
    parts = text.replace("\n", f" {_BREAK} ").split()
    get = spelling.parts.get
    found = [get(p) for p in parts]
    if None in found:
        found = [words if words is not None else spelling.learn(p) for p, words in zip(parts, found, strict=True)]
    if not spelling.disguised.isdisjoint(parts) or b"\1\1\1" in bytes(map(spelling.single.__contains__, parts)):
        return _slow_tokens(text, spelling)
    words = list(chain.from_iterable(found))
    words = [w for w, before in zip(words, chain((STOP,), words)) if w != STOP or before != STOP]
    return words, [False] * len(words)


def _slow_tokens(text: str, spelling: Spelling) -> tuple[list[str], list[bool]]:
    out: list[str] = []
    hidden: list[bool] = []

    def plain_text(piece: str) -> None:
        for i, line in enumerate(piece.split("\n")):
            if i and out and out[-1] != STOP:
                out.append(STOP)
                hidden.append(False)
            for part in line.split():
                words = spelling.parts.get(part)
                if words is None:
                    words = spelling.learn(part)
                for w, h in _part_tokens(part, spelling) if part in spelling.disguised else zip(words, repeat(False)):
                    if w != STOP or (out and out[-1] != STOP):
                        out.append(w)
                        hidden.append(h)

    at = 0
    for m in _SPACED.finditer(text):
        letters = m.group()[::2]
        word = spelling.find(letters) if len(letters) >= 3 and sum(c.isalpha() for c in letters) >= 2 else None
        if word is not None:
            plain_text(text[at : m.start()])
            out.append(word)
            hidden.append(True)
            at = m.end()
    plain_text(text[at:])
    return out, hidden


# ---------------------------------------------------------------- segments


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a sequence, in linear time."""
    found: list[list[float]] = []  # start, end, sum before, sum after
    sums = list(accumulate(scores, initial=0.0))
    for i, x in enumerate(scores):
        if x <= 0:
            continue
        part = [i, i + 1, sums[i], sums[i + 1]]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= part[2]:
                j -= 1
            if j < 0 or found[j][3] >= part[3]:
                found.append(part)
                break
            part = [found[j][0], part[1], found[j][2], part[3]]
            del found[j:]
    return [(int(s), int(e), b - a) for s, e, a, b in found]


# ---------------------------------------------------------------- model


@dataclass
class ToxicityModel:
    """Weights of words and pairs, and the extreme-value law of harmless texts."""

    rules: ToxicityRules
    words: dict[str, float] = field(default_factory=dict)
    pairs: dict[tuple[str, str], float] = field(default_factory=dict)
    unseen: float = 0.0
    #: P(best segment of n tokens > s) = 1 - exp(-k * n * exp(-decay * s)).
    k: float = 0.01
    decay: float = 1.0
    spelling: Spelling = field(default_factory=lambda: Spelling(STRONG | MILD))
    plain: dict[str, float] = field(default_factory=dict)
    final: dict[str, float] = field(default_factory=dict)

    def settle(self) -> ToxicityModel:
        """Fix the weights for scoring; to be called after words, pairs or spelling have changed."""
        r = self.rules
        self.plain = {w: x if w in STRONG else min(x, r.learned) for w, x in self.words.items()}
        self.final = {w: min(max(x - r.drift, r.least), r.most) for w, x in self.plain.items()} | {STOP: r.stop}
        return self

    def weights(self, words: list[str], hidden: list[bool]) -> list[float]:
        r = self.rules
        base = min(max(self.unseen - r.drift, r.least), r.most)
        get = self.final.get
        out = [get(w, base) for w in words]
        special = [i for i, pair in enumerate(zip(words, words[1:]), 1) if pair in self.pairs]
        if True in hidden:
            special += [i for i, h in enumerate(hidden) if h]
        for i in special:
            x = self.plain.get(words[i], self.unseen) + (self.pairs.get((words[i - 1], words[i]), 0.0) if i else 0.0)
            if hidden[i]:
                x = max(x, 0.0) + r.disguise
            out[i] = min(max(x - r.drift, r.least), r.most)
        return out

    def rarity(self, n: int, score: float) -> float:
        """-log10 of the chance that a harmless text of n tokens has a segment of this score."""
        rate = self.k * max(n, 1) * math.exp(-min(self.decay * score, 700.0))
        return -math.log10(max(-math.expm1(-rate), 1e-300))

    def judge(self, text: str) -> tuple[float, int]:
        """Rarity of the best segment of a text, and its number of segments that are rare by themselves."""
        words, hidden = tokens(text, self.spelling)
        segments = maximal_segments(self.weights(words, hidden))
        if not segments:
            return 0.0, 0
        n = len(words)
        rare = [self.rarity(n, s) for _, _, s in segments]
        return max(rare), sum(x >= -math.log10(self.rules.alpha) for x in rare)


def _log_odds(abusive: Counter, ordinary: Counter, background: dict, listed: dict, rules: ToxicityRules) -> dict:
    """Log-odds of each key, with the corpus and the word list as Dirichlet priors, less its standard error."""
    # A small corpus says little about rare words; its prior weighs less.
    whole = max(sum(background.values()), rules.corpus)
    extra = sum(listed.values())
    n_a, n_o = sum(abusive.values()), sum(ordinary.values())
    out = {}
    for key in abusive.keys() | ordinary.keys() | listed.keys():
        share = rules.prior * (background.get(key, 0) + 0.5) / whole
        a, o = abusive[key] + share + listed.get(key, 0.0), ordinary[key] + share
        odds = math.log(a / (n_a + rules.prior + extra)) - math.log(o / (n_o + rules.prior))
        doubt = rules.doubt * math.sqrt(1 / (a + 0.5) + 1 / (o + 0.5))
        out[key] = math.copysign(max(abs(odds) - doubt, 0.0), odds)
    return out


def start(rules: ToxicityRules = ToxicityRules()) -> ToxicityModel:
    """The model before anything is learned: the word list."""
    model = ToxicityModel(rules)
    model.words = dict.fromkeys(MILD, rules.mild_start) | dict.fromkeys(STRONG, rules.strong_start)
    model.pairs = dict.fromkeys(PAIRS, 1.5)
    return model.settle()


def _abusive_part(words: list[str], hidden: list[bool], model: ToxicityModel) -> np.ndarray:
    """The words of an abusive document that belong to sentences with a segment that the model finds; all else is ordinary text."""
    inside = np.zeros(len(words), bool)
    segments = maximal_segments(model.weights(words, hidden))
    best = max((s for *_, s in segments), default=0.0)
    for first, end, score in segments:
        if score >= max(2.5, 0.3 * best):
            while first > 0 and words[first - 1] != STOP:
                first -= 1
            while end < len(words) and words[end] != STOP:
                end += 1
            inside[first:end] = True
    return inside


_PARSED = "text string, toxic boolean, words array<string>, hidden array<boolean>"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    spelling = Spelling(STRONG | MILD)
    for batch in batches:
        both = [tokens(text, spelling) for text in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([b[0] for b in both], pa.list_(pa.string())), pa.array([b[1] for b in both], pa.list_(pa.bool_()))],
            ["text", "toxic", "words", "hidden"],
        )


def _counts(batches: Iterator[pa.RecordBatch], model: ToxicityModel) -> Iterator[pa.RecordBatch]:
    """(before, word, inside, n): words and pairs of words (``before`` null: the word alone) in abusive and in ordinary text."""
    seen: Counter[tuple] = Counter()
    for batch in batches:
        for toxic, words, hidden in zip(*(batch.column(c).to_pylist() for c in ("toxic", "words", "hidden")), strict=True):
            inside = _abusive_part(words, hidden, model).tolist() if toxic else [False] * len(words)
            last = STOP
            for w, x in zip(words, inside, strict=True):
                if w != STOP:
                    seen[None, w, x] += 1
                    if last != STOP:
                        seen[last, w, x] += 1
                last = w
    if seen:
        before, word, inside = zip(*seen, strict=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(before, pa.string()), pa.array(word, pa.string()), pa.array(inside, pa.bool_()), pa.array(list(seen.values()), pa.int64())],
            ["before", "word", "inside", "n"],
        )


def _counted(parsed: DataFrame, model: ToxicityModel) -> DataFrame:
    counts = parsed.select("toxic", "words", "hidden").mapInArrow(lambda it: _counts(it, model), "before string, word string, inside boolean, n bigint")
    return counts.groupBy("before", "word", "inside").agg(F.sum("n").alias("n"))


def _best_segments(batches: Iterator[pa.RecordBatch], model: ToxicityModel) -> Iterator[pa.RecordBatch]:
    """(n, score): length and best segment of each harmless text."""
    for batch in batches:
        found = []
        for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if not toxic:
                words, hidden = tokens(text, model.spelling)
                if len(words) >= 5:
                    found.append((len(words), max((x for *_, x in maximal_segments(model.weights(words, hidden))), default=0.0)))
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], pa.float64())], ["n", "score"])


def fit(parsed: DataFrame, background: dict[str, int], rules: ToxicityRules = ToxicityRules()) -> ToxicityModel:
    """Fit on parsed labelled texts (text, toxic, words, hidden); ``background`` has corpus counts of their words.

    Only some sentences of an abusive document are abusive: in each round tasks find the segments of the present model in
    these documents and count words inside and outside; the counts make the next model. The driver holds counts
    of words, and of pairs with a word of some weight, never texts.
    """
    model = start(rules)
    listed = {w: rules.strong for w in STRONG} | {w: rules.mild for w in MILD if w not in STRONG}
    pairs = dict.fromkeys(PAIRS, rules.pair)
    spark = parsed.sparkSession
    # Harmless texts are ordinary in every round, so they are counted once.
    fixed = durable(_counted(parsed.where("NOT toxic"), model))
    ordinary_words = {r.word: r.n for r in fixed.where("before IS NULL").collect()}
    for _ in range(rules.rounds):
        counted = durable(_counted(parsed.where("toxic"), model))
        abusive, ordinary = Counter(), Counter(ordinary_words)
        for r in counted.where("before IS NULL").collect():
            (abusive if r.inside else ordinary)[r.word] += r.n
        if not abusive:
            break  # nothing to learn from; the word list remains the model
        words = _log_odds(abusive, ordinary, background, listed, rules)
        heavy = spark.createDataFrame([(w,) for w, x in words.items() if x > 1], "heavy string")
        first, second = (F.broadcast(heavy.select(F.col("heavy").alias(n))) for n in ("_first", "_second"))
        both = counted.unionByName(fixed).where("before IS NOT NULL").join(first, F.col("before") == F.col("_first"), "left").join(second, F.col("word") == F.col("_second"), "left")
        pair_a, pair_o = Counter(), Counter()
        for r in both.where("_first IS NOT NULL OR _second IS NOT NULL").collect():
            (pair_a if r.inside else pair_o)[r.before, r.word] += r.n
        model = ToxicityModel(rules, words, _pair_weights(pair_a, pair_o, pairs, words, rules)).settle()
    learned = {w for w, x in model.words.items() if x > 3 and len(w) >= 4 and w.isalpha()}
    model.spelling = Spelling(STRONG | MILD | learned)
    best = parsed.select("toxic", "text").mapInArrow(lambda it: _best_segments(it, model), "n bigint, score double").collect()
    _calibrate(model, [(r.n, r.score) for r in best])
    return model


def _pair_weights(abusive: Counter, ordinary: Counter, listed: dict, words: dict, rules: ToxicityRules) -> dict:
    """What a pair of words adds to their own weights; only pairs with a word of some weight, or listed ones."""
    known = {p for p in abusive.keys() | ordinary.keys() if max(words.get(p[0], 0.0), words.get(p[1], 0.0)) > 1} | listed.keys()
    odds = _log_odds(Counter({p: abusive[p] for p in known}), Counter({p: ordinary[p] for p in known}), {}, listed, rules)
    out = {}
    for p, x in odds.items():
        own = max(words.get(p[0], 0.0), words.get(p[1], 0.0))
        more = x - own if x < own else 0.5 * x
        # Harmless use must be frequent: single labels are wrong now and then.
        harmless = ordinary[p] >= 3 * (abusive[p] + 1)
        out[p] = min(max(more, -4.0 if harmless else 0.0), 2.0 if p in listed else 1.0)
    return out


def _calibrate(model: ToxicityModel, best: list[tuple[int, float]]) -> None:
    """Fit the extreme-value law to the best segments (length, score) of texts labelled harmless, without the top 2% (wrong labels).

    Most of these segments score next to 0; the decay is kept to 1 at most, for a steeper law would be read from them alone.
    """
    if len(best) < 20:
        model.k, model.decay = 0.02, 0.8
        return
    best = sorted(best, key=lambda b: (b[1], b[0]))
    kept = best[: max(20, int(len(best) * 0.98))]
    n = np.array([b[0] for b in kept], float)
    s = np.array([b[1] for b in kept])
    top = None
    for decay in np.geomspace(0.2, 1, 40):
        rate = n * np.exp(-decay * s)
        k = len(n) / rate.sum()
        like = np.sum(np.log(k * decay * rate) - k * rate)
        if top is None or like > top[0]:
            top = (like, k, decay)
    _, model.k, model.decay = map(float, top)


# ---------------------------------------------------------------- over DataFrames


def _part_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n): parts between white space are counted, and each distinct one is read once."""
    spelling = Spelling(STRONG | MILD)
    parts: Counter[str] = Counter()

    def read() -> pa.RecordBatch:
        seen: Counter[str] = Counter()
        for part, n in parts.items():
            for w, _ in _part_tokens(part, spelling):
                if w != STOP:
                    seen[w] += n
        parts.clear()
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            if text:
                text = unicodedata.normalize("NFKC", text).lower()
                parts.update((_TAG.sub("\n", text) if "<" in text else text).split())
        if len(parts) > _KNOWN_PARTS:
            yield read()
    yield read()


def corpus_counts(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """(word, n): how often each of the ``wanted`` words (word) stands in all texts; words spelled with spaces between letters don't count."""
    counts = documents.select("text").mapInArrow(_part_counts, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.join(wanted, "word", "left_semi")


def train(documents: DataFrame, labels: DataFrame, rules: ToxicityRules = ToxicityRules()) -> ToxicityModel:
    """A model from labelled documents (doc_id, toxic) and the word counts of all documents.

    A document's label is that of most of its annotators, abusive if even; null labels don't count.
    At most ``rules.labelled`` labelled documents are fitted, those with the smallest id hash. They are parsed once, by tasks.
    Corpus counts are over all documents, for the words of the sample, so what comes to the driver is bounded by it.
    Without labels the word list alone is the model.
    """
    votes = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.avg("toxic").alias("vote"))
    chosen = votes.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rules.labelled)
    # At most rules.labelled ids, by broadcast: texts are not shuffled but for the labelled ones, which are spread evenly.
    sample = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where(F.col("text").isNotNull())
    # A number of parts, else small parts would be put together and all rounds be one task's work.
    n_parts = max(2, documents.sparkSession.sparkContext.defaultParallelism)
    sample = sample.select("text", (F.col("vote") >= 0.5).alias("toxic")).repartition(n_parts, F.xxhash64("text"))
    parsed = durable(sample.mapInArrow(_parse, _PARSED))
    spark = documents.sparkSession
    listed = spark.createDataFrame([(w,) for w in sorted(STRONG | MILD)], "word string")
    wanted = parsed.select(F.explode("words").alias("word")).unionByName(listed).distinct()
    return fit(parsed, {r.word: r.n for r in corpus_counts(documents, wanted).collect()}, rules)


def _judge(batches: Iterator[pa.RecordBatch], model: ToxicityModel) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        judged = [model.judge(text) if text else (0.0, 0) for text in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([j[0] for j in judged], pa.float64()), pa.array([j[1] for j in judged], pa.int32())],
            ["doc_id", "source", "score", "n_passages"],
        )


def toxicity_scores(documents: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, source, score, n_passages, toxic), one row per row of ``documents`` (doc_id, source, text).

    The score is -log10 of the chance of such a passage in a harmless text of the same length. Null and
    empty texts score 0. Texts are read whole; the language column isn't used.
    """
    scored = documents.select("doc_id", "source", "text").mapInArrow(
        lambda it: _judge(it, model), "doc_id bigint, source string, score double, n_passages int"
    )
    return scored.withColumn("toxic", F.col("score") >= F.lit(-math.log10(model.rules.alpha)))


def source_rates(scores: DataFrame) -> DataFrame:
    """(source, n_documents, n_toxic, rate) of each source; null is a source."""
    return (
        scores.groupBy("source")
        .agg(F.count(F.lit(1)).alias("n_documents"), F.count_if("toxic").alias("n_toxic"))
        .withColumn("rate", F.col("n_toxic") / F.col("n_documents"))
    )

"""Containers, leakage and toxicity on small cases, against brute force."""

import random
from pathlib import Path

import numpy as np
import pytest

from stepforge.llm import containers as C
from stepforge.llm import leakage as L
from stepforge.llm import toxicity as X


def test_patterns_hold_every_length_and_little_room_is_lost():
    rng = np.random.default_rng(7)
    for capacity, n in ((10, 0), (10, 7), (64, 900), (512, 20_000)):
        lengths = np.minimum(capacity, 1 + rng.geometric(4 / capacity, n)) if n else np.array([], int)
        counts = np.bincount(lengths, minlength=capacity + 1)[1:]
        patterns, bound = C.solve(counts, capacity)
        held = np.zeros(capacity, np.int64)
        for p in patterns:
            assert sum(v * k for v, k in p.counts) <= capacity and p.times > 0
            for v, k in p.counts:
                held[v - 1] += k * p.times
        assert (held == counts).all()
        used = sum(p.times for p in patterns)
        assert used >= bound - 1e-6
        if n >= 900:
            assert used <= 1.02 * bound + 2


def test_knapsack_prices_are_optimal():
    rng = np.random.default_rng(8)
    for _ in range(20):
        lengths = np.sort(rng.choice(np.arange(1, 9), 5, replace=False))
        values = rng.random(5)
        table, take = C._knapsack(values, lengths, 9)
        got = C._filling(take, lengths, 9)
        best = [0.0]
        for c in range(1, 10):
            best.append(max([best[c - 1]] + [best[c - v] + x for v, x in zip(lengths, values, strict=True) if v <= c]))
        assert np.allclose(table, best)
        assert np.isclose(sum(values[k] * m for k, m in got.items()), best[9])
        assert sum(lengths[k] * m for k, m in got.items()) <= 9


def test_the_linear_program_converges():
    """Its amounts cover every length and cost within 2% of its own dual bound; rounded, it needs no more than greedy filling alone."""
    rng = np.random.default_rng(17)
    for capacity, n in ((256, 3000), (512, 900), (512, 9000)):
        lengths = np.minimum(capacity - 1, 1 + rng.geometric(4 / capacity, n))
        counts = np.bincount(lengths, minlength=capacity + 1)[1:]
        x, dual = C.fractional(counts, capacity)
        covered = np.zeros(capacity)
        for key, amount in x.items():
            assert amount > 0 and sum(v * k for v, k in key) <= capacity
            for v, k in key:
                covered[v - 1] += k * amount
        assert (covered >= counts * (1 - 1e-6)).all()
        assert dual * (1 - 1e-9) <= sum(x.values()) <= 1.02 * dual
        greedy = sum(p.times for p in C._packed(counts, capacity))
        assert sum(p.times for p in C.solve(counts, capacity)[0]) <= greedy + (capacity < 512) * 0.005 * greedy


@pytest.mark.skipif(not Path(C.TOKENIZER).exists(), reason="no vocabulary")
def test_containers(spark):
    rng = random.Random(9)
    texts = ["", None, "cup " * 400, "cup"] + [" ".join(["the cup"] * rng.randint(1, 30)) for _ in range(300)] + ["same text"] * 150
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id bigint, text string, piece int")
    rows = C.fill_containers(df, 64).collect()
    assert sorted({r.doc_id for r in rows}) == list(range(len(texts)))
    assert len({(r.doc_id, r.piece) for r in rows}) == len(rows)
    used = {}
    for r in rows:
        assert (r.container_id is None) == (r.n_tokens == 0)
        if r.n_tokens:
            used[r.container_id] = used.get(r.container_id, 0) + r.n_tokens
    assert max(used.values()) <= 64
    assert sum(used.values()) / (64 * len(used)) > 0.97
    long = [r.n_tokens for r in rows if r.doc_id == 2]
    assert len(long) > 1 and sorted(long)[1:] == [64] * (len(long) - 1)
    assert all(len([r for r in rows if r.doc_id == i]) == 1 for i in range(3, len(texts)))
    assert C.fill_containers(df.limit(0), 64).count() == 0


PREAMBLE = "the scene is filmed by three cameras one fixed behind the table and one on each wrist and the robot has been told to do this now"
WORDS = [f"w{i}" for i in range(4000)]


def item(seed, n=60):
    rng = random.Random(seed)
    return [rng.choice(WORDS) for _ in range(n)]


def leaks(spark, docs, items):
    d = spark.createDataFrame([(i, t, "x") for i, t in enumerate(docs)], "doc_id bigint, text string, item_id string")
    e = spark.createDataFrame(items, "item_id bigint, text string")
    return sorted((r.doc_id, r.item_id) for r in L.leaked_items(d, e).collect())


def test_leaks(spark):
    a, b = item(1), item(2)
    filler = " ".join(item(99, 200))
    changed = [w if i % 11 else "other" for i, w in enumerate(a)]
    markup = "<p>" + ", ".join(w.upper() for w in a[:35]) + "</p>\n<br>"
    docs = [
        f"{filler} {' '.join(a)} {filler}",
        f"{filler} {' '.join(changed)}",
        markup,
        f"{' '.join(a[:18])} {filler} {' '.join(a[30:48])}",  # two passages
        f"{' '.join(a[30:48])} {filler} {' '.join(a[:18])}",  # in the wrong order
        f"{filler} {' '.join(a[:22])}",  # too short
        " ".join(w for i, w in enumerate(a) if i % 3),  # too many words left out
        PREAMBLE, "", None, f"{' '.join(a)} {' '.join(b)} {' '.join(a)}",
        f"{PREAMBLE} {' '.join(item(50)[:40])}",
    ]
    items = [(1, " ".join(a)), (2, " ".join(b)), *[(50 + k, f"{PREAMBLE} {' '.join(item(50 + k, 30 + 5 * k))}") for k in range(4)], (8, ""), (9, None), (None, "x")]
    want = [(0, 1), (1, 1), (2, 1), (3, 1), (10, 1), (10, 2)]
    got = leaks(spark, docs, items)
    assert [g for g in got if g[0] != 11] == want
    assert (11, 50) in got
    assert leaks(spark, docs, items[6:]) == []


def test_blocks_of_items_give_the_same(spark):
    """Also of items with a shared preamble, which is one over all items, whatever block they are in."""
    items = [(i, " ".join(item(i))) for i in range(12)] + [(50 + k, f"{PREAMBLE} {' '.join(item(50 + k, 30))}") for k in range(4)]
    docs = [" ".join(item(i)[:40]) for i in range(0, 12, 2)] + [PREAMBLE, f"{PREAMBLE} {' '.join(item(51, 30)[:25])}"]
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    e = spark.createDataFrame(items, "item_id bigint, text string")
    want = [(i // 2, i) for i in range(0, 12, 2)] + [(7, 51)]
    for size in (L.BLOCK_WORDS, 100):
        assert sorted((r.doc_id, r.item_id) for r in L.leaked_items(d, e, block_words=size).collect()) == want


def test_rare_shingles_make_fewer_candidates(spark):
    """A sentence frame that many documents have is in no prefix, if shingles are ordered by rarity."""
    frame = item(70, 10)
    items = spark.createDataFrame([(1, " ".join(frame + item(71, 50)))], "item_id bigint, text string")
    docs = [" ".join(frame + item(100 + i, 30)) for i in range(30)] + [" ".join(frame + item(71, 50))]
    documents = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    rules = L.LeakRules(overlap=0.01)
    known = L.item_table(items, rules)
    shingles = known.select("key", "words", "shared").mapInArrow(lambda it: L._item_shingles(it, rules), "key bigint, shingle bigint, width int, least int, prefix int")
    hits = L.shared_shingles(documents, items, shingles)
    frequency = hits.groupBy("shingle").count().withColumnRenamed("count", "n_docs")
    reverse = frequency.selectExpr("shingle", "-n_docs AS n_docs")
    few = L.prefix_candidates(hits, L.item_prefixes(shingles, frequency))
    many = L.prefix_candidates(hits, L.item_prefixes(shingles, reverse))
    assert (few.count(), many.count()) == (1, 31)
    assert [tuple(r)[:2] for r in L.leaked_items(documents, items, rules).collect()] == [(30, 1)]


def held(words, doc, shared=()):
    rules = L.LeakRules()
    thing = L.Item(L.word_numbers(words), list(shared), rules)
    pair = L._within_bounds(thing, L.Document(L.word_numbers(doc)), rules)
    return L.held_words([pair], rules)[0] if pair else 0


def test_short_items_and_long_documents():
    assert held(["hold", "it"], item(1, 30) + ["hold", "it"]) == 2
    assert held(["cup"], ["a", "cup"]) == 1 and held(["cup"], ["lid"]) == 0
    a = item(3, 43)
    assert held(a, item(4, 50) + a[:14] + item(6, 30) + a[30:] + item(7, 40)) == 27
    # A document that repeats parts of an item is aligned in bands of the item's size.
    assert held(a, (a[:12] + item(8, 5)) * 400 + a) == 43
    frames = [w for k in range(60) for w in a[20:29] + item(300 + k, 9)]
    assert held(a, item(9, 9) + a[:14] + frames + a[29:]) >= 22


def brute_held(a, d, rules):
    """Most words that one exact passage holds; for exact quotations this is the answer."""
    best = 0
    for i in range(len(a)):
        for j in range(len(d)):
            k = 0
            while i + k < len(a) and j + k < len(d) and a[i + k] == d[j + k]:
                k += 1
            best = max(best, k)
    return best


def test_exact_quotations_against_brute_force():
    rng = random.Random(11)
    a = item(5, 50)
    for n in range(5, 50, 3):
        doc = item(200 + n, 30) + a[: n] + item(300 + n, 30)
        rng.random()
        assert (held(a, doc) >= 25) == (brute_held(a, doc, None) >= 25)


def test_segments_match_brute_force():
    rng = random.Random(12)
    for _ in range(200):
        s = [rng.choice([-2.0, -1.0, 0.5, 1.5, 3.0]) for _ in range(rng.randint(0, 12))]
        got = X.maximal_segments(s)
        best = max((sum(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1)), default=0.0)
        assert abs(max((x for *_, x in got), default=0.0) - max(best, 0.0)) < 1e-9
        assert all(abs(sum(s[i:j]) - x) < 1e-9 and x > 0 for i, j, x in got)
        assert all(b[0] >= a[1] for a, b in zip(got, got[1:], strict=False))


@pytest.mark.parametrize("raw", ["a s s h o l e", "1d10t", "$cumbag", "loooooser", "w.a.n.k.e.r", "a*****e", "mor​on", "IDIOT!", "b1tch"])
def test_disguised_spelling(raw):
    spelling = X.Spelling(X.STRONG | X.MILD)
    found = set(X.tokens(f"you {raw} there", spelling)[0])
    assert found & X.STRONG


def labelled():
    rng = random.Random(13)
    things = ["cup", "lid", "tray", "cube", "towel", "marker"]
    clean = ["put the {} on the shelf near the door", "kill the process that holds the {}", "the idiot proof clamp held the {}", "we moved the {} twice before lunch"]
    foul = ["you are a stupid idiot, nobody wants your {}", "get those filthy people away from the {}", "kill yourself, moron, the {} was garbage"]
    rows = []
    for i in range(600):
        toxic = i % 6 == 0
        parts = [rng.choice(clean).format(rng.choice(things)) for _ in range(rng.randint(2, 8))]
        if toxic:
            parts.insert(rng.randrange(len(parts)), rng.choice(foul).format(rng.choice(things)))
        rows.append((i, ". ".join(parts) + ".", f"s{i % 3}", int(toxic)))
    return rows


def test_toxic_documents_are_found_on_held_out_rows(spark):
    rows = labelled()
    documents = spark.createDataFrame([(i, t, s, 1) for i, t, s, _ in rows] + [(900, None, None, 1), (901, "", "s0", 1)], "doc_id bigint, text string, source string, score int")
    labels = spark.createDataFrame([(i, y) for i, _, _, y in rows[:300]] + [(5, None), (None, 1), (7, 1), (7, 0), (7, 0)], "doc_id bigint, toxic int")
    model = X.train(documents, labels)
    scores = {r.doc_id: r for r in X.toxicity_scores(documents, model).collect()}
    assert len(scores) == 602 and not scores[900].toxic and scores[901].score == 0
    held = rows[300:]
    right = sum(scores[i].toxic == bool(y) for i, _, _, y in held)
    assert right / len(held) > 0.9
    assert not any(scores[i].toxic and not y for i, _, _, y in held)
    rates = {r.source: r for r in X.source_rates(X.toxicity_scores(documents, model)).collect()}
    assert set(rates) == {"s0", "s1", "s2", None} and sum(r.n_documents for r in rates.values()) == 602


def test_passages_of_words_that_no_list_has(spark):
    """Learned beside listed words, they are found by themselves in held-out texts."""
    rng = random.Random(21)
    things = ["cup", "lid", "tray", "cube", "towel", "marker"]
    clean = ["put the {} on the shelf near the door", "kill the process that holds the {}", "we moved the {} twice before lunch"]
    mixed = ["you are a stupid zorbling fleeb, idiot", "shut up, moron, you grotty snarfle", "only a scumbag and zorbling fleeb does that"]
    unlisted = ["you are a zorbling fleeb", "what a grotty snarfle", "only a zorbling fleeb does that"]
    assert not {w for s in unlisted for w in s.split()} & (X.STRONG | X.MILD)
    rows = []
    for i in range(600):
        parts = [rng.choice(clean).format(rng.choice(things)) for _ in range(rng.randint(2, 8))]
        if i % 6 == 0:
            parts.insert(rng.randrange(len(parts)), rng.choice(mixed if i < 300 else unlisted))
        rows.append((i, ". ".join(parts) + ".", "s"))
    documents = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    model = X.train(documents, spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(300)], "doc_id bigint, toxic int"))
    found = {r.doc_id for r in X.toxicity_scores(documents, model).where("toxic AND doc_id >= 300").collect()}
    wanted = {i for i in range(300, 600) if i % 6 == 0}
    assert found <= wanted and len(found) >= 0.9 * len(wanted)


def test_fast_tokens_are_the_slow_ones():
    rng = random.Random(23)
    pieces = ["cup", "a", "I", "b.", "1d10t", "w.a.n.k.e.r", "s", "t", "u", "p", "\n", "end.", "...", "!?", "x-1", "<b>", "&", "IDIOT!!", "looooser", "\u00a0", "é", "5", "a<b"]
    spelling = X.Spelling(X.STRONG | X.MILD)
    for _ in range(400):
        text = " ".join(rng.choice(pieces) for _ in range(rng.randint(0, 25)))
        plain = X.unicodedata.normalize("NFKC", text).lower()
        assert X.tokens(text, spelling) == X._slow_tokens(X._TAG.sub("\n", plain) if "<" in plain else plain, spelling)


def test_without_labels_the_word_list_is_the_model(spark):
    documents = spark.createDataFrame([(1, "you pathetic idiot, go to hell, asshole", "a"), (2, "put the cup down", "a")], "doc_id bigint, text string, source string")
    model = X.train(documents, spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert {r.doc_id: r.toxic for r in X.toxicity_scores(documents, model).collect()} == {1: True, 2: False}
    assert X.toxicity_scores(documents.limit(0), model).count() == 0

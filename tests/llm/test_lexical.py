"""Ranked lexical search against brute force by loops."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from tessera.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(docs, items, top=50):
    bags = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    n, total = sum(b[2] > 0 for b in bags), sum(b[2] for b in bags)
    df = Counter(w for _, bag, _ in bags for w in bag)
    out = []
    for item, text in items:
        scored = []
        for i, bag, size in bags:
            m = 50 + 50 * size * n // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (1_000_000_000 * bag[w] // (1000 * bag[w] + 20 * m)) for w in set(terms(text)) if w in bag)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored, key=lambda x: x[:3])[:top], 1)]
    return sorted(out, key=repr)


def rows(df):
    assert [(f.name, f.dataType.simpleString()) for f in df.schema][1:] == [("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def made(spark):
    """Few words, so that scores tie; copies; a hot word in every document."""
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(30)]
    docs = [(i, "hot " + " ".join(rng.choice(words, int(rng.integers(1, 12))))) for i in range(300)] + [(i, "hot W1 w2, w3") for i in range(300, 400)]
    items = [(k, " ".join(rng.choice(words + ["unknown"], 6)) + (" hot" if k % 2 else "")) for k in range(12)]
    return docs, items


def test_search_matches_brute_force(spark, made, monkeypatch):
    docs, items = made
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    q = spark.createDataFrame(items, "item_id long, text string")
    assert rows(lexical.search(d, q)) == brute(docs, items)
    assert rows(lexical.search(d, q, top=3)) == brute(docs, items, 3)
    for name, value in (("PIECE", 50), ("STRETCH", 1), ("BLOCK_ITEMS", 6), ("GIVEN", 2), ("STEP_BYTES", 64)):
        monkeypatch.setattr(lexical, name, value)
        assert rows(lexical.search(d, q)) == brute(docs, items)
    monkeypatch.setattr(lexical, "VOCABULARY", 4)  # an index for each block
    assert rows(lexical.search(d, q)) == brute(docs, items)


def test_stops_early_and_reads_ties():
    """Lists stop as soon as no unseen document can reach the kth score, and not before all that tie with it are seen."""
    size = 2000
    score = np.concatenate((np.full(60, 900), np.full(10, 500), np.arange(size - 70)[::-1] % 400))
    piece = lexical.Piece(np.arange(size), np.ones(size, np.int64), np.zeros(size, np.int32), score.astype(np.int64))
    none, wanted = np.zeros(0, np.int64), np.ones(1, bool)
    found, key, read = piece.search(np.array([0]), wanted, none, none, 50)
    assert key.tolist() == list(range(50)) and set(found.tolist()) == {900} and 60 <= read < 200
    _, key, _ = piece.search(np.array([0]), wanted, np.full(50, 10_000), np.arange(50), 50)
    assert key.tolist() == list(range(50))


def test_search_cases(spark, odd):
    items = [(1, "a b"), (1, "a b"), (2, None), (3, ""), (4, "!!"), (None, "word token other"), (5, "日本 é"), (6, "absent")]
    q = spark.createDataFrame([(*r, 1, 2, "k") for r in items], "item_id long, text string, item long, score int, key string")
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    got = rows(lexical.search(odd, q))
    assert got == brute(docs, items)
    assert len([r for r in got if r[0] == 1]) == 2 * 4 and {r[0] for r in got} == {1, 5, None}
    assert rows(lexical.search(odd.limit(0), q)) == [] == rows(lexical.search(odd, q.limit(0)))
    assert rows(lexical.search(odd.filter("doc_id = 2"), q)) == []


def test_wide_numbers():
    """The length part exceeds 64 bits on its way; its quotient doesn't."""
    corpus = lexical.Corpus(10**12, 10**15, np.array([3]))
    got = corpus.impacts(np.array([0]), np.array([2]), np.array([10**9]))
    m = 50 + 50 * 10**9 * 10**12 // 10**15
    assert got.tolist() == [3 * (2_000_000_000 // (2000 + 20 * m))]

"""Ranked lexical search against a plain version."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from recordwarden.llm import lexical
from recordwarden.llm.words import words_of

from .helpers import empty_documents, odd_documents, read

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
CAPITALS = {c: c + 32 for c in range(65, 91)}


def plain_terms(text):
    return [] if text is None else [w.translate(CAPITALS) for w in TERM.findall(text)]


def plain_search(documents, items, k):
    """documents and items are (id, text); the result is per item, in order."""
    counts = [(i, Counter(plain_terms(t))) for i, t in documents]
    counts = [(i, c) for i, c in counts if c]
    total = sum(c.total() for _, c in counts)
    held = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for doc, c in counts:
            m = 50 + 50 * c.total() * len(counts) // total
            score = 0
            for term in set(plain_terms(text)):
                if c[term]:
                    weight = math.floor(1000 * math.log((2 * len(counts) + 2) / (2 * held[term] + 1)))
                    score += weight * (1_000_000_000 * c[term] // (1000 * c[term] + 20 * m))
            if score > 0:
                scores.append((-score, doc is None, doc or 0))
        out += [(item, rank, None if none else doc, -s) for rank, (s, none, doc) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def rows_of(found):
    return sorted((tuple(r) for r in found.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(
        [(1, "The QUICK fox, naïve café", 0), (2, None, 0), (3, "", 0), (4, "x" * 5000 + " one two", 0),
         (None, "brown words", 0), (1, "no such-term_here 日本語", 0), (1, "The QUICK fox, naïve café", 0)],
        "item_id long, text string, score int",
    )


def test_terms_match_the_pattern():
    rng = np.random.default_rng(0)
    for _ in range(300):
        text = "".join(map(chr, rng.choice([*range(0, 300), 0x3000, 0x1F642, 0x212A], 60)))
        assert [w.decode() for w in words_of(text.encode())] == plain_terms(text)


@pytest.mark.parametrize("k", [1, 3, 50])
def test_odd_rows(spark, items, k):
    docs = odd_documents(spark)
    pairs = [(r.doc_id, r.text) for r in docs.collect()]
    asked = [(r.item_id, r.text) for r in items.collect()]
    assert rows_of(lexical.ranked_documents(docs, items, k)) == plain_search(pairs, asked, k)


def test_empty_tables(spark, items):
    assert lexical.ranked_documents(empty_documents(spark), items).isEmpty()
    found = lexical.ranked_documents(odd_documents(spark), items.limit(0))
    assert found.isEmpty() and found.columns == ["item_id", "rank", "doc_id", "score"]


def test_small_segments_visits_and_blocks_change_nothing(spark, monkeypatch):
    documents, asked = read("documents"), read("benchmark")
    docs = spark.createDataFrame(documents[["doc_id", "text"]]).repartition(5)
    want = plain_search(documents[["doc_id", "text"]].values.tolist(), asked.values.tolist(), 7)
    monkeypatch.setattr(lexical, "SEGMENT_POSTINGS", 900)
    monkeypatch.setattr(lexical, "FIRST_VISIT", 2)
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 300)
    got = rows_of(lexical.ranked_documents(docs, spark.createDataFrame(asked), 7))
    assert got == [tuple(int(v) for v in row) for row in want]


def test_bounds_spare_documents():
    rng = np.random.default_rng(1)
    words = [f"w{i}".encode() for i in range(200)]
    rows = []
    for i in range(3000):
        n = int(rng.integers(1, 60))
        drawn = Counter(words[j] for j in np.minimum(rng.geometric(0.03, n), 200) - 1)
        rows.append((i, 50 + n, b" ".join(drawn), np.array(list(drawn.values()), "<i4").tobytes()))
    rows.sort(key=lambda r: r[1])
    batch = lexical._segment(rows)
    row = {n: batch.column(j)[0] for j, n in enumerate(batch.schema.names)}
    numbers = {w: i for i, w in enumerate(words)}
    weights = np.arange(1, 201) * 10
    segment = lexical.Segment(row, numbers, weights)
    best = lexical.Best(10)
    scored = lexical.search_segment(segment, [3, 50, 120], best)
    every = lexical.Best(10**6)
    assert lexical.search_segment(lexical.Segment(row, numbers, weights), [3, 50, 120], every) == 3000
    assert scored < 3000
    assert (best.scores == every.scores[:10]).all() and (best.ids == every.ids[:10]).all()

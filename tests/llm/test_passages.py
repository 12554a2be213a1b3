import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from recordwarden.llm import passages, queries

from .helpers import ODD_TEXTS, TABLES, empty_documents, odd_documents, read, rows_of


def plain(rows, window):
    """Rows (doc_id, text) by the definition."""
    first, words = {}, [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in words:
        if i is not None:
            for p in range(len(w) - window + 1):
                key = tuple(w[p:p + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if i is not None and first[tuple(w[p:p + window])] < i:
                gone[p:p + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=lambda r: [(v is not None, v) for v in r])


def found(df):
    return rows_of(df, "doc_id", "n_words", "n_removed", "kept_sha256")


def test_query(spark):
    docs = read("documents")
    assert found(queries.op9_repeated_passages(spark, TABLES)) == plain(zip(docs.doc_id.tolist(), docs.text), 50)


@pytest.mark.parametrize("seed", range(3))
def test_random_passages(spark, monkeypatch, seed):
    for name, words in {"LANE_WORDS": 200, "SHARD_WORDS": 150, "PART_WORDS": 12}.items():
        monkeypatch.setattr(passages, name, words)
    draw = np.random.default_rng(seed)
    common = [[f"c{draw.integers(0, 9)}" for _ in range(int(n))] for n in draw.integers(6, 60, 6)]
    rows = []
    for i in range(150):
        words = []
        for _ in range(int(draw.integers(0, 4))):
            words += [f"w{draw.integers(0, 400)}" for _ in range(int(draw.integers(0, 12)))]
            part = common[int(draw.integers(0, 6))]
            start = int(draw.integers(0, len(part)))
            words += part[start:start + int(draw.integers(3, 50))]
        rows.append((int(draw.integers(0, 140)), " ".join(words)))
    rows += [(500 + i, " ".join(common[0])) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(passages.remove_repeats(docs, window=10, anchor=3)) == plain(rows, 10)


def test_copies_of_one_text_are_dealt_to_lanes(spark):
    rows = [(i, "one two three four five" if i % 3 else f"w{i} two three four five six") for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert found(passages.remove_repeats(docs, window=3, anchor=2)) == plain(rows, 3)


def test_odd_rows(spark):
    assert found(passages.remove_repeats(odd_documents(spark), window=2)) == plain(ODD_TEXTS, 2)
    assert passages.remove_repeats(empty_documents(spark)).collect() == []


@settings(max_examples=300, deadline=None)
@given(
    st.lists(st.tuples(st.integers(0, 5), st.lists(st.integers(0, 3), max_size=20)), max_size=5),
    st.lists(st.integers(0, 4), max_size=30), st.integers(1, 8), st.integers(0, 6),
)
def test_matching_statistics(held, words, longest, before):
    automaton = passages.SuffixAutomaton()
    owners = {}
    for owner, text in held:
        automaton.add(text, owner)
        for i in range(len(text)):
            for j in range(i + 1, len(text) + 1):
                run = tuple(text[i:j])
                owners[run] = min(owners.get(run, owner), owner)
    for limit in (longest, 100):
        runs = [max(n for n in range(min(e + 1, limit) + 1) if n == 0 or tuple(words[e + 1 - n:e + 1]) in owners) for e in range(len(words))]
        assert automaton.matching_statistics(words, limit) == runs
        earlier = [
            n - 1 if n == limit and owners[tuple(words[e + 1 - n:e + 1])] >= before else n for e, n in enumerate(runs)
        ]
        assert automaton.matching_statistics(words, limit, before) == earlier


def test_long_monotonous_texts(spark, monkeypatch):
    """Every window is the same one: linear work, parts of one reference in several shards."""
    monkeypatch.setattr(passages, "PART_WORDS", 5_000)
    monkeypatch.setattr(passages, "SHARD_WORDS", 9_000)
    rows = [(1, "la " * 40_000), (2, "x " + "la " * 30_000 + "y"), (3, "la " * 49 + "z"), (2, "la " * 60), (4, "la " * 40_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {(1, 40_000): 0, (2, 30_002): 30_000, (3, 50): 0, (2, 60): 60, (4, 40_000): 40_000}
    assert {(i, n): gone for i, n, gone, _ in found(passages.remove_repeats(docs))} == want


def test_spans_merge():
    assert passages.spans([1, 2, 3, 3, 0, 1, 2, 3], 3) == [(0, 4), (5, 8)]
    assert passages.spans([3, 3, 3], 3) == [(-2, 3)]


def test_run_hashes_tell_runs_apart():
    hashes = passages.WordHashes()
    hashes.load(b"a b c a b c d")
    runs = hashes.runs(3)
    assert runs[0] == runs[3] and len(set(runs.tolist())) == 4
    assert hashes.anchors(5, 3).tolist() == [min(runs[i:i + 3].tolist()) for i in range(3)]

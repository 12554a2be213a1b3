"""FM-index decontamination against a plain version."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest

from recordwarden.llm import fm_index
from recordwarden.llm.words import words_of

from .helpers import empty_documents, odd_documents, read


def plain_spans(documents, items, window):
    """Per document: words, covered places, sorted item names."""
    phrases = {}
    for name, text in items:
        words = words_of((text or "").encode())
        for i in range(max(len(words) - window, 0) + 1 if words else 0):
            phrases.setdefault(tuple(words[i:i + window]), set()).add(None if name is None else str(name))
    sizes = {len(p) for p in phrases}
    out = []
    for doc, text in documents:
        words = words_of((text or "").encode())
        hit, names = set(), set()
        for size in sizes:
            for i in range(len(words) - size + 1):
                owners = phrases.get(tuple(words[i:i + size]))
                if owners:
                    hit |= set(range(i, i + size))
                    names |= owners
        out.append((doc, len(words), sorted(hit), sorted(names - {None})))
    return sorted(out, key=repr)


def rows_of(found):
    return sorted(
        ((r.doc_id, r.n_words, [w for s in r.spans for w in range(s.first, s.stop)], list(r["items"])) for r in found.collect()), key=repr
    )


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(
        [(1, "quick BROWN fox", 0), (2, None, 0), (3, " .\n", 0), (4, "wide space and more double lines end and then not", 0),
         (None, "two words", 0), (10, "the quick brown", 0), (10, "naïve café", 0), (1, "quick brown fox", 0), (5, "absent phrase", 0)],
        "item_id long, text string, shard int",
    )


@pytest.mark.parametrize("window", [1, 2, 10])
def test_odd_rows(spark, items, window):
    docs = odd_documents(spark)
    pairs = [(r.doc_id, r.text) for r in docs.collect()]
    asked = [(r.item_id, r.text) for r in items.collect()]
    assert rows_of(fm_index.contaminated_spans(docs, items, window)) == plain_spans(pairs, asked, window)


def test_empty_tables(spark, items):
    assert fm_index.contaminated_spans(empty_documents(spark), items).isEmpty()
    found = fm_index.digest(fm_index.contaminated_spans(odd_documents(spark), items.limit(0))).collect()
    assert len(found) == odd_documents(spark).count()
    assert {(r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found} == {(0, 0, hashlib.sha256(b"").hexdigest(), False)}


def test_many_shards_blocks_and_portions(spark, monkeypatch):
    documents, asked = read("documents"), read("benchmark")
    docs = spark.createDataFrame(documents[["doc_id", "text"]]).repartition(3)
    want = plain_spans(documents[["doc_id", "text"]].values.tolist(), asked.values.tolist(), 10)
    monkeypatch.setattr(fm_index, "SHARD_WORDS", 3000)
    monkeypatch.setattr(fm_index, "BLOCK_WORDS", 400)
    monkeypatch.setattr(fm_index, "LOCATED", 7)
    got = rows_of(fm_index.contaminated_spans(docs, spark.createDataFrame(asked)))
    assert [(int(d), n, h, i) for d, n, h, i in got] == [(int(d), n, h, i) for d, n, h, i in want]
    assert any(h for _, _, h, _ in got)


@pytest.mark.parametrize("seed", range(8))
def test_suffixes_ranks_and_places(seed):
    """Small alphabets, copies and empty documents: all suffixes in order, all places of all phrases."""
    rng = np.random.default_rng(seed)
    documents = [[b"w%d" % w for w in rng.integers(0, 1 + seed, int(rng.integers(0, 60)))] for _ in range(12)]
    documents += documents[:4]
    lengths = [len(d) for d in documents]
    batch = fm_index.build_shard(list(range(len(documents))), lengths, [w for d in documents for w in d])
    shard = fm_index.Shard({name: batch.column(j)[0] for j, name in enumerate(batch.schema.names)})
    text = [w for d in documents for w in (*d, b"")]
    named = [(str(k), [b"w%d" % w for w in rng.integers(0, 2 + seed, int(rng.integers(1, 6)))]) for k in range(40)]
    phrases = fm_index.Phrases.of(named, 5)
    found, low, high = shard.search(phrases.within(shard))
    places = {int(f): sorted(shard.locate(np.arange(a, b)).tolist()) for f, a, b in zip(found, low, high)}
    words = phrases.words.to_pylist()
    for i, row in enumerate(phrases.table):
        phrase = [words[w] for w in row if w >= 0]
        want = [p for p in range(len(text)) if text[p:p + len(phrase)] == phrase]
        assert places.get(i, []) == want


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(3)
    text = np.r_[rng.integers(0, 4, 400), np.tile(np.r_[rng.integers(1, 3, 90), 0], 5), 0].astype(np.int32)
    ends = np.cumsum(text == 0)
    keys = [[(0, int(ends[j])) if text[j] == 0 else (1, int(text[j])) for j in range(p, len(text))] for p in range(len(text))]
    assert fm_index.sort_suffixes(text).tolist() == sorted(range(len(text)), key=lambda p: keys[p])


def test_items_are_listed_as_sorted_strings():
    phrases = fm_index.Phrases.of([("10", [b"a", b"b"]), ("9", [b"a", b"b"]), (None, [b"b"])], 10)
    batch = fm_index.build_shard([7], [3], [b"b", b"a", b"b"])
    shard = fm_index.Shard({name: batch.column(j)[0] for j, name in enumerate(batch.schema.names)})
    row = fm_index.find_phrases(shard, phrases).to_pylist()[0]
    assert row["items"] == ["10", "9"] and row["spans"] == [{"first": 0, "stop": 3}]
    assert isinstance(phrases.words, pa.Array)

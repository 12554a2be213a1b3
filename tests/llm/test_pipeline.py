"""The pipeline against the stages done plainly, each on what the stage before really kept."""

from collections import Counter

import numpy as np

import corpus_pipeline as pipeline
from recordwarden.llm import queries
from recordwarden.llm.common import staged

from .helpers import TABLES, empty_documents, odd_documents
from .test_secrets import plain_base
from .test_simhash import plain_components, plain_simhash


def run_stages(spark, docs, sf_dir=TABLES):
    """What every stage was given and returned."""
    steps = []
    for name, stage in pipeline.STAGES:
        out = staged(stage(spark, docs, sf_dir), "step")
        steps.append((docs, out))
        docs = out
    return steps


def texts(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_stages(spark):
    source = queries.documents(spark, TABLES)
    quality, dedup, secret, mix, packing = run_stages(spark, source)
    for given, out in (quality, dedup, secret, mix):
        assert out.columns == source.columns

    grades = {r.doc_id: r.grade for r in queries.ratings(spark, TABLES).collect()}
    kept = {r.doc_id for r in quality[1].collect()}
    assert texts(quality[1]) <= texts(source)
    assert all(i in kept for i, g in grades.items() if g == 2)
    assert all(i not in kept for i, g in grades.items() if g == 0)

    given = sorted(dedup[0].collect(), key=lambda r: r.doc_id)
    ids = [r.doc_id for r in given]
    roots = plain_components(ids, [plain_simhash(r.text) for r in given])
    assert {r.doc_id for r in dedup[1].collect()} == {i for i, root in zip(ids, roots) if i == root}

    before = {r.doc_id: r for r in secret[0].collect()}
    after = {r.doc_id: r for r in secret[1].collect()}
    assert set(before) == set(after)
    for i, r in after.items():
        assert not plain_base(r.text)
        if r.text == before[i].text:
            assert r == before[i]
        else:
            assert "<SECRET>" in r.text and r.n_chars == len(r.text)

    uses = texts(mix[1])
    assert set(uses) == set(texts(mix[0])) and set(uses.values()) <= {1, 2}

    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(queries.vocabulary())
    n_ids = sum(len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for (_, t), n in uses.items() for _ in range(n))
    pieces = packing[1].collect()
    assert sum(r.length for r in pieces) == n_ids
    held = {}
    for r in pieces:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in held.values():
        places.sort()
        assert [o for o, _ in places] == list(np.cumsum([0] + [n for _, n in places])[:-1])
        assert sum(n for _, n in places) <= 1024


def test_run_equals_its_stages(spark):
    rows = [sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in df.collect())
            for df in (pipeline.run(spark, TABLES), run_stages(spark, queries.documents(spark, TABLES))[-1][1])]
    assert rows[0] == rows[1] and rows[0]


def test_odd_and_empty_documents(spark):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    steps = run_stages(spark, odd_documents(spark).select(*columns))
    assert steps[-1][1].count() > 0
    for given, out in run_stages(spark, empty_documents(spark).select(*columns)):
        assert out.count() == 0

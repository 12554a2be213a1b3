from collections import Counter, defaultdict
from math import log

import numpy as np
import pytest

from recordwarden.llm import mixing, quality, queries

from .helpers import ODD_TEXTS, TABLES, empty_documents, odd_documents, read

SMALL = "/root/testdata/sf0.1"


def test_held_out_grades(spark):
    docs, rated = queries.documents(spark, SMALL), queries.ratings(spark, SMALL).where("grade IS NOT NULL")
    model = quality.train(docs.where("doc_id % 4 > 0"), rated)
    scored = quality.score(docs.where("doc_id % 4 = 0"), model).join(rated, "doc_id").select("grade", "keep", "expected_grade").collect()
    kept = {g: np.mean([r.keep for r in scored if r.grade == g]) for g in range(3)}
    assert kept[2] >= 0.99 and kept[0] <= 0.25 and kept[1] <= 0.3
    mean = [np.mean([r.expected_grade for r in scored if r.grade == g]) for g in range(3)]
    assert mean == sorted(mean)


def test_fit_learns_ordered_thresholds():
    draw = np.random.default_rng(0)
    rows, grades = [], []
    for _ in range(900):
        g = int(draw.integers(0, 3))
        rows.append(np.array(sorted({g, *draw.integers(10, 60, 5).tolist()}), dtype=np.int32))
        grades.append(g)
    model = quality.fit(rows, np.array(grades))
    assert (np.diff(model.thresholds) > 0).all()
    tails = np.array([model.tails(model.weights[x].sum()) for x in rows])
    assert (tails[:, 0] >= tails[:, 1]).all()
    assert np.mean((tails >= 0.5).sum(axis=1) == grades) > 0.97


def test_quality_odd_rows(spark):
    ratings = spark.createDataFrame([(1, 2), (1, 0), (8, 1), (None, 0), (4, None), (99, 1)], "doc_id long, grade int")
    docs = odd_documents(spark)
    scored = quality.score(docs, quality.train(docs, ratings))
    assert scored.columns == [*docs.columns, "expected_grade", "tail", "keep"]
    assert Counter((r.doc_id, r.text) for r in scored.collect()) == Counter(ODD_TEXTS)
    unrated = quality.train(docs, ratings.limit(0))
    assert all(r.keep for r in quality.score(docs, unrated).collect())
    assert quality.score(empty_documents(spark), unrated).collect() == []


def test_quality_query_scores_every_document(spark):
    found = queries.op8_ordinal_quality(spark, TABLES).collect()
    assert sorted(r.doc_id for r in found) == sorted(read("documents").doc_id)
    assert all(0 <= r.tail <= r.expected_grade <= 2 and r.keep == (r.tail >= 0.5) for r in found)


# --- mixing ----------------------------------------------------------------------

def plain_tokens(text):
    return len((text or "").encode().split()) + 1


def plain_exponent(tokens, target):
    share = np.array(tokens) / sum(tokens)

    def weights(a):
        return share**a / (share**a).sum()

    def too_flat(a):
        w = weights(a)
        if target.entropy is not None:
            return -(w * np.log(w)).sum() > target.entropy
        scale = target.budget_tokens / sum(tokens) if target.budget_tokens else 1 / (w / share).min()
        return (w / share).max() * scale > target.repetitions

    low, high = 0.0, 16.0 if target.entropy is not None else 1.0
    if not too_flat(low):
        return low
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if too_flat(middle) else (low, middle)
    return high


@pytest.mark.parametrize("target", [
    mixing.Target(entropy=1.0), mixing.Target(entropy=log(4)), mixing.Target(entropy=0.2), mixing.Target(repetitions=3.0),
    mixing.Target(repetitions=1.0), mixing.Target(repetitions=2.0, budget_tokens=900), mixing.Target(repetitions=100.0),
])
def test_exponent(spark, target):
    tokens = [600, 250, 100, 50]
    rows = spark.createDataFrame([(f"s{k}", n) for k, n in enumerate(tokens)], "source string, tokens long")
    found = mixing.bisect_exponent(mixing.source_totals(rows), target)
    assert found == pytest.approx(plain_exponent(tokens, target), abs=1e-7)


def check_stream(found, sizes, target, exponent):
    """Whole epochs, quotas, and each block's share of every source."""
    tokens = Counter()
    for (_, source), n in sizes.items():
        tokens[source] += n
    share = {s: n / tokens.total() for s, n in tokens.items()}
    z = sum(v**exponent for v in share.values())
    weight = {s: v**exponent / z for s, v in share.items()}
    budget = target.budget_tokens or tokens.total() / min(weight[s] / share[s] for s in share)
    used, uses = Counter(), Counter()
    for r in found:
        assert r.tokens == sizes[r.doc_id, r.source]
        used[r.source] += r.tokens
        uses[r.doc_id, r.source, r.epoch] += 1
    assert set(uses.values()) == {1}
    longest = max(sizes.values())
    for s in share:
        assert abs(used[s] - weight[s] * budget) <= longest
    epochs = defaultdict(set)
    for doc_id, source, epoch in uses:
        epochs[doc_id, source].add(epoch)
    for key, held in epochs.items():
        assert held == set(range(len(held)))
    for s in share:
        n = [len(epochs.get(k, ())) for k in sizes if k[1] == s]
        assert max(n) - min(n) <= 1
    for block in {r.block for r in found}:
        assert sorted(r.slot for r in found if r.block == block) == list(range(sum(r.block == block for r in found)))
    return weight, budget


def test_mix_query(spark):
    docs = read("documents")
    sizes = {(i, s): plain_tokens(t) for i, s, t in zip(docs.doc_id, docs.source, docs.text)}
    tokens = Counter()
    for (_, s), n in sizes.items():
        tokens[s] += n
    found = queries.op6_temperature_mix(spark, TABLES).collect()
    check_stream(found, sizes, queries.MIXTURE, plain_exponent(list(tokens.values()), queries.MIXTURE))
    assert {r.doc_id for r in found} == set(docs.doc_id)
    assert max(r.epoch for r in found) <= 1


def test_blocks_hold_every_source_in_its_share(spark):
    rows = [(i, "w " * 9, f"s{0 if i % 10 < 6 else i % 10 - 5}") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    target = mixing.Target(entropy=1.4, budget_tokens=30_000)
    found = mixing.mixed_stream(docs, target, block_tokens=6000).collect()
    tokens = Counter()
    for _, _, s in rows:
        tokens[s] += 10
    weight, budget = check_stream(found, {(i, s): 10 for i, _, s in rows}, target, plain_exponent(list(tokens.values()), target))
    per_block = Counter((r.block, r.source) for r in found)
    assert {b for b, _ in per_block} == set(range(5))
    for (_, s), n in per_block.items():
        assert abs(10 * n - weight[s] * budget / 5) <= 20


def test_mixing_odd_rows(spark):
    docs = odd_documents(spark)
    mixed = mixing.mixed_documents(docs, mixing.Target(repetitions=2.0))
    assert mixed.columns == docs.columns
    before, after = (Counter((r.doc_id, r.text, r.source) for r in d.collect()) for d in (docs, mixed))
    assert set(before) == set(after) and all(before[k] <= after[k] <= 2 * before[k] for k in before)
    nulls = docs.withColumn("source", queries.F.when(queries.F.col("doc_id") > 4, queries.F.col("source")))
    assert {r.source for r in mixing.mixed_documents(nulls, mixing.Target(repetitions=2.0)).collect()} >= {None}
    for function in (mixing.mixed_documents, mixing.mixed_stream):
        assert function(empty_documents(spark), mixing.Target(repetitions=2.0)).collect() == []
    with pytest.raises(ValueError):
        mixing.Target()

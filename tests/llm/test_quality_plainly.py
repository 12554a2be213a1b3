"""The quality classifier against plain versions of its features, scores and likelihood."""

from itertools import groupby
from math import exp, log

import numpy as np
import pytest
import xxhash

from recordwarden.llm import quality, queries

from .helpers import ODD_TEXTS, TABLES, read


def slot(feature):
    return xxhash.xxh32(feature.encode()).intdigest() % quality.DIMENSIONS


def words_in(token):
    kinds = groupby(token.lower(), lambda c: c.isalnum() and not c.isdecimal())
    return ["".join(run) for letters, run in kinds if letters]


def shape_of(token):
    signs = ["A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in token[:200]]
    return "".join(sign for sign, _ in groupby(signs))[:12]


def plain_features(text):
    names = set()
    tokens = text.split()
    for token in tokens:
        names.add("shape " + shape_of(token))
        for word in words_in(token):
            names.add("word " + word)
            names |= {"start " + word[:n] for n in (4, 5) if len(word) > n}
    lines = [x for x in text.split("\n") if x.strip()]
    data = text.encode()
    upper = sum(65 <= b <= 90 for b in data)
    letters = upper + sum(97 <= b <= 122 or b >= 128 for b in data)
    digits = sum(48 <= b <= 57 for b in data)
    space = sum(9 <= b <= 13 or b == 32 for b in data)
    n, size = max(1, len(tokens)), max(1, len(data))
    shares = {
        "distinct words": len(set(tokens)) / n,
        "distinct lines": len(set(lines)) / max(1, len(lines)),
        "symbols": (size - letters - digits - space) / size,
        "capitals": upper / max(1, letters),
        "digits": digits / size,
        "words ending in symbols": sum(not (t[-1].isalnum() or t[-1] in ".,;:?") for t in tokens) / n,
        "capital words": sum(t.isupper() for t in tokens) / n,
        "length": min(1.0, n / 200),
    }
    for name, share in shares.items():
        names |= {f"share {name} {k}" for k in range(1, 21) if share + 1e-10 >= k / 20}
    return {slot(f) for f in names}


def plain_tails(model, slots):
    score = sum(model.weights[i] for i in slots)
    return [1 / (1 + exp(t - score)) for t in model.thresholds]


def test_features_are_those_of_the_plain_version():
    features = quality.Features()
    odd = ["", " \n ", "AAA bbb! 12-34 x_y don't", "Größe ÄÖ 日本語 a1b2", "a\nb\na\n\n", "!!! ??? ...", "Word " * 300, "q" * 5000]
    texts = odd + [t or "" for _, t in ODD_TEXTS] + read("documents").text.fillna("").tolist()[:400]
    for text in texts:
        assert set(features.of(text).tolist()) == plain_features(text), text[:80]


def test_forgetting_tokens_changes_nothing(monkeypatch):
    monkeypatch.setattr(quality, "REMEMBERED", 3)
    features = quality.Features()
    for text in read("documents").text.fillna("").tolist()[:100]:
        assert set(features.of(text).tolist()) == plain_features(text)


@pytest.mark.parametrize("seed", range(3))
def test_one_step_follows_the_likelihood(seed):
    """One batch, one epoch: the step is that of AdaGrad along differences of the plain likelihood."""
    draw = np.random.default_rng(seed)
    rows = [np.array(sorted(set(draw.integers(0, 9, 4).tolist())), dtype=np.int32) for _ in range(60)]
    grades = draw.integers(0, 3, 60)
    below = [(sum(grades <= k) + 0.5) / 61 for k in (0, 1)]
    start = np.array([log(p / (1 - p)) for p in below])

    def loss(weights, thresholds):
        total = 0.0
        for x, y in zip(rows, grades):
            s = sum(weights[i] for i in x)
            at_most = [0.0, *(1 / (1 + exp(s - t)) for t in thresholds), 1.0]
            total -= log(at_most[y + 1] - at_most[y])
        return total / len(rows)

    def slope(f, at, i, h=1e-5):
        up, down = at.copy(), at.copy()
        up[i] += h
        down[i] -= h
        return (f(up) - f(down)) / (2 * h)

    def step(g):
        return -0.3 * g / np.sqrt(1e-3 + g * g)

    zero = np.zeros(9)
    model = quality.fit(rows, grades, epochs=1, batch=60, rate=0.3, least_rows=1)
    weights = np.array([step(slope(lambda w: loss(w, start), zero, i)) for i in range(9)])
    levels = start + np.array([step(slope(lambda t: loss(zero, t), start, k)) for k in range(2)])
    assert np.allclose(model.weights[:9], weights, atol=1e-5) and not model.weights[9:].any()
    assert np.allclose(model.thresholds, np.sort(levels), atol=1e-5)


def test_query_scores_as_the_plain_version(spark):
    docs = read("documents")
    model = quality.train(queries.documents(spark, TABLES), queries.ratings(spark, TABLES))
    found = {r.doc_id: r for r in queries.op8_ordinal_quality(spark, TABLES).collect()}
    for doc_id, text in zip(docs.doc_id.tolist(), docs.text.fillna("")):
        tails = plain_tails(model, plain_features(text))
        row = found[doc_id]
        assert abs(row.tail - tails[1]) < 1e-9 and abs(row.expected_grade - sum(tails)) < 1e-9
        assert row.keep == (row.tail >= 0.5)

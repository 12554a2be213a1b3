"""Quality grades by ordinal cumulative-link regression on hashed text.

Ratings are ordered grades. One weight per hashed feature gives a document's score s, shared by all
grades, and ordered thresholds t give P(grade <= k) = sigmoid(t_k - s). Expected grade and the
probability of reaching a grade follow; the latter selects.

The model is fitted on the driver from a bounded sample of rated documents (`sample_rows`, those
with the lowest hash of their id); every document is scored whole.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, text_bytes

#: Hashed features.
DIMENSIONS = 1 << 18
SAMPLE_ROWS = 12_000
#: Distinct tokens whose features a worker remembers.
REMEMBERED = 200_000
SHARES = ("distinct words", "distinct lines", "symbols", "capitals", "digits", "words ending in symbols", "capital words", "length")


def _slot(feature: str) -> int:
    return xxhash.xxh32_intdigest(feature) % DIMENSIONS


class Features:
    """The set of hashed features of a text: words, their beginnings, token shapes, and shares in steps of 1/20."""

    def __init__(self) -> None:
        self._known: dict[str, tuple[tuple[int, ...], bool, bool]] = {}
        self._word = re.compile(r"[^\W\d_]+")
        self._run = re.compile(r"(.)\1+")
        self._steps = [[_slot(f"share {name} {k}") for k in range(1, 21)] for name in SHARES]

    def _token(self, token: str) -> tuple[tuple[int, ...], bool, bool]:
        found = []
        for word in self._word.findall(token.lower()):
            found.append("word " + word)
            found += [f"start {word[:n]}" for n in (4, 5) if len(word) > n]
        shape = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in token[:200])
        found.append("shape " + self._run.sub(r"\1", shape)[:12])
        return tuple(map(_slot, found)), not (token[-1].isalnum() or token[-1] in ".,;:?"), token.isupper()

    def of(self, text: str) -> np.ndarray:
        tokens = Counter(text.split())
        if len(self._known) > REMEMBERED:
            self._known = {}
        found: set[int] = set()
        symbols = capitals = 0
        for token, n in tokens.items():
            known = self._known.get(token)
            if known is None:
                known = self._known[token] = self._token(token)
            found.update(known[0])
            symbols += n * known[1]
            capitals += n * known[2]
        total = max(1, tokens.total())
        lines = [line for line in text.split("\n") if line and not line.isspace()]
        octets = np.bincount(np.frombuffer(text.encode(), dtype=np.uint8), minlength=256)
        size = max(1, int(octets.sum()))
        upper, digits = int(octets[65:91].sum()), int(octets[48:58].sum())
        letters = upper + int(octets[97:123].sum()) + int(octets[128:].sum())
        space = int(octets[9:14].sum() + octets[32])
        shares = (
            len(tokens) / total, len(set(lines)) / max(1, len(lines)), (size - letters - digits - space) / size,
            upper / max(1, letters), digits / size, symbols / total, capitals / total, min(1.0, total / 200),
        )
        for steps, share in zip(self._steps, shares):
            found.update(steps[: int(20 * share + 1e-9)])
        return np.fromiter(sorted(found), dtype=np.int32, count=len(found))


@dataclass
class OrdinalModel:
    """Shared weights and ascending thresholds; grades 0 to len(thresholds)."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: float) -> np.ndarray:
        """P(grade >= k) for k from 1."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - score, -60, 60)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(
    rows: list[np.ndarray], grades: np.ndarray, levels: int = 3, epochs: int = 16, batch: int = 256,
    rate: float = 0.3, least_rows: int = 3, seed: int = 0,
) -> OrdinalModel:
    """Maximum likelihood by AdaGrad over mini-batches.

    Features of fewer than `least_rows` rows get no weight. Thresholds start at the shares of the
    grades; without rows every document is of the highest grade.
    """
    weights = np.zeros(DIMENSIONS)
    if not rows:
        return OrdinalModel(weights, np.full(levels - 1, -20.0))
    below = (np.bincount(grades, minlength=levels).cumsum()[:-1] + 0.5) / (len(rows) + 1)
    thresholds = np.log(below / (1 - below))
    seen = np.zeros(DIMENSIONS, dtype=np.int64)
    for x in rows:
        seen[x] += 1  # a row has a feature once
    kept = seen >= least_rows
    rows = [x[kept[x]] for x in rows]
    power, level_power = np.full(DIMENSIONS, 1e-3), np.full(levels - 1, 1e-3)
    draw = np.random.default_rng(seed)
    for _ in range(epochs):
        for chosen in np.array_split(draw.permutation(len(rows)), max(1, len(rows) // batch)):
            own = np.repeat(np.arange(len(chosen)), [len(rows[i]) for i in chosen])
            slots = np.concatenate([rows[i] for i in chosen])
            score = np.bincount(own, weights[slots], minlength=len(chosen))
            y = grades[chosen]
            bounds = _sigmoid(thresholds[None, :] - score[:, None])
            padded = np.concatenate([np.zeros((len(chosen), 1)), bounds, np.ones((len(chosen), 1))], axis=1)
            at = np.arange(len(chosen))
            upper, lower = padded[at, y + 1], padded[at, y]
            share = np.maximum(upper - lower, 1e-9)
            upper_slope, lower_slope = upper * (1 - upper) / share, lower * (1 - lower) / share
            # Gradients of the mean negative log-likelihood.
            by_score = (upper_slope - lower_slope) / len(chosen)
            by_level = np.array([lower_slope[y == k + 1].sum() - upper_slope[y == k].sum() for k in range(levels - 1)]) / len(chosen)
            by_weight = np.bincount(slots, by_score[own], minlength=DIMENSIONS)
            touched = np.flatnonzero(by_weight)
            power[touched] += by_weight[touched] ** 2
            weights[touched] -= rate * by_weight[touched] / np.sqrt(power[touched])
            level_power += by_level**2
            thresholds = np.sort(thresholds - rate * by_level / np.sqrt(level_power))
    return OrdinalModel(weights, thresholds)


def grade_column() -> Column:
    """0 for toxic, 1 for low quality, 2 for good; null where a rating is missing."""
    return F.when(F.col("toxic") == 1, 0).when((F.col("toxic") == 0) & (F.col("quality") == 0), 1).when(
        (F.col("toxic") == 0) & (F.col("quality") == 1), 2
    )


def train(docs: DataFrame, ratings: DataFrame, levels: int = 3, sample_rows: int = SAMPLE_ROWS) -> OrdinalModel:
    """Fit on the documents that `ratings` (doc_id, grade) grades, at most `sample_rows` ratings.

    A document rated more than once has its lowest grade. The sample is broadcast: it has at most
    `sample_rows` rows of two numbers.
    """
    rated = ratings.where("doc_id IS NOT NULL AND grade IS NOT NULL").groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade"))
    sample = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)

    def compute(batches):
        features = Features()
        for batch in batches:
            found = [features.of(t.decode()).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.binary())], ["doc_id", "grade", "slots"])

    texts = docs.select("doc_id", text_bytes().alias("text")).join(F.broadcast(sample), "doc_id").select("doc_id", "text", "grade")
    table = texts.mapInArrow(compute, "doc_id long, grade int, slots binary").toArrow()
    # The same order whatever the partitions; rows are views of the table's own memory.
    table = table.sort_by([("doc_id", "ascending"), ("slots", "ascending")]).combine_chunks()
    rows = [np.frombuffer(x.as_buffer(), dtype=np.int32) for x in table.column("slots")]
    return fit(rows, table.column("grade").to_numpy().astype(np.int64), levels)


def score(docs: DataFrame, model: OrdinalModel, least: int = 2, least_tail: float = 0.5) -> DataFrame:
    """`docs` with expected_grade, tail (the probability of grade `least` or better) and keep.

    Every row is scored by its whole text, null counting as empty. The scores replace columns of
    the same names.
    """

    def compute(batches):
        features = Features()
        for batch in batches:
            tails = np.array([model.tails(model.weights[features.of(t.decode())].sum()) for t in batch.column(text).to_pylist()])
            tails = tails.reshape(-1, len(model.thresholds))
            kept = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(tails.sum(axis=1)), pa.array(tails[:, least - 1]), pa.array(tails[:, least - 1] >= least_tail)],
                [*names, "expected_grade", "tail", "keep"],
            )

    source = docs.drop("expected_grade", "tail", "keep")
    names = source.columns
    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema), "expected_grade double, tail double, keep boolean"])
    text, = free_names(source, "text_bytes")
    return source.withColumn(text, text_bytes()).mapInArrow(compute, kinds)

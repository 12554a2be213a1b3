"""Embedding near-duplicates by Euclidean p-stable hashing.

A normalised vector is projected on random Gaussian directions; each projection is shifted at
random and cut into steps of `width`. `concatenated` steps form the key of a table, and vectors that
share a key in any of the tables are compared exactly. Both numbers follow from the wanted recall
at the threshold and the number of vectors.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, erf, exp, log, pi, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, staged
from .vectors import fold, matrix, vector_rows

WIDTH = 2.0
RECALL = 0.95
#: Unrelated vectors wanted in a bucket; more of them cost time, not results.
BUCKET_ROWS = 32
#: Vectors that one task compares at a time.
CELL_ROWS = 8192
#: A bucket above this size is compared block against block.
BLOCK_ROWS = 1024


def collision(distance: float, width: float) -> float:
    """The chance that two vectors at a distance fall into the same step of a projection."""
    if distance == 0:
        return 1.0
    t = width / distance
    return erf(t / sqrt(2)) - 2 / (sqrt(2 * pi) * t) * (1 - exp(-t * t / 2))


@dataclass
class Tables:
    """directions (tables x concatenated, dimension), shifts, and mixers that fold steps into a key."""

    count: int
    concatenated: int
    directions: np.ndarray
    shifts: np.ndarray
    mixers: np.ndarray
    width: float

    def keys(self, x: np.ndarray) -> np.ndarray:
        """One 32-bit key per row and table. Vectors whose keys clash by chance are only compared in vain."""
        norms = np.linalg.norm(x, axis=1, keepdims=True)
        steps = np.floor((x / norms @ self.directions.T + self.shifts) / self.width).astype(np.int64).astype(np.uint64)
        mixed = (steps * self.mixers).reshape(len(x), self.count, self.concatenated).sum(axis=2, dtype=np.uint64)
        mixed ^= mixed >> np.uint64(29)
        return (mixed * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def make_tables(rows: int, dimension: int, cosine: float, recall: float = RECALL, width: float = WIDTH, seed: int = 11) -> Tables:
    near, far = collision(sqrt(2 - 2 * cosine), width), collision(sqrt(2), width)
    concatenated = max(1, ceil(log(max(rows, 2) / BUCKET_ROWS) / -log(far)))
    hit = near**concatenated
    count = max(1, ceil(log(1 - recall) / log(1 - hit))) if hit < 1 else 1
    draw = np.random.default_rng(seed)
    n = count * concatenated
    return Tables(
        count, concatenated, draw.normal(size=(n, dimension)), draw.uniform(0, width, n),
        draw.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), width,
    )


def _hashed(classes: DataFrame, tables: Tables) -> DataFrame:
    """(rep, n, v, keys) with one key per table."""

    def compute(batches):
        for batch in batches:
            keys = tables.keys(matrix(batch.column(2))) if batch.num_rows else np.empty((0, tables.count), np.int32)
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(0, keys.size + 1, tables.count, dtype=np.int32)), pa.array(keys.ravel())
            )
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], ["rep", "n", "v", "keys"])

    kind = classes.schema["v"].dataType.simpleString()
    return classes.select("rep", "n", "v").mapInArrow(compute, f"rep long, n long, v {kind}, keys array<int>")


def _linked(x: np.ndarray, y: np.ndarray, cosine: float) -> np.ndarray:
    return x @ y.T >= cosine


def _first_meeting(keys_x: np.ndarray, keys_y: np.ndarray, table: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether pairs share no key in an earlier table, so that each pair is counted once."""
    first = np.ones(len(i), dtype=bool)
    for t in range(table):
        alive = np.flatnonzero(first)
        if not len(alive):
            break
        first[alive] = keys_x[i[alive], t] != keys_y[j[alive], t]
    return first


def _labels(linked: np.ndarray, names: np.ndarray) -> np.ndarray:
    """The smallest name each row reaches by the links of a symmetric matrix."""
    i, j = np.nonzero(linked)
    labels = names.copy()
    while len(i):
        following = labels.copy()
        np.minimum.at(following, i, labels[j])
        if (following == labels).all():
            break
        labels = following
    return labels


def _cell(cosine: float):
    """Links within the buckets, or between the two blocks, of a cell: (rep, links, joined)."""

    def compute(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["table", "bucket", "first", "second", "rep"], kind="stable")
        x = np.array(rows.v.tolist(), dtype=np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        keys = np.array(rows["keys"].tolist(), dtype=np.int32)
        reps, n = rows.rep.to_numpy(), rows.n.to_numpy()
        links = np.zeros(len(rows), dtype=np.int64)
        joined = reps.copy()
        own = rows[["table", "bucket", "first", "second"]].to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]).any(axis=1)]))
        for start, end in zip(starts, [*starts[1:], len(rows)]):
            if end - start < 2:
                continue
            table, _, first, second = own[start]
            part = slice(start, end)
            linked = _linked(x[part], x[part], cosine)
            np.fill_diagonal(linked, False)
            if first != second:  # two blocks of a large bucket: only pairs between them
                side = rows.block.to_numpy()[part] == first
                linked &= side[:, None] != side[None, :]
            if not linked.any():
                continue
            joined[part] = np.minimum(joined[part], _labels(linked, reps[part]))
            i, j = np.nonzero(np.triu(linked))
            new = _first_meeting(keys[part], keys[part], table, i, j)
            i, j = i[new], j[new]
            np.add.at(links, start + i, n[start + j])
            np.add.at(links, start + j, n[start + i])
        out = pd.DataFrame({"rep": reps, "links": links, "joined": joined})
        return out[(out.links > 0) | (out.joined != out.rep)].groupby(["rep", "joined"], as_index=False).links.sum()[["rep", "links", "joined"]]

    return compute


def vector_groups(embeddings: DataFrame, cosine: float = 0.9, recall: float = RECALL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of `embeddings`, whatever its label.

    Pairs with a cosine of at least `cosine` are found with the chance `recall` at the threshold and
    more above it; none below it is linked. A vector that is null, empty, zero or holds null or
    non-finite components, or is not of the most frequent length, links with nothing, not even its
    copies, and is its own component. Rows that share an id count as one vector if they are equal,
    and else are separate vectors of one component. A row without an id has null results.
    """
    rows = vector_rows(embeddings)
    classes, members = fold(rows)
    first = classes.limit(1).collect()
    everything = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"))
    if not first:
        return everything.select(
            "vec_id", F.when(F.col("vec_id").isNotNull(), F.lit(0)).cast("long").alias("n_links"),
            F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"),
        )
    tables = make_tables(classes.count(), len(first[0].v), cosine, recall)
    hashed = staged(_hashed(classes, tables), "hashed_vectors")
    keyed = hashed.select("rep", F.posexplode("keys").alias("table", "bucket"))
    buckets = keyed.groupBy("table", "bucket").agg(F.count("*").alias("size")).where("size > 1")
    buckets = buckets.withColumn("blocks", F.when(F.col("size") > 2 * BLOCK_ROWS, F.ceil(F.col("size") / BLOCK_ROWS)).otherwise(1).cast("int"))
    met = staged(keyed.join(buckets, ["table", "bucket"]), "vector_buckets")
    cells = max(1, ceil(met.where("blocks = 1").count() / CELL_ROWS))
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    # Each block meets itself and every other block of its bucket once.
    pairs = met.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "rep", "table", "bucket", "block", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"),
        F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("table", "bucket"), F.lit(cells))).otherwise(
            cells + F.pmod(F.xxhash64("table", "bucket", F.least("block", "other"), F.greatest("block", "other")), F.lit(2**40))
        ).alias("cell"),
    )
    found = pairs.join(hashed, "rep").groupBy("cell").applyInPandas(_cell(cosine), "rep long, links long, joined long")
    found = staged(found, "vector_links")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = connected_components(found.where("rep <> joined").select(F.col("rep").alias("a"), F.col("joined").alias("b")).union(
        members.groupBy("vec_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b").select("a", "b")
    ))
    results = classes.select("rep", "n").join(counts, "rep", "left").join(
        roots.withColumnRenamed("node", "rep"), "rep", "left"
    ).select(
        F.col("rep").alias("held"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        F.coalesce("root", "rep").alias("component_id"),
    )
    per_id = members.join(results, F.col("rep") == F.col("held")).groupBy("vec_id").agg(
        F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id")
    ).withColumnRenamed("vec_id", "id")
    return everything.join(per_id, F.col("vec_id") == F.col("id"), "left").select(
        "vec_id", F.when(F.col("vec_id").isNotNull(), F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.coalesce("component_id", "vec_id") == F.col("vec_id"), F.lit(False)).alias("kept"),
    )

"""Approximate nearest neighbours by inner product: a forest of random-projection trees.

The trees are fitted on a bounded sample; every vector is then routed to one leaf of each tree. A
query walks all trees through one priority queue, always into the node whose splits it violates
least, until the leaves it reached hold enough rows. The candidates in those leaves are scored
exactly.

How many rows are enough is measured, not set: some queries are compared with every vector, and the
walk is as long as they need to reach the wanted share of their nearest. Vectors with structure are
found in few leaves; those without any need most of them.

For inner products each vector x gets one more component sqrt(M^2 - |x|^2), M being the greatest
norm, which makes the nearest by angle the one with the largest inner product.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from itertools import takewhile

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged
from .vectors import fold, matrix, smallest_members, vector_rows

TREES = 6
SAMPLE_ROWS = 16_384
#: Sample rows in a leaf; a leaf holds about rows x LEAF_SAMPLE / SAMPLE_ROWS vectors.
LEAF_SAMPLE = 48
#: The share of the nearest to find, and the queries on which the length of the walk is measured.
TARGET_RECALL = 0.99
TRIED_QUERIES = 128
#: Vectors (by their size as doubles) and queries that one task compares at a time.
CELL_BYTES, CELL_QUERIES = 16 << 20, 4096


@dataclass
class Tree:
    """Splits by number: direction, offset, and the two children (a leaf k is -k - 1)."""

    directions: np.ndarray
    offsets: np.ndarray
    children: np.ndarray
    root: int
    leaves: int


def grow_tree(sample: np.ndarray, leaf_rows: int, draw: np.random.Generator) -> Tree:
    """Splits at the median along random directions until a node has at most `leaf_rows` rows."""
    directions, offsets, children = [], [], []
    leaves = 0

    def split(rows: np.ndarray) -> int:
        nonlocal leaves
        if len(rows) > leaf_rows:
            direction = draw.normal(size=sample.shape[1])
            direction /= np.linalg.norm(direction)
            along = sample[rows] @ direction
            offset = float(np.median(along))
            right = along > offset
            if right.any() and not right.all():
                node = len(directions)
                directions.append(direction)
                offsets.append(offset)
                children.append((0, 0))
                children[node] = (split(rows[~right]), split(rows[right]))
                return node
        leaves += 1
        return -leaves

    root = split(np.arange(len(sample)))
    return Tree(
        np.array(directions).reshape(-1, sample.shape[1]), np.array(offsets), np.array(children).reshape(-1, 2), root, leaves
    )


def route(tree: Tree, x: np.ndarray) -> np.ndarray:
    """The leaf of every row of x."""
    node = np.full(len(x), tree.root)
    inner = np.flatnonzero(node >= 0)
    while len(inner):
        at = node[inner]
        right = np.einsum("ij,ij->i", x[inner], tree.directions[at]) > tree.offsets[at]
        node[inner] = tree.children[at, right.astype(int)]
        inner = inner[node[inner] >= 0]
    return -node - 1


def leaves_in_order(trees: list[Tree], sizes: list[np.ndarray], x: np.ndarray):
    """(tree, leaf, rows of the leaves before) in the order of the shared queue.

    A node's price is the sum of the squared distances to the splits on whose other side it lies.
    """
    margins = [t.directions @ x - t.offsets for t in trees]
    queue = [(0.0, k, t.root) for k, t in enumerate(trees)]
    rows = 0
    while queue:
        cost, k, node = heapq.heappop(queue)
        while node >= 0:  # into the nearer child; the other one waits at the price of the split
            margin = margins[k][node]
            near = int(margin > 0)
            heapq.heappush(queue, (cost + margin * margin, k, int(trees[k].children[node, 1 - near])))
            node = int(trees[k].children[node, near])
        leaf = -node - 1
        if sizes[k][leaf]:
            yield k, leaf, rows
            rows += int(sizes[k][leaf])


def walk(trees: list[Tree], sizes: list[np.ndarray], x: np.ndarray, wanted: int) -> list[tuple[int, int]]:
    """(tree, leaf) in the order of the shared queue until the leaves hold `wanted` rows."""
    return [(k, leaf) for k, leaf, _ in takewhile(lambda at: at[2] < wanted, leaves_in_order(trees, sizes, x))]


def lift(x: np.ndarray, greatest: float) -> np.ndarray:
    """One more component, so that all vectors have the norm `greatest`."""
    rest = np.sqrt(np.maximum(greatest**2 - np.einsum("ij,ij->i", x, x), 0))
    return np.concatenate([x, rest[:, None]], axis=1)


def lift_queries(x: np.ndarray, greatest: float) -> np.ndarray:
    """Queries among lifted vectors: only their direction counts, and the new component is zero."""
    norms = np.linalg.norm(x, axis=1, keepdims=True)
    return np.pad(x / np.where(norms > 0, norms, 1) * greatest, ((0, 0), (0, 1)))


def _index(classes: DataFrame, trees: list[Tree], greatest: float) -> DataFrame:
    """(tree, leaf, rep, v): every vector in one leaf of each tree."""

    def compute(batches):
        for batch in batches:
            x = lift(matrix(batch.column(1)), greatest)
            for k, tree in enumerate(trees):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(x), k, np.int32)), pa.array(route(tree, x).astype(np.int32)), batch.column(0), batch.column(1)],
                    ["tree", "leaf", "rep", "v"],
                )

    kind = classes.schema["v"].dataType.simpleString()
    return classes.select("rep", "v").mapInArrow(compute, f"tree int, leaf int, rep long, v {kind}")


def _visits(queries: DataFrame, trees: list[Tree], sizes: list[np.ndarray], shard_of: list[np.ndarray], wanted: int, greatest: float) -> DataFrame:
    """(rep, v, shards, leaves): per query the shards it visits and its leaves in each of them."""

    def compute(batches):
        for batch in batches:
            shards, leaves = [], []
            for row in lift_queries(matrix(batch.column(1)), greatest):
                held: dict[int, list[int]] = {}
                for k, leaf in walk(trees, sizes, row, wanted):
                    held.setdefault(int(shard_of[k][leaf]), []).append((k << 24) | leaf)
                shards.append(list(held))
                leaves.append(list(held.values()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(shards, pa.list_(pa.int32())), pa.array(leaves, pa.list_(pa.list_(pa.int32())))],
                ["rep", "v", "shards", "leaves"],
            )

    kind = queries.schema["v"].dataType.simpleString()
    return queries.mapInArrow(compute, f"rep long, v {kind}, shards array<int>, leaves array<array<int>>")


def _nearest_of_few(classes: DataFrame, own: np.ndarray, x: np.ndarray, most: int) -> DataFrame:
    """(query, rep): the exact nearest of a few queries (numbered) but themselves, by one pass over all vectors."""

    def compute(batches):
        top = np.full((len(x), most), -np.inf)
        ids = np.full((len(x), most), np.iinfo(np.int64).max)
        for batch in batches:
            reps = batch.column(0).to_numpy()
            scores = x @ matrix(batch.column(1)).T
            scores[own[:, None] == reps] = -np.inf
            names = np.broadcast_to(reps, scores.shape)
            top, ids = _best(np.concatenate([top, scores], axis=1), np.concatenate([ids, names], axis=1), most)
        found = np.isfinite(top)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.nonzero(found)[0].astype(np.int32)), pa.array(ids[found]), pa.array(top[found])], ["query", "rep", "score"],
        )

    found = classes.select("rep", "v").mapInArrow(compute, "query int, rep long, score double")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "rep")
    return found.withColumn("at", F.row_number().over(order)).where(F.col("at") <= most).select("query", "rep")


def enough_rows(
    classes: DataFrame, index: DataFrame, asking: DataFrame, trees: list[Tree], sizes: list[np.ndarray], greatest: float,
    k: int, recall: float, tried: int,
) -> int:
    """The rows whose leaves a walk must hold so that `tried` queries find the share `recall` of their k nearest.

    `asking` has (vec_id, rep) for every query; equal vectors are tried once and count as often as they are drawn.
    The driver sees those queries, their neighbours' leaves (k for each tree and query) and the forest.
    """
    drawn = asking.orderBy(F.xxhash64("vec_id", F.lit(3)), "rep").limit(tried).groupBy("rep").agg(F.count("*").alias("asks"))
    some = classes.join(F.broadcast(drawn), "rep").select("rep", "v", "asks").toArrow().combine_chunks()
    if not some.num_rows:
        return 0
    own, x, asks = some.column("rep").to_numpy(), matrix(some.column("v").combine_chunks()), some.column("asks").to_numpy()
    nearest_ones = _nearest_of_few(classes, own, x, k)
    places = index.select("rep", "tree", "leaf").join(F.broadcast(nearest_ones), "rep").collect()
    held: dict[int, dict[tuple[int, int], list[int]]] = {}
    for r in places:
        held.setdefault(r["query"], {}).setdefault((r.tree, r.leaf), []).append(r.rep)
    needed = []
    for query, leaves in held.items():
        left = {rep for reps in leaves.values() for rep in reps}
        for tree, leaf, before in leaves_in_order(trees, sizes, lift_queries(x[query:query + 1], greatest)[0]):
            for rep in leaves.get((tree, leaf), ()):
                if rep in left:
                    left.remove(rep)
                    needed += [before + 1] * int(asks[query])
            if not left:
                break
    needed.sort()
    return needed[max(0, int(np.ceil(recall * len(needed))) - 1)] if needed else 0


def _best(scores: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row the `most` highest scores in any order, ties to the smaller id."""
    if scores.shape[1] <= most:
        return scores, ids
    least = -np.partition(-scores, most - 1, axis=1)[:, most - 1]
    kept = scores >= least[:, None]
    for i in np.flatnonzero(kept.sum(axis=1) > most):  # a tie at the last place
        kept[i] = False
        kept[i, np.lexsort((ids[i], -scores[i]))[:most]] = True
    columns = np.nonzero(kept)[1].reshape(len(scores), most)
    return np.take_along_axis(scores, columns, 1), np.take_along_axis(ids, columns, 1)


def _cell(most: int):
    """Scores the queries of a cell against the rows of the leaves they visit there."""

    def compute(key: tuple, rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or queries.empty:
            return pd.DataFrame({"query": [], "rep": [], "score": []})
        rows = rows.sort_values(["code", "rep"])
        x = np.array(rows.v.tolist(), dtype=np.float64)
        q = np.array(queries.v.tolist(), dtype=np.float64)
        codes, starts = np.unique(rows.code.to_numpy(), return_index=True)
        ends = [*starts[1:], len(rows)]
        reps = rows.rep.to_numpy()
        own = np.repeat(np.arange(len(q)), queries.leaves.map(len).to_numpy())
        visited = np.concatenate(queries.leaves.tolist()) if len(own) else np.empty(0, int)
        order = np.argsort(visited, kind="stable")
        own, visited = own[order], visited[order]
        top = np.full((len(q), most), -np.inf)
        ids = np.full((len(q), most), np.iinfo(np.int64).max)
        for code, start, end in zip(codes, starts, ends):
            who = own[np.searchsorted(visited, code, "left"):np.searchsorted(visited, code, "right")]
            for a in range(start, end, 4096):
                part = slice(a, min(end, a + 4096))
                for b in range(0, len(who), 512):
                    w = who[b:b + 512]
                    scores = np.concatenate([top[w], q[w] @ x[part].T], axis=1)
                    names = np.concatenate([ids[w], np.broadcast_to(reps[part], (len(w), part.stop - part.start))], axis=1)
                    top[w], ids[w] = _best(scores, names, most)
        found = np.isfinite(top)
        return pd.DataFrame({
            "query": np.repeat(queries.rep.to_numpy(), found.sum(axis=1)), "rep": ids[found], "score": top[found],
        })

    return compute


def nearest(
    embeddings: DataFrame, is_query: str, k: int = 20, trees: int = TREES, sample_rows: int = SAMPLE_ROWS,
    leaf_sample: int = LEAF_SAMPLE, recall: float = TARGET_RECALL, tried: int = TRIED_QUERIES, seed: int = 7,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every vector whose id satisfies `is_query`.

    Every vector is a candidate but the query's own id. Vectors that are null, empty, zero or hold
    null or non-finite components take no part, nor do rows without an id or of another than the
    most frequent length. Equal vectors are searched once and share their score; ties go to the
    smaller id. A row repeated with its id counts once; an id with two vectors stands for both.
    The search is as wide as `tried` of the queries need to find the share `recall` of their nearest.
    """
    classes, members = fold(vector_rows(embeddings))
    sample = classes.orderBy(F.xxhash64("rep")).limit(sample_rows).select("v").toArrow()  # the bounded sample
    spark = embeddings.sparkSession
    if not sample.num_rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    greatest = float(classes.agg(F.max(F.sqrt(square))).first()[0])
    x = lift(matrix(sample.column("v").combine_chunks()), greatest)
    draw = np.random.default_rng(seed)
    forest = [grow_tree(x, leaf_sample, draw) for _ in range(trees)]

    index = staged(_index(classes, forest, greatest), "forest_leaves")
    sizes = [np.zeros(t.leaves, dtype=np.int64) for t in forest]
    for r in index.groupBy("tree", "leaf").count().collect():  # one row per leaf of the fitted forest
        sizes[r.tree][r.leaf] = r["count"]
    wide = members.where(is_query)
    asked = staged(wide.select("rep").distinct().join(classes, "rep").select("rep", "v"), "forest_queries")
    wanted = enough_rows(classes, index, wide, forest, sizes, greatest, k, recall, tried)
    # Neighbouring leaves of a tree share a shard; a shard's rows are split into cells of bounded size.
    cell_rows = max(1024, CELL_BYTES // (8 * x.shape[1]))
    shard_of, shard_rows = [], []
    for counts in sizes:
        own = np.zeros(len(counts), dtype=np.int32)
        for leaf, n in enumerate(counts.tolist()):
            if leaf == 0 or shard_rows[-1] and shard_rows[-1] + n > cell_rows:
                shard_rows.append(0)
            own[leaf] = len(shard_rows) - 1
            shard_rows[-1] += n
        shard_of.append(own)
    visits = staged(_visits(asked, forest, sizes, shard_of, wanted, greatest), "forest_visits")
    # A shard's rows are copied for every block of the queries that visit it, not of all queries.
    shards = visits.select(F.explode("shards").alias("shard")).groupBy("shard").count().collect()  # no more than leaves
    cells = spark.createDataFrame(
        [(r.shard, -(-shard_rows[r.shard] // cell_rows), -(-r["count"] // CELL_QUERIES)) for r in shards],
        "shard int, parts int, blocks int",
    )
    flat = spark.createDataFrame(
        [(k, leaf, int(s)) for k, own in enumerate(shard_of) for leaf, s in enumerate(own)], "tree int, leaf int, shard int",
    )
    # Both tables are as bounded as the forest.
    rows = index.join(F.broadcast(flat.join(F.broadcast(cells), "shard")), ["tree", "leaf"]).select(
        "shard", F.pmod(F.xxhash64("rep"), F.col("parts")).alias("part"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
        (F.shiftleft("tree", 24) + F.col("leaf")).alias("code"), "rep", "v",
    )
    visited = visits.select("rep", "v", F.explode(F.arrays_zip("shards", "leaves")).alias("at")).select(
        "rep", "v", F.col("at.shards").alias("shard"), F.col("at.leaves").alias("leaves"),
    )
    visits = visited.join(F.broadcast(cells), "shard").select(
        "shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1).cast("array<bigint>")).alias("part"),
        F.pmod(F.xxhash64("rep", F.lit(1)), F.col("blocks")).cast("int").alias("block"), "rep", "v", "leaves",
    )
    cell = ["shard", "part", "block"]
    found = rows.groupBy(*cell).cogroup(visits.groupBy(*cell)).applyInPandas(_cell(k + 1), "query long, rep long, score double")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "rep")
    best = found.groupBy("query", "rep").agg(F.max("score").alias("score")).withColumn("at", F.row_number().over(order)).where(F.col("at") <= k + 1)
    best = staged(best.select("query", "rep", "score"), "forest_found")

    names = smallest_members(members, k + 1).withColumnRenamed("rep", "held")
    answers = best.join(names, F.col("rep") == F.col("held")).select("query", "vec_id", "score")
    # The best of a class of equal queries, then of each query without itself.
    closest = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    answers = answers.withColumn("at", F.row_number().over(closest)).where(F.col("at") <= k + 1).drop("at")
    wide = wide.select(F.col("vec_id").alias("query_id"), F.col("rep").alias("query"))
    each = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    pairs = wide.join(answers, "query").where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return pairs.withColumn("rank", F.row_number().over(each)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

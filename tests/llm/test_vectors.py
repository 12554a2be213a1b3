import numpy as np
import pytest

from recordwarden.llm import near_vectors, neighbours, queries

from .helpers import TABLES, Groups, embeddings, read, unit

NAN, INF = float("nan"), float("inf")


def odd_embeddings(spark):
    base = [1.0, 0.0, 0.0, 0.0]
    near = [1.0, 0.1, 0.0, 0.0]
    rows = [
        (0, base), (20, base), (5, near), (5, near), (7, [0.0, 0.0, 2.0, 0.0]), (8, [0.0, 0.0, 1.0, 0.0]), (9, None), (10, []),
        (11, [0.0] * 4), (12, [1.0, NAN, 0.0, 0.0]), (13, [INF, 0.0, 0.0, 0.0]), (14, [1.0, None, 0.0, 0.0]), (15, [1.0, 0.0]),
        (None, base), (40, [0.0, 1.0, 0.0, 0.0]), (41, [0.0, -1.0, 0.0, 0.0]),
    ]
    return embeddings(spark, [(i, v, 0, "x", 1) for i, v in rows]).repartition(3)


def exact(ids, x, query, k):
    scores = x @ x[ids.index(query)]
    order = sorted((-s, i) for s, i in zip(scores, ids) if i != query)[:k]
    return [(i, -s) for s, i in order]


def recall(found, ids, x, k):
    got = {}
    for r in found:
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = {q: {i for i, _ in exact(ids, x, q, k)} for q in got}
    return np.mean([len(got[q] & want[q]) / len(want[q]) for q in got])


def test_neighbour_query(spark):
    table = read("embeddings")
    ids, x = table.vec_id.tolist(), np.stack(table.embedding).astype(float)
    found = queries.op2_projection_forest(spark, TABLES).collect()
    assert {r.query_id for r in found} == {i for i in ids if i % 20 == 0}
    assert recall(found, ids, x, 20) >= 0.99
    for q in {r.query_id for r in found}:
        rows = sorted((r for r in found if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, 21))
        assert [(-r.score, r.vec_id) for r in rows] == sorted((-r.score, r.vec_id) for r in rows)
        assert all(abs(r.score - x[ids.index(q)] @ x[ids.index(r.vec_id)]) < 1e-12 for r in rows)


def test_neighbours_of_other_norms_and_a_large_group(spark):
    draw = np.random.default_rng(2)
    x = draw.normal(size=(6000, 24)) * draw.lognormal(0, 0.4, (6000, 1))
    x[1000:3000] = x[1000]  # a third of all rows are copies
    x = x.astype(np.float32)
    source = embeddings(spark, [(i, v.tolist(), 0, "", 0) for i, v in enumerate(x)])
    found = neighbours.nearest(source, "vec_id % 50 = 0", k=5, sample_rows=2000).collect()
    ids = list(range(len(x)))
    assert len(found) == 120 * 5
    assert recall(found, ids, x.astype(float), 5) >= 0.9
    copies = [r.vec_id for r in sorted((r for r in found if r.query_id == 2000), key=lambda r: r["rank"])]
    assert copies == [i for i, _ in exact(ids, x.astype(float), 2000, 5)]


def test_odd_neighbours(spark):
    found = neighbours.nearest(odd_embeddings(spark), "vec_id % 20 = 0", k=3).collect()
    got = {}
    for r in sorted(found, key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {0: [5, 20, 7], 20: [0, 5, 7], 40: [5, 0, 7]}
    assert neighbours.nearest(odd_embeddings(spark).limit(0), "true").collect() == []


def test_best_breaks_ties_by_id():
    scores, ids = neighbours._best(np.array([[1.0, 3.0, 3.0, 3.0, 0.0]]), np.array([[9, 8, 7, 6, 5]]), 2)
    assert sorted(ids[0]) == [6, 7]


def test_tree_routes_every_row_to_one_leaf():
    x = unit(np.random.default_rng(0), 500, 8)
    tree = neighbours.grow_tree(x, 20, np.random.default_rng(1))
    assert np.bincount(neighbours.route(tree, x), minlength=tree.leaves).max() <= 20
    same = neighbours.grow_tree(np.ones((50, 8)), 20, np.random.default_rng(1))
    assert same.leaves == 1


# --- near-duplicates -----------------------------------------------------------

def plain_groups(ids, x, cosine):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= cosine
    np.fill_diagonal(linked, False)
    groups = Groups()
    for i, j in zip(*np.nonzero(linked)):
        groups.link(ids[i], ids[j])
    return {i: (int(n), groups.find(i)) for i, n in zip(ids, linked.sum(axis=1))}


@pytest.mark.parametrize("blocks", [1024, 8])
def test_groups_equal_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(near_vectors, "BLOCK_ROWS", blocks)
    draw = np.random.default_rng(3)
    seeds = unit(draw, 40, 16)
    x = np.concatenate([unit(draw, 300, 16)] + [s + 0.03 * draw.normal(size=(k, 16)) for k, s in enumerate(seeds)] + [np.repeat(seeds[:1], 30, 0)])
    x = (x * draw.uniform(0.5, 3, (len(x), 1))).astype(np.float32)
    ids = draw.permutation(len(x)).tolist()
    source = embeddings(spark, [(i, v.tolist(), 0, "", 0) for i, v in zip(ids, x)])
    found = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors.vector_groups(source, 0.9, recall=0.999).collect()}
    assert found == plain_groups(ids, x.astype(float), 0.9)


def test_group_query(spark):
    table = read("embeddings")
    found = queries.op4_stable_hash_groups(spark, TABLES).collect()
    want = plain_groups(table.vec_id.tolist(), np.stack(table.embedding).astype(float), 0.9)
    assert {r.vec_id: (r.n_links, r.component_id) for r in found} == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in found)


def test_odd_groups(spark):
    found = near_vectors.vector_groups(odd_embeddings(spark)).collect()
    assert len(found) == 16
    by_id = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in found}
    assert by_id[0] == (2, 0, True) and by_id[20] == (2, 0, False) and by_id[5] == (2, 0, False)
    assert by_id[7] == (1, 7, True) and by_id[8] == (1, 7, False)
    for i in (9, 10, 11, 12, 13, 14, 15, 40, 41):
        assert by_id[i] == (0, i, True)
    assert by_id[None] == (None, None, False)
    assert near_vectors.vector_groups(odd_embeddings(spark).limit(0)).collect() == []


def test_recall_rule():
    assert near_vectors.collision(0.0, 2.0) == 1.0
    tables = near_vectors.make_tables(10**6, 8, 0.9, 0.95)
    hit = near_vectors.collision(np.sqrt(0.2), 2.0) ** tables.concatenated
    assert 1 - (1 - hit) ** tables.count >= 0.95


# --- the width of the search ---------------------------------------------------

def plain_needs(trees, x, query, most):
    """Rows that the walk of one query has to hold before it reaches each of its nearest."""
    sizes = [np.bincount(neighbours.route(t, x), minlength=t.leaves) for t in trees]
    first = {}
    for tree, leaf, before in neighbours.leaves_in_order(trees, sizes, x[query]):
        for i in np.flatnonzero(neighbours.route(trees[tree], x) == leaf):
            first.setdefault(int(i), before)
    near = sorted((i for i in range(len(x)) if i != query), key=lambda i: (-(x[i] @ x[query]), i))[:most]
    return [first[i] for i in near]


def test_walk_reaches_every_leaf_once_and_stops_when_it_holds_enough():
    x = unit(np.random.default_rng(5), 400, 8)
    draw = np.random.default_rng(6)
    trees = [neighbours.grow_tree(x, 16, draw) for _ in range(3)]
    sizes = [np.bincount(neighbours.route(t, x), minlength=t.leaves) for t in trees]
    order = list(neighbours.leaves_in_order(trees, sizes, x[0]))
    assert len({(k, leaf) for k, leaf, _ in order}) == len(order) == sum(t.leaves for t in trees)
    assert [before for *_, before in order] == np.cumsum([0, *[sizes[k][leaf] for k, leaf, _ in order]])[:-1].tolist()
    some = neighbours.walk(trees, sizes, x[0], 100)
    held = sum(sizes[k][leaf] for k, leaf in some)
    assert held >= 100 > held - sizes[some[-1][0]][some[-1][1]]
    assert neighbours.walk(trees, sizes, x[0], 0) == []


def clustered(draw, clusters, each, dim):
    centres = unit(draw, clusters, dim)
    x = np.repeat(centres, each, 0) + 0.05 * draw.normal(size=(clusters * each, dim))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


@pytest.mark.parametrize("rows", [600, 3000, 9000])
def test_vectors_with_structure_need_a_small_part_of_the_search(spark, monkeypatch, rows):
    x = clustered(np.random.default_rng(rows), rows // 30, 30, 32)
    source = embeddings(spark, [(i, v.tolist(), 0, "", 0) for i, v in enumerate(x)])
    widths = []
    measured = neighbours.enough_rows
    monkeypatch.setattr(neighbours, "enough_rows", lambda *a: widths.append(measured(*a)) or widths[-1])
    found = neighbours.nearest(source, "vec_id % 20 = 0", k=10, leaf_sample=24, tried=64).collect()
    assert recall(found, list(range(rows)), x.astype(float), 10) >= 0.95
    assert 0 < widths[0] < 0.5 * rows


def test_width_is_the_least_that_the_tried_queries_need(spark, monkeypatch):
    x = unit(np.random.default_rng(8), 500, 16)
    source = embeddings(spark, [(i, v.tolist(), 0, "", 0) for i, v in enumerate(x)])
    seen = {}
    measured = neighbours.enough_rows

    def watched(classes, index, asking, trees, sizes, greatest, *rest):
        seen.update(trees=trees, greatest=greatest, width=measured(classes, index, asking, trees, sizes, greatest, *rest))
        return seen["width"]

    monkeypatch.setattr(neighbours, "enough_rows", watched)
    monkeypatch.setattr(neighbours, "CELL_QUERIES", 3)  # several blocks of queries for a shard
    found = neighbours.nearest(source, "vec_id % 20 = 0", k=5, recall=0.9, leaf_sample=20).collect()
    exact_x = np.asarray(x, dtype=np.float32).astype(float)
    lifted = neighbours.lift(exact_x, seen["greatest"])
    needs = sorted(n for q in range(0, 500, 20) for n in plain_needs(seen["trees"], lifted, q, 5))
    assert abs(np.mean(np.array(needs) < seen["width"]) - 0.9) <= 0.02
    assert 0.88 <= recall(found, list(range(500)), exact_x, 5) < 1

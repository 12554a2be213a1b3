import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from recordwarden.llm import queries, simhash
from recordwarden.llm.common import connected_components

from .helpers import TABLES, Groups, empty_documents, odd_documents, read, rows_of


def plain_simhash(text, shingle=3):
    words = (text or "").encode().lower().split()
    runs = [b" ".join(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, prints, distance=2):
    groups, unsigned = Groups(), np.array(prints, dtype=np.uint64)
    for i, x in zip(ids, unsigned):
        for j in np.flatnonzero(np.bitwise_count(unsigned ^ x) <= distance):
            groups.link(i, ids[j])
    return [groups.find(i) for i in ids]


def test_query_equals_brute_force(spark):
    docs = read("documents").sort_values("doc_id")
    prints = [plain_simhash(t) for t in docs.text]
    roots = plain_components(docs.doc_id.tolist(), prints)
    want = sorted(zip(docs.doc_id.tolist(), (f"{p:016x}" for p in prints), roots))
    assert rows_of(queries.op1_simhash_groups(spark, TABLES), "doc_id", "fingerprint", "component_id") == want


def test_odd_rows(spark):
    found = simhash.simhash_groups(odd_documents(spark))
    prints = {(r.doc_id, r.fp & (2**64 - 1)) for r in found.collect()}
    from .helpers import ODD_TEXTS
    assert prints == {(i, plain_simhash(t)) for i, t in ODD_TEXTS}
    roots = {(r.doc_id, r.component_id) for r in found.collect()}
    assert {(2, 2), (3, 2), (4, 2), (1, 1), (7, 1)} <= roots
    assert len({root for i, root in roots if i == 5}) == 1  # both texts of one id
    assert found.count() == len(ODD_TEXTS)


def test_empty_table(spark):
    assert simhash.simhash_groups(empty_documents(spark)).collect() == []


@pytest.mark.parametrize("max_parts", [1, 2, 3])
@pytest.mark.parametrize("crowd", [0, 64])
def test_every_layout_finds_all_links(spark, max_parts, crowd):
    rng = np.random.default_rng(max_parts)
    base = rng.integers(0, 2**63, 12, dtype=np.uint64)
    prints = [int(b) for b in base] + [0]
    for b in base:  # chains of single and double flips
        x = int(b)
        for _ in range(12):
            for bit in rng.choice(64, rng.integers(1, 4), replace=False):
                x ^= 1 << int(bit)
            prints.append(x)
    prints = sorted(set(prints))
    ids = list(range(len(prints)))
    rows = spark.createDataFrame([(i, simhash._signed(p)) for i, p in zip(ids, prints)], "id long, fp long")
    parts = simhash.plan_partitions(rows, 2, max_parts)
    edges = simhash.linked_fingerprints(rows, parts, 2, crowd)
    for r in edges.collect():
        assert bin(prints[r.a] ^ prints[r.b]).count("1") <= 2
    root = {r.node: r.root for r in connected_components(edges).collect()}
    assert [root.get(i, i) for i in ids] == plain_components(ids, prints)


def test_forced_thresholds_and_odd_distances(spark):
    prints = sorted({0, 1, 3, 7, 0xFF, 0xFFFF << 40, 1 << 63, (1 << 63) | 1, (1 << 62) | 5})
    ids = list(range(len(prints)))
    rows = spark.createDataFrame([(i, simhash._signed(p)) for i, p in zip(ids, prints)], "id long, fp long")
    half = tuple(range(32)), tuple(range(32, 64))
    for distance, thresholds in ((2, (1, 0)), (2, (2, -1)), (1, (0, 0)), (3, (1, 1))):
        parts = [simhash.Partition(b, t) for b, t in zip(half, thresholds) if t >= 0]
        for crowd in (0, 64):
            edges = simhash.linked_fingerprints(rows, parts, distance, crowd)
            root = {r.node: r.root for r in connected_components(edges).collect()}
            assert [root.get(i, i) for i in ids] == plain_components(ids, prints, distance)


def test_allocation_spends_the_whole_threshold():
    cost, thresholds = simhash.allocate([[5, 50, 500], [1, 2, 300], [900, 901, 902]], 0)
    assert (cost, thresholds) == (7, [0, 1, -1])


def test_correlated_bits_share_a_partition():
    rng = np.random.default_rng(0)
    bits = rng.integers(0, 2, (4000, 64)).astype(float)
    bits[:, 40] = bits[:, 3]
    groups = simhash.group_bits(4000, bits.T @ bits, 3)
    assert sorted(b for g in groups for b in g) == list(range(64))
    assert any({3, 40} <= set(g) for g in groups)


def test_components_of_a_long_path(spark):
    n = 300
    order = np.random.default_rng(1).permutation(n)
    edges = spark.createDataFrame([(int(order[i]), int(order[i + 1])) for i in range(n - 1)], "a long, b long")
    assert connected_components(edges).agg(F.count("*"), F.max("root")).first()[:] == (n, 0)

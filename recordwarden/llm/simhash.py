"""SimHash near-duplicates by the generalised pigeonhole principle.

The bits of a fingerprint are dealt into partitions, correlated bits together. Each partition gets
its own threshold; the thresholds are chosen by dynamic programming on estimated candidate counts
so that they add up to `max_distance - partitions + 1`, which guarantees that two fingerprints
within `max_distance` agree within the threshold in at least one partition. Probing that partition
finds the candidates, and the full distance verifies them.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, stage, staged, text_bytes

BITS = 64


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of `shingle` words of a lower-cased text, repeats included."""
    words = text.lower().split()  # bytes: only A-Z changes, and only ASCII white space separates
    if not words:
        return np.empty(0, dtype=np.uint64)
    line = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(line, 42)], dtype=np.uint64)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter(
        (digest(line[s:e], 42) for s, e in zip(starts, ends[shingle - 1:].tolist())),
        dtype=np.uint64, count=len(starts),
    )


def simhash(text: bytes, shingle: int = 3) -> int:
    """The fingerprint as a signed 64-bit number; 0 for a text without words."""
    hashes = shingle_hashes(text, shingle)
    counts = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 15):
        octets = hashes[i:i + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp) of every row of `docs`; other columns are not read."""

    def compute(batches):
        for batch in batches:
            values = [simhash(t, shingle) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.int64())], ["doc_id", "fp"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    return source.mapInArrow(compute, "doc_id long, fp long")


@dataclass(frozen=True)
class Partition:
    """Bits that are probed together, and the distance up to which they are probed."""

    bits: tuple[int, ...]
    threshold: int = 0


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _longs(values: list[int]) -> Column:
    return F.lit(values).cast("array<bigint>")


def _mask(bits) -> int:
    return sum(1 << b for b in bits)


def joint_bit_counts(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """Rows, and for every two bits the rows in which both are set: 64 x 64 sums over all rows."""

    def count(batches):
        total = np.zeros((BITS, BITS))
        for batch in batches:
            octets = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8").view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(octets, axis=1, bitorder="little").astype(np.float32)
            for i in range(0, len(bits), 1 << 16):  # float32 counts up to 2^24 exactly
                part = bits[i:i + (1 << 16)]
                total += part.T @ part
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays(
            [pa.array(x.ravel()) for x in (i.astype(np.int32), j.astype(np.int32), total.astype(np.int64))],
            ["i", "j", "both"],
        )

    sums = distinct.select("fp").mapInArrow(count, "i int, j int, both long").groupBy("i", "j").agg(F.sum("both").alias("both"))
    joint = np.zeros((BITS, BITS))
    for row in sums.collect():  # 4096 sums whatever the input
        joint[row.i, row.j] = row.both
    return distinct.count(), joint


def group_bits(rows: int, joint: np.ndarray, parts: int) -> list[tuple[int, ...]]:
    """`parts` groups of nearly equal size that keep correlated bits together."""
    share = np.diag(joint) / max(rows, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-9))
    related = np.abs(joint / max(rows, 1) - np.outer(share, share)) / np.outer(spread, spread)
    np.fill_diagonal(related, 0)
    free, groups = set(range(BITS)), []
    for left in range(parts, 0, -1):
        size = len(free) // left + (len(free) % left > 0)
        group = [max(sorted(free), key=lambda b: related[b, sorted(free)].sum())]
        free -= set(group)
        while len(group) < size:
            following = max(sorted(free), key=lambda b: related[b, group].sum())
            group.append(following)
            free.discard(following)
        groups.append(tuple(sorted(group)))
    return groups


def candidate_counts(rows: int, joint: np.ndarray, bits: tuple[int, ...], equal_pairs: float, most: int) -> list[float]:
    """Estimated pairs within 0..most bits in one partition.

    Pairs that agree are counted; how many more differ in one or two bits follows from the share of
    set bits, taking the bits as independent.
    """
    share = np.diag(joint)[list(bits)] / max(rows, 1)
    agree = np.maximum(share**2 + (1 - share) ** 2, 1e-9)
    odds = (1 - agree) / agree
    base = max(equal_pairs, rows * rows / 2 * float(np.prod(agree)))
    symmetric = [1.0] + [0.0] * most  # elementary symmetric polynomials of the odds
    for x in odds:
        for k in range(most, 0, -1):
            symmetric[k] += symmetric[k - 1] * x
    return [base * sum(symmetric[: k + 1]) for k in range(most + 1)]


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds (from -1, meaning not probed) that add up to `total` at the least cost.

    costs[p][t] is the cost of probing partition p up to distance t.
    """
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        following: dict[int, tuple[float, list[int]]] = {}
        for spent, (cost, chosen) in best.items():
            for t in range(-1, len(row)):
                entry = (cost + (row[t] if t >= 0 else 0.0), [*chosen, t])
                if spent + t not in following or entry < following[spent + t]:
                    following[spent + t] = entry
        best = following
    return best[total]


def plan_partitions(distinct: DataFrame, max_distance: int, max_parts: int) -> list[Partition]:
    """The cheapest partitions and thresholds, from counts over all fingerprints."""
    rows, joint = joint_bit_counts(distinct)
    layouts = {m: group_bits(rows, joint, m) for m in range(1, max_parts + 1)}
    flat = [(m, p, bits) for m, groups in layouts.items() for p, bits in enumerate(groups)]
    masks = _longs([_signed(_mask(bits)) for _, _, bits in flat])
    values = distinct.select(F.posexplode(masks).alias("part", "mask"), "fp").select(
        "part", F.col("fp").bitwiseAND(F.col("mask")).alias("value")
    )
    same = values.groupBy("part", "value").count().groupBy("part").agg(
        F.sum(F.col("count").cast("double") * (F.col("count") - 1) / 2).alias("pairs")
    )
    pairs = {row.part: row.pairs for row in same.collect()}  # one row per partition tried
    options = []
    for m, groups in layouts.items():
        costs = []
        for bits in groups:
            equal = pairs.get(flat.index((m, len(costs), bits)), 0.0)
            found = candidate_counts(rows, joint, bits, equal, max_distance)
            keys = [sum(comb(len(bits), k) for k in range(t + 1)) for t in range(max_distance + 1)]
            costs.append([rows * keys[t] + found[t] for t in range(max_distance + 1)])
        cost, thresholds = allocate(costs, max_distance - m + 1)
        options.append((cost, [Partition(b, t) for b, t in zip(groups, thresholds) if t >= 0]))
    return min(options, key=lambda o: o[0])[1]


def probe_masks(partitions: list[Partition]) -> list[int]:
    """For every probe the bits to compare: a partition without up to `threshold` of its bits."""
    masks = []
    for part in partitions:
        whole = _mask(part.bits)
        for k in range(part.threshold + 1):
            masks += [whole & ~_mask(left_out) for left_out in combinations(part.bits, k)]
    return masks


def linked_fingerprints(
    distinct: DataFrame, partitions: list[Partition], max_distance: int, crowd: int = BITS
) -> DataFrame:
    """Edges (a, b) between ids of fingerprints; their components are those of all links.

    `distinct` has fp (unique) and id. Buckets of up to `crowd` fingerprints are compared pair by
    pair. Fingerprints of larger buckets are instead joined through centres: for any two linked ones
    there is a string that differs from one in half the distance (rounded down) or less and from the
    other in the rest, and whatever lies that near to it is linked to each of the nearer ones. For
    two bits that is 65 rows per fingerprint however full its bucket is.
    """
    probes = distinct.select(F.posexplode(_longs([_signed(m) for m in probe_masks(partitions)])).alias("probe", "mask"), "fp", "id")
    probes = probes.select("probe", F.col("fp").bitwiseAND(F.col("mask")).alias("value"), "fp", "id")
    shared = probes.groupBy("probe", "value").agg(F.count("*").alias("n")).where("n > 1")
    members = staged(probes.join(shared, ["probe", "value"]), "simhash_members")
    near = lambda x, y: F.bit_count(F.col(x).bitwiseXOR(F.col(y))) <= max_distance
    small = members.where(F.col("n") <= crowd)
    other = small.select("probe", "value", F.col("fp").alias("fp2"), F.col("id").alias("id2"))
    pairs = (
        small.join(other, ["probe", "value"]).where((F.col("fp") < F.col("fp2")) & near("fp", "fp2"))
        .select(F.col("id").alias("a"), F.col("id2").alias("b"))
    )
    big = members.where(F.col("n") > crowd)
    inner = max_distance // 2
    flips = [_mask(c) for k in range(max_distance - inner + 1) for c in combinations(range(BITS), k)]
    centres = big.select("fp", "id").distinct().select(F.explode(_longs([_signed(f) for f in flips])).alias("flip"), "fp", "id").select(
        F.col("fp").bitwiseXOR(F.col("flip")).alias("centre"), "id", (F.bit_count("flip") <= inner).alias("inner")
    )
    hubs = centres.groupBy("centre").agg(F.min(F.when(F.col("inner"), F.col("id"))).alias("b"), F.count("*").alias("n"))
    hubs = hubs.where("n > 1 AND b IS NOT NULL").select("centre", "b")
    return pairs.union(centres.join(hubs, "centre").where("id <> b").select(F.col("id").alias("a"), "b"))


def simhash_groups(
    docs: DataFrame, shingle: int = 3, max_distance: int = 2, max_parts: int = 3, crowd: int = BITS
) -> DataFrame:
    """(doc_id, fp, component_id) for every row of `docs` (columns doc_id and text are used).

    Null and empty texts have fingerprint 0 and link like any other. Rows that share a doc_id count
    as one document. Rows without a doc_id never give a component its name; a component of such rows
    alone has a null component_id. An empty table gives an empty result.
    """
    prints, _ = stage(fingerprints(docs, shingle), "simhash")
    distinct = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("id")), "simhash_distinct")
    named = distinct.where("id IS NOT NULL")
    edges = linked_fingerprints(named, plan_partitions(named, max_distance, max_parts), max_distance, crowd)
    # A doc_id with several texts joins their fingerprints.
    repeated = prints.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("fp").alias("x"), F.max("fp").alias("y"))
    several = prints.join(repeated.where("x <> y").select("doc_id"), "doc_id", "left_semi")
    edges = edges.union(several.join(named, "fp").select(F.col("doc_id").alias("a"), F.col("id").alias("b")))
    roots = connected_components(edges)
    labels = distinct.join(roots, F.col("id") == F.col("node"), "left").select(
        F.col("fp").alias("f"), F.coalesce("root", "id").alias("component_id")
    )
    return prints.join(labels, F.col("fp") == F.col("f")).select("doc_id", "fp", "component_id")

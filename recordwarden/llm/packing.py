"""Best-fit packing of documents into fixed-length sequences by minimum bin slack.

Only the number of pieces of each length matters for packing, and there are at most `capacity`
lengths. Minimum bin slack therefore runs on that histogram: bitset subset sums over the available
lengths find the fullest feasible combination, which is used as often as the counts allow and then
removed. The result is a short list of patterns; Spark ranks the pieces of each length and reads
their sequence and offset from it.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import order_bucket, section_bits, staged, with_running_total
from .tokens import END_ID, worker_encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n_ids: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; only the first may be shorter than the capacity."""
    first = n_ids % capacity or min(n_ids, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n_ids, capacity)]


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int) -> DataFrame:
    """The pieces of every row of `docs` with the checksum of their ids, the end id included."""
    end = END_ID.to_bytes(4, "little")

    def compute(batches):
        encoder = worker_encoder(vocabulary)
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode_all(batch.column(1).to_pylist())):
                ids += end
                for i, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    rows.append((doc_id, i, start, length, zlib.crc32(ids[4 * start:4 * (start + length)])))
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"]
                )

    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    ).mapInArrow(compute, PIECES)


#: Slacks to accept at once; the packing with the fewest sequences is kept.
ACCEPTED_SLACKS = (0, 1, 2, 4, 8, 16, 32)


def fullest(counts: dict[int, int], capacity: int, slack: int = 0) -> dict[int, int]:
    """The combination that holds one piece of the greatest length and leaves the least slack.

    Bit s of a set says that some choice of lengths adds up to s. Lengths are added from the longest
    down, in powers of two of their count, until a sum within `slack` of the capacity is reached:
    accepting a little slack early saves the short pieces for later bins.
    """
    lengths = sorted(counts, reverse=True)
    everything = (1 << (capacity + 1)) - 1
    reach = 1 << lengths[0]
    steps = []
    for i, length in enumerate(lengths):
        left = min(counts[length] - (i == 0), (capacity - lengths[0]) // length)
        times = 1
        while left > 0:
            take = min(times, left)
            grown = reach | (reach << (take * length)) & everything
            if grown != reach:
                steps.append((reach, length, take))
                reach = grown
            left -= take
            times *= 2
        if reach >> (capacity - slack):
            break
    total = reach.bit_length() - 1
    used = {lengths[0]: 1}
    for before, length, take in reversed(steps):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + take
            total -= take * length
    return used


@dataclass(frozen=True)
class Slots:
    """Pieces `first` and following of one length: `each` to a sequence, from `sequence` on, at `offset`."""

    first: int
    each: int
    sequence: int
    offset: int


def pack_lengths(counts: dict[int, int], capacity: int) -> tuple[dict[int, list[Slots]], int]:
    """Where the pieces of each length go, in ascending order of `first`, and the number of sequences."""
    slacks = [s for s in ACCEPTED_SLACKS if s < capacity]
    return min((_pack(counts, capacity, s) for s in slacks), key=lambda packed: packed[1])


def _pack(counts: dict[int, int], capacity: int, slack: int) -> tuple[dict[int, list[Slots]], int]:
    left = {n: c for n, c in counts.items() if c > 0}
    taken = dict.fromkeys(left, 0)
    slots: dict[int, list[Slots]] = {n: [] for n in left}
    sequences = 0
    while left:
        pattern = fullest(left, capacity, slack)
        times = min(left[n] // k for n, k in pattern.items())
        offset = 0
        for n, k in sorted(pattern.items(), reverse=True):
            slots[n].append(Slots(taken[n], k, sequences, offset))
            offset += n * k
            taken[n] += k * times
            left[n] -= k * times
            if not left[n]:
                del left[n]
        sequences += times
    return slots, sequences


def place_pieces(ranked: DataFrame, slots: dict[int, list[Slots]]) -> DataFrame:
    """Adds sequence_id and offset to pieces that are ranked from 0 within their length."""
    tables = {n: np.array([(s.first, s.each, s.sequence, s.offset) for s in held], dtype=np.int64) for n, held in slots.items()}

    def compute(batches):
        for batch in batches:
            lengths = batch.column("length").to_numpy()
            ranks = batch.column("rank").to_numpy()
            sequence, offset = np.empty(len(ranks), dtype=np.int64), np.empty(len(ranks), dtype=np.int64)
            order = np.argsort(lengths, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1) if len(order) else []:
                length, rank = int(lengths[own[0]]), ranks[own]
                first, each, start, place = tables[length][np.searchsorted(tables[length][:, 0], rank, "right") - 1].T
                turn, within = np.divmod(rank - first, each)
                sequence[own], offset[own] = start + turn, place + within * length
            kept = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(sequence), pa.array(offset)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.mapInArrow(compute, PIECES + ", sequence_id long, offset long")


def pack(docs: DataFrame, vocabulary: str, capacity: int = 1024) -> DataFrame:
    """One row per piece of every row of `docs`, with its place in the packed sequences.

    Null and empty texts are the end id alone. Rows that share a doc_id, repeats included, are
    packed one by one. An empty table packs into nothing. Only doc_id and text are read.
    """
    pieces = staged(token_pieces(docs, vocabulary, capacity), "pieces")
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # <= capacity rows
    slots, _ = pack_lengths(counts, capacity)
    bits = section_bits(max(counts.values(), default=0))
    hashed = F.xxhash64("doc_id", "piece", "ids_crc32")
    ranked = with_running_total(
        pieces.withColumns({"section": order_bucket(hashed, bits), "place": hashed}),
        ["length"], "section", ["place", "doc_id", "piece", "ids_crc32", "start"], F.lit(1), "rank",
    )
    return place_pieces(ranked, slots)

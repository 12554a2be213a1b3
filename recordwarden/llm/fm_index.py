"""Benchmark decontamination with an FM-index per training shard.

The words of consecutive documents, one separator after each, are the text of a shard. Its suffixes
are sorted, and the words before them (the Burrows-Wheeler transform) are kept as a wavelet matrix,
whose ranks lead from the suffixes that start with a phrase to those that start with one more word in
front. All phrases are searched backwards at once; the places of what is found come from sampled
suffix positions. Shards are rows of a written table, so every block of phrases reads them as they
are, and no shard is larger than its limit or one document.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import union_all
from ..sources.staging import discard
from .common import stage, text_bytes
from .words import words_of

#: A shard ends with the document that brings it to so many words.
SHARD_WORDS = 1 << 20
#: Every so many words of a document, from its first, the place of the suffix is kept.
SAMPLE_RATE = 16
#: Items are searched in blocks of about so many words, which bounds what a task is sent.
BLOCK_WORDS = 1 << 19
#: Occurrences whose places are looked up together.
LOCATED = 1 << 20

SHARD = "doc_ids array<long>, n_words binary, words binary, counts binary, bits binary, marks binary, samples binary"
FOUND = "place int, doc_id long, n_words long, spans array<struct<first:int,stop:int>>, items array<string>"


def sort_suffixes(text: np.ndarray) -> np.ndarray:
    """The suffix array of `text`, in which 0 separates documents.

    Comparisons end at a separator, and of two separators the earlier is the smaller. Ranks by the
    first symbols are refined by doubling, and only suffixes that are still tied are sorted again.
    """
    n = len(text)
    ends = np.flatnonzero(text == 0)
    first = text.astype(np.int64) + len(ends) - 1
    first[ends] = np.arange(len(ends))
    base = int(first.max()) + 1
    depth = 3 if base < 1 << 20 else 2
    key = first.copy()
    for step in range(1, depth):
        key *= base
        key[:-step] += first[step:]
    order = np.argsort(key)
    rank = np.empty(n, dtype=np.int64)
    slots = np.arange(n)
    while len(slots):
        ordered = order[slots]
        sorted_key = key[ordered] if len(slots) == n else key
        opens = np.r_[True, sorted_key[1:] != sorted_key[:-1]]
        rank[ordered] = slots[np.maximum.accumulate(np.where(opens, np.arange(len(slots)), 0))]
        slots = slots[~(opens & np.r_[opens[1:], True])]
        tied = order[slots]
        key = rank[tied] * n + rank[tied + depth] if len(slots) else key
        again = np.argsort(key) if len(slots) else slots
        order[slots], key = tied[again], key[again]
        depth *= 2
    return order


class BitRows:
    """Equally long rows of bits with the number of ones before any place."""

    def __init__(self, words: np.ndarray) -> None:
        self._words = words  # rows of 64-bit words, the last of a row beyond its bits
        ones = np.bitwise_count(words).astype(np.int32)
        self._before = np.cumsum(ones, axis=1, dtype=np.int32) - ones

    @staticmethod
    def pack(bits: np.ndarray) -> bytes:
        packed = np.packbits(bits, bitorder="little")
        return packed.tobytes() + bytes(8 * (len(bits) // 64 + 1) - len(packed))

    @classmethod
    def unpack(cls, data: bytes, n: int) -> BitRows:
        return cls(np.frombuffer(data, "<u8").reshape(-1, n // 64 + 1))

    def ones(self, row: int, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        below = self._words[row][word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return self._before[row][word] + np.bitwise_count(below)

    def bit(self, row: int, at: np.ndarray) -> np.ndarray:
        return (self._words[row][at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def _bits_of(symbols: int) -> int:
    return max(1, (symbols - 1).bit_length())


def build_shard(doc_ids: Sequence[int | None], lengths: Sequence[int], words: list[bytes]) -> pa.RecordBatch:
    """One index row: the FM-index of documents of the given numbers of words."""
    lengths = np.array(lengths, dtype=np.int64)
    encoded = pa.array(words, pa.binary()).dictionary_encode()
    n = len(words) + len(lengths)
    starts = np.cumsum(lengths + 1) - lengths - 1
    text = np.zeros(n, dtype=np.int32)
    inside = np.ones(n, dtype=bool)
    inside[starts + lengths] = False
    text[inside] = encoded.indices.to_numpy() + 1
    symbols = len(encoded.dictionary) + 1
    order = sort_suffixes(text)
    before = text[order - 1]
    rows = []
    for level in reversed(range(_bits_of(symbols))):
        ones = (before >> level & 1).astype(bool)
        rows.append(BitRows.pack(ones))
        before = np.concatenate([before[~ones], before[ones]])
    offset = np.arange(n) - np.repeat(starts, lengths + 1)
    marked = (offset % SAMPLE_RATE == 0)[order]
    columns = {
        "doc_ids": pa.array([doc_ids], pa.list_(pa.int64())),
        "n_words": pa.array([lengths.astype("<i4").tobytes()], pa.binary()),
        "words": pa.array([b" ".join(encoded.dictionary.to_pylist())], pa.binary()),
        "counts": pa.array([np.bincount(text, minlength=symbols).astype("<i4").tobytes()], pa.binary()),
        "bits": pa.array([b"".join(rows)], pa.binary()),
        "marks": pa.array([BitRows.pack(marked)], pa.binary()),
        "samples": pa.array([order[marked].astype("<i4").tobytes()], pa.binary()),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def build_index(docs: DataFrame) -> tuple[DataFrame, str]:
    """The written shards of `docs` (doc_id, text), and their path. Documents stay where they are read."""

    def compute(batches):
        doc_ids, lengths, words = [], [], []
        for batch in batches:
            for doc_id, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = words_of(body.as_py())
                doc_ids.append(doc_id)
                lengths.append(len(own))
                words += own
                if len(words) + len(lengths) >= SHARD_WORDS:
                    yield build_shard(doc_ids, lengths, words)
                    doc_ids, lengths, words = [], [], []
        if doc_ids:
            yield build_shard(doc_ids, lengths, words)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    return stage(rows.mapInArrow(compute, SHARD), "fm_index")


class Shard:
    """An index row, opened."""

    def __init__(self, row: dict) -> None:
        self.doc_ids = row["doc_ids"].as_py()
        self.lengths = np.frombuffer(row["n_words"].as_py(), "<i4").astype(np.int64)
        self.starts = np.cumsum(self.lengths + 1) - self.lengths - 1
        self.n = int(self.lengths.sum()) + len(self.lengths)
        words = row["words"].as_py()
        self.words = pa.array(words.split(b" ") if words else [], pa.binary())
        counts = np.frombuffer(row["counts"].as_py(), "<i4").astype(np.int64)
        self.firsts = np.r_[0, np.cumsum(counts)]
        self._levels = _bits_of(len(counts))
        self._bits = BitRows.unpack(row["bits"].as_py(), self.n)
        whole = np.array([self.n])
        self._zeros = [self.n - int(self._bits.ones(k, whole)[0]) for k in range(self._levels)]
        # After all levels the symbols lie in the order of their reversed bits.
        symbols = np.arange(len(counts))
        turned = sum((symbols >> k & 1) << (self._levels - 1 - k) for k in range(self._levels))
        by_turned = np.argsort(turned)
        finals = np.empty(len(counts), dtype=np.int64)
        finals[by_turned] = np.cumsum(counts[by_turned]) - counts[by_turned]
        self._shift = self.firsts[:-1] - finals
        self._marks = BitRows.unpack(row["marks"].as_py(), self.n)
        self._samples = np.frombuffer(row["samples"].as_py(), "<i4")

    def before(self, rows: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Where the suffixes lie that have the symbol in front of those before `rows`."""
        at = rows
        for k in range(self._levels):
            ones = self._bits.ones(k, at)
            at = np.where(symbols >> (self._levels - 1 - k) & 1, self._zeros[k] + ones, at - ones)
        return at + self._shift[symbols]

    def step_back(self, rows: np.ndarray) -> np.ndarray:
        """The rows of the suffixes one word longer."""
        at, symbols = rows, np.zeros(len(rows), dtype=np.int64)
        for k in range(self._levels):
            ones, bit = self._bits.ones(k, at), self._bits.bit(k, at)
            at = np.where(bit, self._zeros[k] + ones, at - ones)
            symbols = 2 * symbols + bit
        return at + self._shift[symbols]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases found and their rows (first, stop).

        A row of `phrases` has the symbols of a phrase, -1 in front where it is short, 0 for a word
        the shard does not have.
        """
        found = np.flatnonzero((phrases != 0).all(1))
        last = phrases[found, -1]
        low, high = self.firsts[last], self.firsts[last + 1]
        for column in reversed(range(phrases.shape[1] - 1)):
            symbols = phrases[found, column]
            longer = np.flatnonzero(symbols > 0)
            if not len(longer):
                break
            both = self.before(np.r_[low[longer], high[longer]], np.tile(symbols[longer], 2))
            low[longer], high[longer] = both[:len(longer)], both[len(longer):]
            kept = low < high
            found, low, high = found[kept], low[kept], high[kept]
        return found, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The places in the text of the suffixes in `rows`, none of which starts with a separator."""
        places = np.empty(len(rows), dtype=np.int64)
        waiting, steps = np.arange(len(rows)), 0
        while len(waiting):
            known = self._marks.bit(0, rows)
            places[waiting[known]] = self._samples[self._marks.ones(0, rows[known])] + steps
            waiting, rows = waiting[~known], self.step_back(rows[~known])
            steps += 1
        return places


@dataclass
class Phrases:
    """The distinct phrases of a block of items; `items` has the numbers of each phrase's items."""

    words: pa.Array
    table: np.ndarray
    lengths: np.ndarray
    items: list[np.ndarray]
    names: list[str]

    @classmethod
    def of(cls, named: Sequence[tuple[str | None, list[bytes]]], window: int) -> Phrases:
        """Windows of `window` words; an item of fewer words, but not none, is one phrase."""
        numbers: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[int]] = {}
        names = sorted({name for name, _ in named if name is not None})
        place = {name: i for i, name in enumerate(names)}
        for name, words in named:
            own = [numbers.setdefault(w, len(numbers)) for w in words]
            for i in range(max(len(own) - window, 0) + 1 if own else 0):
                held = owners.setdefault(tuple(own[i:i + window]), set())
                if name is not None:
                    held.add(place[name])
        table = np.full((len(owners), window), -1, dtype=np.int64)
        for row, phrase in zip(table, owners):
            row[window - len(phrase):] = phrase
        return cls(
            pa.array(list(numbers), pa.binary()), table, np.array([len(p) for p in owners], dtype=np.int64),
            [np.array(sorted(o), dtype=np.int64) for o in owners.values()], names,
        )

    def within(self, shard: Shard) -> np.ndarray:
        """The table in the symbols of a shard: -1 stays, 0 for a word it does not have."""
        found = pc.index_in(self.words, value_set=shard.words).fill_null(-1).to_numpy().astype(np.int64) + 1
        return np.where(self.table >= 0, found[self.table], -1) if len(found) else self.table


def find_phrases(shard: Shard, phrases: Phrases) -> pa.RecordBatch:
    """Per document of a shard: its number of words, merged spans of words in phrases, and the items found."""
    found, low, high = shard.search(phrases.within(shard))
    changes = np.zeros(shard.n + 1, dtype=np.int64)
    pairs = []
    for chosen in _portions(high - low):
        sizes = (high - low)[chosen]
        own = np.repeat(found[chosen], sizes)
        rows = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(low[chosen], sizes)
        places = shard.locate(rows)
        changes += np.bincount(places, minlength=shard.n + 1)
        changes -= np.bincount(places + phrases.lengths[own], minlength=shard.n + 1)
        docs = np.searchsorted(shard.starts, places, side="right") - 1
        pairs.append(np.unique(docs * len(phrases.table) + own))
    covered = np.cumsum(changes) > 0
    edges = np.flatnonzero(np.diff(np.r_[False, covered])).reshape(-1, 2)
    span_docs = np.searchsorted(shard.starts, edges[:, 0], side="right") - 1
    edges = (edges - shard.starts[span_docs][:, None]).astype(np.int32)
    spans = pa.ListArray.from_arrays(
        pa.array(np.searchsorted(span_docs, np.arange(len(shard.starts) + 1)).astype(np.int32)),
        pa.StructArray.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], ["first", "stop"]),
    )
    names: list[list[str]] = [[] for _ in shard.doc_ids]
    docs, own = np.divmod(np.unique(np.concatenate(pairs)) if pairs else np.empty(0, np.int64), max(len(phrases.table), 1))
    alike: dict[bytes, list[str]] = {}  # copies hold the same phrases
    for held in np.split(np.arange(len(docs)), np.flatnonzero(np.diff(docs)) + 1) if len(docs) else []:
        key = own[held].tobytes()
        if key not in alike:
            alike[key] = [phrases.names[i] for i in np.unique(np.concatenate([phrases.items[p] for p in own[held]])).tolist()]
        names[docs[held[0]]] = alike[key]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.arange(len(names)), pa.int32()), pa.array(shard.doc_ids, pa.int64()), pa.array(shard.lengths, pa.int64()),
         spans, pa.array(names, pa.list_(pa.string()))],
        ["place", "doc_id", "n_words", "spans", "items"],
    )


def _portions(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Consecutive places whose sizes add up to about LOCATED."""
    turn = (np.cumsum(sizes) - sizes) // LOCATED
    yield from np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(turn)) + 1) if len(sizes) else []


def search_index(shards: DataFrame, phrases: Phrases) -> DataFrame:
    """(shard, place, doc_id, n_words, spans, items) of every document of the index."""

    def compute(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(j)[i] for j, name in enumerate(batch.schema.names)}
                found = find_phrases(Shard(row), phrases)
                yield found.add_column(0, "shard", pa.array([row["shard"].as_py()] * found.num_rows, pa.string()))

    named = shards.select("*", F.concat_ws(":", "_metadata.file_name", "_metadata.row_index").alias("shard"))
    return named.mapInArrow(compute, f"shard string, {FOUND}")


def contaminated_spans(docs: DataFrame, items: DataFrame, window: int = 10, key: str = "item_id") -> DataFrame:
    """(doc_id, n_words, spans, items) for every row of `docs`, one row each.

    spans: merged ranges of words (first, stop; stop exclusive) that lie in a phrase of `items`
    (key, text); items: the keys, as sorted strings, of the items with a phrase in the document.
    A phrase is `window` consecutive words of an item; an item of fewer words is one phrase, of none
    has none. Null and empty texts have no words. Items without a key take words but are not listed;
    rows that share a key are one name. Empty tables give no rows, or rows without spans. Other
    columns are not read. The index is deleted when all blocks of items are searched.
    """
    spark = docs.sparkSession
    shards, path = build_index(docs)
    texts, texts_path = stage(items.select(F.col(key).cast("string").alias("name"), text_bytes().alias("text")), "fm_items")
    size = texts.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = 1 + size // (BLOCK_WORDS * 6)  # about six bytes a word
    dealt = texts.withColumn("block", F.pmod(F.xxhash64("_metadata.file_name", "_metadata.row_index"), F.lit(blocks)))
    found = []
    for block in range(blocks):
        held = dealt.where(F.col("block") == block).select("name", "text").toArrow()
        phrases = Phrases.of([(n, words_of(t)) for n, t in zip(held["name"].to_pylist(), held["text"].to_pylist())], window)
        found.append(stage(search_index(shards, phrases), "fm_found"))
    tables = [table for table, _ in found]
    if blocks == 1:
        out = tables[0].select("doc_id", "n_words", "spans", "items")
    else:
        out = stage(_merged(union_all(tables)), "fm_merged")[0]
        for _, part in found:
            discard(spark, part)
    discard(spark, path)
    discard(spark, texts_path)
    return out


def _merged(found: DataFrame) -> DataFrame:
    """The blocks' results put together: as many rows per document as there are blocks."""
    together = found.groupBy("shard", "place").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )

    def compute(batches):
        for batch in batches:
            spans = []
            for held in batch.column("spans").to_pylist():
                out: list[dict] = []
                for span in held:
                    if out and span["first"] <= out[-1]["stop"]:
                        out[-1]["stop"] = max(out[-1]["stop"], span["stop"])
                    else:
                        out.append(dict(span))
                spans.append(out)
            at = batch.schema.get_field_index("spans")
            yield batch.set_column(at, "spans", pa.array(spans, batch.schema.field(at).type))

    rows = together.select("doc_id", "n_words", "spans", "items")
    return rows.mapInArrow(compute, "doc_id long, n_words long, spans array<struct<first:int,stop:int>>, items array<string>")


def digest(found: DataFrame) -> DataFrame:
    """Numbers of words, hit words and items, the digest of the items' keys, and whether any word is hit."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["first"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )

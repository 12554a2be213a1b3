"""Ranked lexical search over a length-stratified index.

A term's impact in a document depends on its frequency tf there and on the document's normaliser m,
a whole number that grows with the length. Documents are therefore grouped by equal m (a stratum),
and within a stratum a term's postings are grouped by tf, so that an impact is computed once per
(stratum, tf). The index is a table of segments: a row holds the postings of consecutive strata, and
a stratum with very many documents goes on in the next rows.

A search reads every segment where it lies. The largest impacts of the query's terms bound a
stratum's scores; strata are visited from the highest bound down until it falls below the score of
the last document kept so far, which a task carries from segment to segment.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import floor, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import union_all
from ..sources.staging import discard
from .common import stage, text_bytes
from .words import words_of

#: A segment ends with the document that brings it to so many postings or documents; the latter fit 16 bits.
SEGMENT_POSTINGS, SEGMENT_DOCUMENTS = 1 << 18, 1 << 15
#: Strata are dealt to tasks in sections of about so many postings.
SECTION_POSTINGS = 1 << 18
#: Strata from this m on share one entry of the table of sections, which bounds that table.
LAST_STRATUM = 1 << 16
#: Queries are searched in blocks of about so many terms, which bounds what a task is sent.
BLOCK_TERMS = 50_000
#: Documents of the strata visited first; every further visit takes twice as many.
FIRST_VISIT = 1024

SEGMENT = (
    "doc_ids array<long>, strata array<long>, stratum_docs binary, terms binary, dfs binary, "
    "term_groups binary, group_stratum binary, group_tf binary, group_docs binary, docs binary"
)
_LAST = np.iinfo(np.int64).max


def term_counts(rows: DataFrame, key: str) -> DataFrame:
    """(key, n, terms, tfs) of every row with a term: n counts terms with repeats, the lists have each term once."""
    kind = rows.schema[key].dataType.simpleString()

    def compute(batches):
        for batch in batches:
            totals, terms, tfs = [], [], []
            for body in batch.column(1):
                counts = Counter(words_of(body.as_py()))
                totals.append(counts.total())
                terms.append(b" ".join(counts))
                tfs.append(np.fromiter(counts.values(), "<i4", len(counts)).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(totals, pa.int64()), pa.array(terms, pa.binary()), pa.array(tfs, pa.binary())],
                [key, "n", "terms", "tfs"],
            )

    texts = rows.select(key, text_bytes().alias("text"))
    return texts.mapInArrow(compute, f"{key} {kind}, n long, terms binary, tfs binary").where("n > 0")


def place_hash():
    """A hash of a written row's place, which tells equal rows apart the same way in every attempt."""
    return F.xxhash64("_metadata.file_name", "_metadata.row_index")


@dataclass
class LexicalIndex:
    """The written segments with the number of documents that have a term."""

    segments: DataFrame
    path: str
    n_docs: int


def build_index(docs: DataFrame) -> LexicalIndex:
    """Index every row of `docs` (doc_id, text) that has a term.

    Consecutive strata are dealt together in sections of about equally many postings; a stratum with
    more is dealt by a hash of the row's place. Rows that share a doc_id are documents of their own.
    """
    spark = docs.sparkSession
    counted, path = stage(
        term_counts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id"), "lexical_terms"
    )
    n_docs, n_terms = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    measured = counted.select(
        "doc_id", "terms", "tfs", F.expr(f"50L + (50L * n * {n_docs}L) div {max(n_terms, 1)}L").alias("m"),
        place_hash().alias("place"),
    )
    measured = measured.withColumn("bucket", F.least("m", F.lit(LAST_STRATUM)))
    weights = measured.groupBy("bucket").agg(F.sum(F.length("tfs") / 4).cast("long").alias("weight"))
    # At most LAST_STRATUM rows reach this window and the broadcast.
    earlier = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sections = weights.withColumn("before", F.coalesce(F.sum("weight").over(earlier), F.lit(0))).select(
        "bucket", F.expr(f"before div {SECTION_POSTINGS}").alias("section"), F.expr(f"1 + weight div {SECTION_POSTINGS}").alias("lanes")
    )
    dealt = measured.join(F.broadcast(sections), "bucket").withColumn(
        "section", F.col("section") + F.pmod("place", "lanes")
    )
    ordered = dealt.select("section", "doc_id", "m", "terms", "tfs", "place").repartition("section").sortWithinPartitions(
        "section", "m", "place"
    )
    segments, index_path = stage(ordered.mapInArrow(_segments, SEGMENT), "lexical_index")
    discard(spark, path)
    return LexicalIndex(segments, index_path, n_docs)


def _segments(batches) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    postings = section = 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("section", "doc_id", "m", "terms", "tfs"))):
            if held and row[0] != section:
                yield _segment(held)
                held, postings = [], 0
            section = row[0]
            held.append(row[1:])
            postings += len(row[4]) // 4
            if postings >= SEGMENT_POSTINGS or len(held) >= SEGMENT_DOCUMENTS:
                yield _segment(held)
                held, postings = [], 0
    if held:
        yield _segment(held)


def _packed(values, kind: str = "<i4") -> pa.Array:
    return pa.array([np.asarray(values).astype(kind).tobytes()], pa.binary())


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term of weight 1 adds to a score; below 1,000,000."""
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


def _segment(rows: list[tuple]) -> pa.RecordBatch:
    """One index row of documents in ascending order of m."""
    doc_ids, lengths, terms, tfs = zip(*rows)
    m, stratum_docs = np.unique(np.array(lengths, dtype=np.int64), return_counts=True)
    stratum_of = np.repeat(np.arange(len(m)), stratum_docs)
    split = pc.split_pattern(pa.array(terms, pa.large_binary()).cast(pa.large_string()), " ").flatten().dictionary_encode()
    term = split.indices.to_numpy().astype(np.int64)
    doc = np.repeat(np.arange(len(rows)), [len(t) // 4 for t in tfs])
    tf = np.frombuffer(b"".join(tfs), "<i4").astype(np.int64)
    order = np.lexsort((doc, tf, stratum_of[doc], term))
    term, doc, tf = term[order], doc[order], tf[order]
    stratum = stratum_of[doc]
    starts = np.flatnonzero(np.r_[True, (np.diff(term) != 0) | (np.diff(stratum) != 0) | (np.diff(tf) != 0)])
    columns = {
        "doc_ids": pa.array([doc_ids], pa.list_(pa.int64())),
        "strata": pa.array([m], pa.list_(pa.int64())),
        "stratum_docs": _packed(stratum_docs),
        "terms": pa.array([b" ".join(t.encode() for t in split.dictionary.to_pylist())], pa.binary()),
        "dfs": _packed(np.bincount(term, minlength=len(split.dictionary))),
        "term_groups": _packed(np.bincount(term[starts], minlength=len(split.dictionary))),
        "group_stratum": _packed(stratum[starts], "<u2"),
        "group_tf": _packed(tf[starts]),
        "group_docs": _packed(np.diff(np.r_[starts, len(doc)]), "<u2"),
        "docs": _packed(doc, "<u2"),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


class Segment:
    """An index row, opened for the terms of a block of queries."""

    def __init__(self, row: dict, numbers: dict[bytes, int], weights: np.ndarray) -> None:
        def ints(name: str, kind: str = "<i4") -> np.ndarray:
            return np.frombuffer(row[name].as_py(), kind)

        ids = row["doc_ids"].values
        self.unnamed = np.asarray(ids.is_null())
        self.doc_ids = ids.fill_null(_LAST).to_numpy()
        self.stratum_docs = ints("stratum_docs")
        self.stratum_of = np.repeat(np.arange(len(self.stratum_docs)), self.stratum_docs)
        self._groups = np.r_[0, np.cumsum(ints("term_groups"))]
        self._sizes, self._docs = ints("group_docs", "<u2"), ints("docs", "<u2")
        self._ends = np.cumsum(self._sizes, dtype=np.int64)
        self._m, self._stratum, self._tf = row["strata"].values.to_numpy(), ints("group_stratum", "<u2"), ints("group_tf")
        self._weights = weights
        wanted = map(numbers.get, row["terms"].as_py().split(b" "))
        self._place = {number: i for i, number in enumerate(wanted) if number is not None}
        self._open: dict[int, tuple] = {}

    def postings(self, number: int) -> tuple | None:
        """Documents and gains of a query term, then its strata and their largest gains; None without postings."""
        if number not in self._open:
            i = self._place.get(number)
            self._open[number] = None if i is None else self._read(i, int(self._weights[number]))
        return self._open[number]

    def _read(self, i: int, weight: int) -> tuple:
        first, last = self._groups[i], self._groups[i + 1]
        sizes, strata = self._sizes[first:last], self._stratum[first:last]
        gains = impacts(self._tf[first:last].astype(np.int64), self._m[strata]) * weight
        docs = self._docs[self._ends[first] - int(sizes[0]):self._ends[last - 1]]
        # Groups ascend by tf within a stratum, and so do their gains.
        highest = np.flatnonzero(np.r_[np.diff(strata) != 0, True])
        return docs, np.repeat(gains, sizes), strata[highest], gains[highest]


class Best:
    """The k documents with the highest scores of one query; ties go to the smaller id, null ids last."""

    def __init__(self, k: int) -> None:
        self._k = k
        self.scores = self.ids = np.empty(0, np.int64)
        self.unnamed = np.empty(0, bool)

    @property
    def least(self) -> int:
        """A score below which no document is wanted any more."""
        return int(self.scores[-1]) if len(self.scores) == self._k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray, unnamed: np.ndarray) -> None:
        scores, ids = np.r_[self.scores, scores], np.r_[self.ids, ids]
        unnamed = np.r_[self.unnamed, unnamed]
        if len(scores) > 4 * self._k:
            near = np.flatnonzero(scores >= np.partition(scores, -self._k)[-self._k])
            scores, ids, unnamed = scores[near], ids[near], unnamed[near]
        order = np.lexsort((ids, unnamed, -scores))[:self._k]
        self.scores, self.ids, self.unnamed = scores[order], ids[order], unnamed[order]


def search_segment(segment: Segment, terms: list[int], best: Best) -> int:
    """Adds a segment's best documents for one query; the number of documents scored."""
    found = [p for p in map(segment.postings, terms) if p is not None]
    bounds = np.zeros(len(segment.stratum_docs), dtype=np.int64)
    for _, _, strata, gains in found:
        bounds[strata] += gains
    order = np.argsort(-bounds, kind="stable")
    visited, visit, scored = 0, FIRST_VISIT, 0
    while visited < len(order) and bounds[order[visited]] >= best.least:
        alive = int(np.searchsorted(-bounds[order], -best.least, side="right"))
        reached = np.cumsum(segment.stratum_docs[order[visited:alive]])
        until = visited + int(np.searchsorted(reached, visit)) + 1
        now = order[visited:min(until, alive)]
        scores = np.zeros(len(segment.doc_ids), dtype=np.int64)
        if len(now) == len(order):
            for docs, gains, _, _ in found:
                scores[docs] += gains  # a term has a document once
        else:
            open_ = np.zeros(len(order), dtype=bool)
            open_[now] = True
            open_ = open_[segment.stratum_of]
            for docs, gains, _, _ in found:
                chosen = open_[docs]
                scores[docs[chosen]] += gains[chosen]
        high = np.flatnonzero(scores >= best.least)
        best.add(scores[high], segment.doc_ids[high], segment.unnamed[high])
        scored += int(segment.stratum_docs[now].sum())
        visited, visit = visited + len(now), 2 * visit
    return scored


def _document_frequencies(index: LexicalIndex, terms: list[bytes]) -> dict[int, int]:
    """Documents that hold each of the terms, by its number."""
    numbers = {t: i for i, t in enumerate(terms)}

    def compute(batches):
        for batch in batches:
            for held, dfs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = [(numbers[t], n) for t, n in zip(held.split(b" "), np.frombuffer(dfs, "<i4").tolist()) if t in numbers]
                if found:
                    number, df = zip(*found)
                    yield pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), pa.array(df, pa.int64())], ["number", "df"])

    counted = index.segments.select("terms", "dfs").mapInArrow(compute, "number int, df long")
    return {r.number: r.df for r in counted.groupBy("number").agg(F.sum("df").alias("df")).collect()}  # one row per query term


def _search_block(index: LexicalIndex, block: pa.Table, key: str, kind: str, k: int) -> DataFrame:
    queries = [t.split(b" ") for t in block.column("terms").to_pylist()]
    terms = sorted({t for q in queries for t in q})
    numbers = {t: i for i, t in enumerate(terms)}
    dfs = _document_frequencies(index, terms)
    weights = np.array([floor(1000 * log((2 * index.n_docs + 2) / (2 * dfs.get(i, 0) + 1))) for i in range(len(terms))], dtype=np.int64)
    wanted = [[numbers[t] for t in q] for q in queries]
    keys = block.column(key).combine_chunks()

    def compute(batches):
        best = [Best(k) for _ in wanted]
        for batch in batches:
            for i in range(batch.num_rows):
                segment = Segment({n: batch.column(j)[i] for j, n in enumerate(batch.schema.names)}, numbers, weights)
                for query, own in zip(wanted, best):
                    search_segment(segment, query, own)
        for number, own in enumerate(best):
            if len(own.ids):
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(own.ids), number, np.int32)),
                    pa.concat_arrays([keys.slice(number, 1)] * len(own.ids)),
                    pa.array(own.ids, mask=own.unnamed), pa.array(own.scores),
                ], ["query", key, "doc_id", "score"])

    found = index.segments.mapInArrow(compute, f"query int, {key} {kind}, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(key, "rank", "doc_id", "score")


def search(index: LexicalIndex, items: DataFrame, k: int = 50, key: str = "item_id") -> DataFrame:
    """(key, rank, doc_id, score): the k best documents with a score above 0 for every row of `items` (key, text).

    Rows of `items` that share a key are searched one by one. The items are sent to the tasks in
    blocks of about BLOCK_TERMS terms, and each block's results are written before the next.
    """
    kind = items.schema[key].dataType.simpleString()
    rows, path = stage(term_counts(items.select(key, "text"), key), "lexical_items")
    each = (F.length("tfs") / 4).cast("long")
    blocks = 1 + (rows.agg(F.coalesce(F.sum(each), F.lit(0))).first()[0] // BLOCK_TERMS)
    dealt = rows.withColumn("block", F.pmod(place_hash(), F.lit(blocks)))
    results = []
    for block in range(blocks):
        held = dealt.where(F.col("block") == block).select(key, "terms").toArrow()
        results.append(stage(_search_block(index, held, key, kind, k), "lexical_hits")[0])
    discard(items.sparkSession, path)
    return union_all(results)


def ranked_documents(docs: DataFrame, items: DataFrame, k: int = 50, key: str = "item_id") -> DataFrame:
    """Index `docs`, search it for `items`, and delete the index.

    Null and empty texts have no term: such documents are not counted, such items have no result.
    Empty tables give an empty result. Only key, doc_id and text are read.
    """
    index = build_index(docs)
    found = search(index, items, k, key)
    discard(docs.sparkSession, index.path)
    return found

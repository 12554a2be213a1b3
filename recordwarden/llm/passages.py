"""Substring dedup: passages that an earlier document already holds, by suffix automata.

A window is `window` consecutive words. A window repeats if its words also start somewhere in a
document with a smaller id; every word that a repeated window covers is removed.

1. Documents with the same words are folded: all but the first lose every window, and need no text.
2. Each window has an anchor, the short run of words in it with the lowest hash. Equal windows have
   equal anchors, so only windows whose anchor occurs in several documents can repeat.
3. Hashes of those windows are reduced to the smallest document that holds them. That only nominates
   references and the documents to hold against them; where they agree is left open.
4. Whole references form shards of bounded size, with one suffix automaton each; a long reference is
   cut into parts that overlap by a window less a word. Whole documents stream past the automata of
   the shards they were nominated for. Matching statistics, with the earliest document that holds
   each run, decide word by word which windows repeat. Maximal spans of such windows are removed.

An automaton is sent to the tasks that hold its documents instead of to all: the automata grow with
the corpus. A shard that very many documents visit is copied to several lanes. A task holds one
automaton and one batch of documents.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, text_bytes

WINDOW = 50
ANCHOR = 8
#: Words of documents that stream past one copy of a shard, and of references in a shard or a part.
LANE_WORDS, SHARD_WORDS, PART_WORDS = 1_000_000, 100_000, 50_000

#: Tasks that copies of one text are dealt to: one bit of a long each.
COPY_LANES = 64

_NOBODY = float("inf")
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


class WordHashes:
    """Hashes of runs of words, from one polynomial prefix sum over the bytes of a text."""

    _letters = np.random.default_rng(5).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def __init__(self) -> None:
        self._up = self._down = np.ones(1, dtype=np.uint64)

    def _powers(self, n: int) -> None:
        if len(self._up) < n:
            size = max(n, 2 * len(self._up), 1 << 12)
            for name, base in (("_up", _BASE), ("_down", _INVERSE)):
                steps = np.full(size, base, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))

    def load(self, line: bytes) -> int:
        """Take the words of a text, joined by single spaces; their number."""
        octets = np.frombuffer(line, dtype=np.uint8)
        self._powers(len(octets) + 1)
        sums = np.cumsum(self._letters[octets] * self._up[:len(octets)])
        self._sums = np.concatenate([np.zeros(1, np.uint64), sums])
        gaps = np.flatnonzero(octets == 32)
        self.starts = np.concatenate([[0], gaps + 1])
        self.ends = np.concatenate([gaps, [len(octets)]])
        return len(self.starts)

    def runs(self, words: int) -> np.ndarray:
        """The hash of every run of so many words."""
        first = self.starts[: len(self.starts) - words + 1]
        mixed = (self._sums[self.ends[words - 1:]] - self._sums[first]) * self._down[first]
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        return mixed ^ (mixed >> np.uint64(29))

    def anchors(self, window: int, anchor: int) -> np.ndarray:
        """The lowest hash among the runs of `anchor` words in every window."""
        low = self.runs(anchor)
        size, step = window - anchor + 1, 1
        n = len(low) - size + 1
        while 2 * step <= size:
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        return np.minimum(low[:n], low[size - step:size - step + n])


class SuffixAutomaton:
    """All runs of the words of some texts, with the smallest owner of each; a text does not
    continue into the next."""

    def __init__(self) -> None:
        self._next: list[dict] = [{}]
        self._link = [-1]
        self._length = [0]
        self._owner: list = [_NOBODY]
        self._settled = True

    def add(self, words: list, owner: int = 0) -> None:
        last = 0
        for word in words:
            last = self._extend(last, word)
            self._owner[last] = min(self._owner[last], owner)
        self._settled = False

    def _state(self, length: int, following: dict, link: int) -> int:
        self._next.append(following)
        self._length.append(length)
        self._link.append(link)
        self._owner.append(_NOBODY)
        return len(self._link) - 1

    def _split(self, above: int, word, below: int) -> int:
        """The state for the word after `above`; `below` is cut if it stands for longer runs."""
        nxt, link, length = self._next, self._link, self._length
        if length[below] == length[above] + 1:
            return below
        copy = self._state(length[above] + 1, dict(nxt[below]), link[below])
        while above >= 0 and nxt[above].get(word) == below:
            nxt[above][word] = copy
            above = link[above]
        link[below] = copy
        return copy

    def _extend(self, last: int, word) -> int:
        nxt, link = self._next, self._link
        above = last
        if word in nxt[above]:
            return self._split(above, word, nxt[above][word])
        state = self._state(self._length[above] + 1, {}, 0)
        while above >= 0 and word not in nxt[above]:
            nxt[above][word] = state
            above = link[above]
        if above >= 0:
            link[state] = self._split(above, word, nxt[above][word])
        return state

    def _settle(self) -> None:
        """Whoever holds a run holds its suffixes: hand owners up the links, longest runs first."""
        link, owner = self._link, self._owner
        for state in np.argsort(-np.array(self._length), kind="stable").tolist():
            up = link[state]
            if up >= 0 and owner[state] < owner[up]:
                owner[up] = owner[state]
        self._settled = True

    def matching_statistics(self, words: list, longest: int, before: int | None = None) -> list[int]:
        """For every word the length of the longest run ending there that the texts hold, up to `longest`.

        With `before`, runs of that length count as one word shorter unless a smaller owner holds them.
        """
        if not self._settled:
            self._settle()
        nxt, link, length, owner = self._next, self._link, self._length, self._owner
        state = held = 0
        found = []
        for word in words:
            while state and word not in nxt[state]:
                state = link[state]
                held = length[state]
            if word in nxt[state]:
                state = nxt[state][word]
                held += 1
                if held >= longest:
                    # Forget earlier words, so that the state stands for the run of that length.
                    held = longest
                    while length[link[state]] >= longest:
                        state = link[state]
            late = before is not None and held == longest and owner[state] >= before
            found.append(held - 1 if late else held)
        return found


def spans(statistics: list[int], window: int) -> list[tuple[int, int]]:
    """Maximal spans of words that runs of at least `window` words cover."""
    found: list[tuple[int, int]] = []
    for end, held in enumerate(statistics, 1):
        if held >= window:
            if found and found[-1][1] >= end - window:
                found[-1] = (found[-1][0], end)
            else:
                found.append((end - window, end))
    return found


def _lane() -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(COPY_LANES)).cast("int")


def _sha(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()


def _scan(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """(doc_id, n_words, sha, anchors) of every row: the digest of its words, and its distinct anchors."""

    def compute(batches):
        hashes = WordHashes()
        for batch in batches:
            counts, digests, anchors = [], [], []
            for text in batch.column(1).to_pylist():
                words = text.split()  # bytes: ASCII white space only
                line = b" ".join(words)
                counts.append(len(words))
                digests.append(_sha(line))
                if len(words) >= window:
                    hashes.load(line)
                    anchors.append(np.unique(hashes.anchors(window, anchor)).view(np.int64))
                else:
                    anchors.append(np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(anchors, pa.list_(pa.int64()))],
                ["doc_id", "n_words", "sha", "anchors"],
            )

    return docs.mapInArrow(compute, "doc_id long, n_words long, sha binary, anchors array<long>")


def _words_of(texts: DataFrame) -> DataFrame:
    """(sha, doc_id, cid, n, line, anchors) of the rows whose words have the digest they were joined for."""

    def compute(batches):
        for batch in batches:
            rows = []
            for doc_id, text, sha, anchors in zip(*(c.to_pylist() for c in batch.columns)):
                words = text.split()
                line = b" ".join(words)
                if _sha(line) == sha:
                    rows.append((sha, doc_id, int.from_bytes(sha[:8], "little", signed=True), len(words), line, anchors))
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
            columns = zip(*rows) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds)], ["sha", "doc_id", "cid", "n", "line", "anchors"]
            )

    return texts.mapInArrow(compute, "sha binary, doc_id long, cid long, n long, line binary, anchors array<long>")


def _windows(texts: DataFrame, window: int, anchor: int) -> DataFrame:
    """(hash, doc_id, cid) of the distinct windows whose anchor several documents hold."""

    def compute(batches):
        hashes = WordHashes()
        for batch in batches:
            for doc_id, cid, line, anchors in zip(*(c.to_pylist() for c in batch.columns)):
                hashes.load(line)
                shared = np.isin(hashes.anchors(window, anchor), np.array(anchors, dtype=np.int64).view(np.uint64))
                found = np.unique(hashes.runs(window)[shared]).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found), pa.array(np.full(len(found), doc_id)), pa.array(np.full(len(found), cid))],
                    ["hash", "doc_id", "cid"],
                )

    return texts.select("doc_id", "cid", "line", "anchors").mapInArrow(compute, "hash long, doc_id long, cid long")


def _parts(references: DataFrame, window: int, size: int) -> DataFrame:
    """(doc_id, cid, part, line): references in parts of `size` words, each window whole in one of them."""

    def compute(batches):
        for batch in batches:
            for doc_id, cid, line in zip(*(c.to_pylist() for c in batch.columns)):
                words = line.split(b" ")
                lines = [b" ".join(words[a:a + size + window - 1]) for a in range(0, max(len(words) - window + 1, 1), size)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc_id] * len(lines), pa.int64()), pa.array([cid] * len(lines), pa.int64()),
                     pa.array(range(len(lines)), pa.int32()), pa.array(lines, pa.binary())],
                    ["doc_id", "cid", "part", "line"],
                )

    return references.select("doc_id", "cid", "line").mapInArrow(compute, "doc_id long, cid long, part int, line binary")


def _streamed(rows: DataFrame, window: int) -> DataFrame:
    """(cid, start, stop): spans of documents that earlier ones hold, from rows (shard, lane, visits,
    doc_id, cid, line) sorted by the first three: the references of a shard, then its visitors."""

    def compute(batches):
        at = automaton = None
        for batch in batches:
            found = []
            for shard, lane, visits, doc_id, cid, line in zip(*(c.to_pylist() for c in batch.columns)):
                if (shard, lane) != at:
                    at, automaton = (shard, lane), SuffixAutomaton()
                words = line.split(b" ")
                if visits:
                    held = automaton.matching_statistics(words, window, before=doc_id)
                    found += [(cid, *span) for span in spans(held, window)]
                else:
                    automaton.add(words, doc_id)
            columns = zip(*found) if found else [[]] * 3
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32()))], ["cid", "start", "stop"]
            )

    return rows.mapInArrow(compute, "cid long, start int, stop int")


def _repeated_spans(texts: DataFrame, pairs: DataFrame, window: int) -> DataFrame:
    """(cid, start, stop) of `texts` (doc_id, cid, n, line) held against the references of `pairs` (cid, ref)."""
    named = pairs.select(F.col("ref").alias("doc_id")).distinct()
    references = texts.join(named, "doc_id", "left_semi")
    words = references.agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-words // SHARD_WORDS))
    shard = F.pmod(F.xxhash64("cid", "part"), F.lit(shards)).alias("shard")
    parts = staged(_parts(references, window, PART_WORDS).select(shard, "doc_id", "cid", "line"), "passages_parts")
    held = parts.select(F.col("doc_id").alias("ref"), "shard").distinct()
    visits = staged(pairs.join(held, "ref").select("cid", "shard").distinct(), "passages_visits")
    load = visits.join(texts.select("cid", "n"), "cid").groupBy("shard").agg(F.sum("n").alias("n"))
    lanes = load.select("shard", F.ceil(F.col("n") / LANE_WORDS).cast("int").alias("lanes"))
    visitors = visits.join(lanes, "shard").join(texts.select("doc_id", "cid", "line"), "cid")
    rows = (
        parts.join(lanes, "shard").withColumn("lane", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1)))
        .select("shard", "lane", F.lit(False).alias("visits"), "doc_id", "cid", "line")
        .union(visitors.select(
            "shard", F.pmod(F.xxhash64("cid"), F.col("lanes")).cast("int"), F.lit(True), "doc_id", "cid", "line",
        ))
    )
    return _streamed(rows.repartition("shard", "lane").sortWithinPartitions("shard", "lane", "visits"), window)


def _kept(texts: DataFrame) -> DataFrame:
    """(sha, n_removed, kept) after the spans are taken out."""

    def compute(batches):
        for batch in batches:
            removed, kept = [], []
            for line, starts, stops in zip(*(c.to_pylist() for c in batch.columns[1:])):
                words = line.split(b" ")
                steps = np.zeros(len(words) + 1, dtype=np.int64)
                np.add.at(steps, starts, 1)
                np.add.at(steps, stops, -1)
                stays = np.cumsum(steps[:-1]) == 0
                removed.append(int(len(words) - stays.sum()))
                kept.append(b" ".join(w for w, stay in zip(words, stays.tolist()) if stay))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(removed, pa.int64()), pa.array(map(_sha, kept), pa.binary())], ["sha", "n_removed", "kept"]
            )

    return texts.select("sha", "line", "starts", "stops").mapInArrow(compute, "sha binary, n_removed long, kept binary")


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every row of `docs`; doc_id and text are read.

    Words are separated by ASCII white space; a null text has none. Rows that share a doc_id are
    never earlier than one another. A row without a doc_id stays whole and repeats nothing. Texts
    of fewer words than a window stay whole.
    """
    anchor = min(anchor, window)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    scanned = staged(_scan(source, window, anchor), "passages_scan")
    named = scanned.where((F.col("n_words") >= window) & F.col("doc_id").isNotNull())
    # Copies of one text are dealt to lanes by their id; bits say which lanes a text uses.
    used = F.bit_or(F.expr("shiftleft(1L, lane)")).alias("lanes")
    laned = named.withColumn("lane", _lane()).groupBy("sha").agg(F.min("doc_id").alias("doc_id"), used)
    classes = staged(laned, "passages_classes")

    anchors = named.join(classes, ["sha", "doc_id"]).select("sha", "doc_id", F.explode("anchors").alias("anchor"))
    # Written, so that both sides of the join come from plain exchanges and a hot anchor can be split.
    shared = anchors.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b")
    shared = staged(shared.select("anchor"), "passages_anchors")
    touched = anchors.join(shared, "anchor").groupBy("sha", "doc_id").agg(F.collect_set("anchor").alias("anchors"))
    texts = staged(_words_of(source.join(touched, "doc_id").select("doc_id", "text", "sha", "anchors")), "passages_texts")

    windows = staged(_windows(texts, window, anchor), "passages_windows")
    repeated = windows.groupBy("hash").agg(F.min("doc_id").alias("ref"), F.max("doc_id").alias("b")).where("ref < b")
    repeated = staged(repeated.select("hash", "ref"), "passages_repeated")
    pairs = staged(windows.join(repeated, "hash").where("ref < doc_id").select("cid", "ref").distinct(), "passages_pairs")
    lines = texts.select("sha", "cid", "doc_id", "n", "line")
    found = _repeated_spans(lines.drop("sha"), pairs, window)
    taken = found.groupBy("cid").agg(F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops"))
    results = _kept(lines.join(taken, "cid")).dropDuplicates(["sha"])

    held = classes.join(results, "sha", "left").withColumnsRenamed({"sha": "s", "doc_id": "first"})
    held = held.withColumn("l", F.explode(F.sequence(F.lit(0), F.lit(COPY_LANES - 1)))).where("(shiftright(lanes, l) & 1L) = 1L")
    rows = scanned.select("doc_id", "n_words", "sha", _lane().alias("lane")).join(
        held.drop("lanes"), (F.col("sha") == F.col("s")) & (F.col("lane") == F.col("l")), "left"
    )
    copy = F.col("doc_id") > F.col("first")
    changed = (F.col("doc_id") == F.col("first")) & F.col("kept").isNotNull()
    return rows.select(
        "doc_id", "n_words",
        F.when(copy, F.col("n_words")).when(changed, F.col("n_removed")).otherwise(0).cast("long").alias("n_removed"),
        F.lower(F.when(copy, F.sha2(F.lit("").cast("binary"), 256)).when(changed, F.hex("kept")).otherwise(F.hex("sha"))).alias("kept_sha256"),
    )

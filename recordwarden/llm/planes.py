"""A binary file format for token ids: blocks of ids, transposed into planes and compressed.

A file holds the ids of consecutive documents. Its ids are cut into blocks of `block` ids (the last
may be shorter). A block is transposed into 4 byte planes or 32 bit planes, and each plane is
compressed with zstandard; an all-zero plane takes no space. Layout, all numbers little-endian:

    magic, version, planes per block, ids per block
    the planes of all blocks, one after another
    document table: doc_ids, flags for null, numbers of ids (each compressed)
    chunk index: per block its place, number of ids and the size of every plane
    places of the table and the index, number of documents, number of blocks, magic
"""

from __future__ import annotations

import struct
import uuid
import zlib
from contextlib import suppress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staging_path
from .common import staged
from .tokens import END_ID, worker_encoder

MAGIC = b"IDPLANES"
HEAD = "<8sIII"
FOOT = "<QQQQ8s"
PLANES = {"byte": 4, "bit": 32}
#: A file is read back whole, so it ends with the document that brings it to so many ids (256 MB of them).
FILE_IDS = 1 << 26
FILES_PER_TASK = 1_000_000


def to_planes(ids: np.ndarray, planes: int) -> list[bytes]:
    octets = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if planes == 4:
        return [np.ascontiguousarray(octets[:, k]).tobytes() for k in range(4)]
    bits = np.unpackbits(octets, axis=1, bitorder="little")
    return [p.tobytes() for p in np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")]


def from_planes(planes: list[bytes | None], n: int) -> np.ndarray:
    """Ids from their planes; a plane of None is all zero."""
    if len(planes) == 4:
        octets = np.zeros((n, 4), dtype=np.uint8)
        for k, plane in enumerate(planes):
            if plane is not None:
                octets[:, k] = np.frombuffer(plane, dtype=np.uint8)
        return octets.view("<u4").ravel()
    ids = np.zeros(n, dtype="<u4")
    for k, plane in enumerate(planes):
        if plane is not None:
            bits = np.unpackbits(np.frombuffer(plane, dtype=np.uint8), count=n, bitorder="little")
            ids |= bits.astype("<u4") << np.uint32(k)
    return ids


class PlaneWriter:
    """Writes one file; holds one block of ids and the tables."""

    def __init__(self, sink, planes: str = "byte", block: int = 1 << 16, level: int = 3) -> None:
        self._sink, self._planes, self._block = sink, PLANES[planes], block
        self._zstd = zstandard.ZstdCompressor(level=level)
        self._at = 0
        self._waiting = bytearray()
        self._index: list[tuple[int, ...]] = []
        self._docs: list[tuple[int | None, int]] = []
        self._put(struct.pack(HEAD, MAGIC, 1, self._planes, block))

    def _put(self, data: bytes) -> None:
        self._sink.write(data)
        self._at += len(data)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """Append a document; `ids` are little-endian unsigned 32-bit numbers."""
        self._docs.append((doc_id, len(ids) // 4))
        self._waiting += ids
        size = 4 * self._block
        whole = len(self._waiting) // size * size
        if whole:
            for i in range(0, whole, size):
                self._flush(bytes(self._waiting[i:i + size]))
            del self._waiting[:whole]

    def _flush(self, ids: bytes) -> None:
        sizes, place = [], self._at
        for plane in to_planes(np.frombuffer(ids, dtype="<u4"), self._planes):
            packed = self._zstd.compress(plane) if any(plane) else b""
            sizes.append(len(packed))
            self._put(packed)
        self._index.append((place, len(ids) // 4, *sizes))

    def close(self) -> tuple[int, int]:
        """Write the tables; the numbers of documents and of ids."""
        if self._waiting:
            self._flush(bytes(self._waiting))
        table = self._at
        columns = (
            np.array([0 if d is None else d for d, _ in self._docs], dtype="<i8"),
            np.array([d is None for d, _ in self._docs], dtype=np.uint8),
            np.array([n for _, n in self._docs], dtype="<u8"),
        )
        for column in columns:
            packed = self._zstd.compress(column.tobytes())
            self._put(struct.pack("<Q", len(packed)) + packed)
        index = self._at
        self._put(np.array(self._index, dtype="<u8").tobytes())
        self._put(struct.pack(FOOT, table, index, len(self._docs), len(self._index), MAGIC))
        return len(self._docs), int(columns[2].sum())


class PlaneFile:
    """Reads one file from its bytes."""

    def __init__(self, data: bytes) -> None:
        self._data = data
        magic, version, self._planes, _ = struct.unpack_from(HEAD, data)
        table, index, docs, blocks, end = struct.unpack_from(FOOT, data, len(data) - struct.calcsize(FOOT))
        if magic != MAGIC or end != MAGIC or version != 1:
            raise ValueError("not a file of id planes")
        self._zstd = zstandard.ZstdDecompressor()
        self._index = np.frombuffer(data, "<u8", blocks * (2 + self._planes), index).reshape(blocks, 2 + self._planes).tolist()
        columns = []
        for kind in ("<i8", np.uint8, "<u8"):
            (size,) = struct.unpack_from("<Q", data, table)
            columns.append(np.frombuffer(self._zstd.decompress(data[table + 8:table + 8 + size]), kind))
            table += 8 + size
        self.doc_ids = [None if none else d for d, none in zip(columns[0].tolist(), columns[1])]
        self.lengths = columns[2].astype(np.int64)

    def block(self, i: int) -> np.ndarray:
        """The ids of one block, found through the chunk index."""
        place, n, *sizes = self._index[i]
        planes = []
        for size in sizes:
            planes.append(self._zstd.decompress(self._data[place:place + size]) if size else None)
            place += size
        return from_planes(planes, n)

    def documents(self):
        """(doc_id, ids as bytes) of every document; holds one block and one document."""
        buffer, following = b"", 0
        for doc_id, n in zip(self.doc_ids, self.lengths.tolist()):
            parts = [buffer]
            held = len(buffer)
            while held < 4 * n:
                parts.append(self.block(following).tobytes())
                following += 1
                held += len(parts[-1])
            buffer = b"".join(parts)
            yield doc_id, buffer[:4 * n]
            buffer = buffer[4 * n:]


def write_token_files(
    docs: DataFrame, vocabulary: str, folder: str, planes: str = "byte", block: int = 1 << 16, file_ids: int = FILE_IDS
) -> DataFrame:
    """Encode every row of `docs` and write its ids in ascending doc_id order to files in `folder`.

    Rows are range-partitioned and sorted by doc_id (nulls first), rows that share one by the hash of
    their text. A partition's files are numbered in that order; the next begins after the document
    that brings a file to `file_ids` ids. A file first has a name of its own attempt and is renamed
    when complete; the draft of a failed attempt is deleted. Returns (file, n_docs, n_ids) per file.
    """
    end = END_ID.to_bytes(4, "little")

    def compute(batches):
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(folder)
        first = TaskContext.get().partitionId() * FILES_PER_TASK
        encoder, number = worker_encoder(vocabulary), 0
        rows = ((doc_id, ids) for batch in batches for doc_id, ids in zip(
            batch.column(0).to_pylist(), encoder.encode_all(batch.column(1).to_pylist())))
        row = next(rows, None)
        while row is not None:
            files.create_dir(root, recursive=True)
            draft = f"{root}/.{first + number:012d}-{uuid.uuid4().hex}"
            try:
                with files.open_output_stream(draft) as sink:
                    writer, written = PlaneWriter(sink, planes, block), 0
                    while row is not None and written < file_ids:
                        writer.add(row[0], row[1] + end)
                        written += len(row[1]) // 4 + 1
                        row = next(rows, None)
                    n_docs, n_ids = writer.close()
                files.move(draft, f"{root}/{first + number:012d}.planes")
            except BaseException:
                with suppress(OSError):
                    files.delete_file(draft)
                raise
            yield pa.RecordBatch.from_pydict({
                "file": pa.array([first + number], pa.int64()), "n_docs": pa.array([n_docs], pa.int64()),
                "n_ids": pa.array([n_ids], pa.int64()),
            })
            number += 1

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return staged(ordered.mapInArrow(compute, "file long, n_docs long, n_ids long"), "plane_files")


def read_token_files(spark, folder: str) -> DataFrame:
    """(file, place, doc_id, start in the file, n_tokens, ids_crc32) from the files themselves."""

    def compute(batches):
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                number = int(path.rsplit("/", 1)[-1].split(".")[0])
                rows, start = [], 0
                for place, (doc_id, ids) in enumerate(PlaneFile(data.as_py()).documents()):
                    rows.append((number, place, doc_id, start, len(ids) // 4, zlib.crc32(ids)))
                    start += len(ids) // 4
                kinds = [pa.int64()] * 6
                names = ["file", "place", "doc_id", "start", "n_tokens", "ids_crc32"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.planes").load(folder)
    return files.select("path", "content").mapInArrow(
        compute, "file long, place long, doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def token_file_index(
    docs: DataFrame, vocabulary: str, planes: str = "byte", block: int = 1 << 16, file_ids: int = FILE_IDS
) -> DataFrame:
    """Writes the token files of `docs` to the shared folder and reads every document's entry back.

    Null and empty texts are the end id alone; an empty table writes no file. Only doc_id and text
    are read.
    """
    spark = docs.sparkSession
    folder = staging_path(spark, "token_planes")
    written = write_token_files(docs, vocabulary, folder, planes, block, file_ids)
    if written.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    offsets = written.select("file", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)).alias("before"))
    return read_token_files(spark, folder).join(offsets, "file").select(
        "doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"
    )

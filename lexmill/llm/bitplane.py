"""Token ids in bit-plane shuffled shards.

A shard is one byte string: a header, a table of its documents, a chunk index, and chunks. A chunk is a block of
``BLOCK`` ids, transposed so that equal bytes (or bits) of all its ids lie together, each plane compressed with
zstandard; a plane of zeros takes no bytes. The index has the length of every plane, so a range of ids is
read by decompressing only the chunks that hold it.

Layout, little-endian:
    magic "LXBP", version u8, mode u8 (1 byte planes, 2 bit planes), block u32, ids u64, documents u32, crc32 u32
    document table: length u32, then zstandard of doc_id i64 each, present u8 each, number of ids u32 each
    chunk index: length of each plane u32, chunk by chunk
    planes

The writer ranges documents by doc_id, so shards in order of (range, part) hold the ids in ascending doc_id order.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import staged

MAGIC, VERSION = b"LXBP", 1
MODES = {"byte": 1, "bit": 2}
BLOCK = 1 << 16
#: Ids after which a shard is closed. A document is never split over shards.
SHARD_IDS = 1 << 20
_HEAD = struct.Struct("<4sBBIQII")


def _planes(ids: np.ndarray, mode: int) -> np.ndarray:
    """The planes of a block, one row each."""
    rows = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if mode == 1:
        return np.ascontiguousarray(rows.T)
    return np.packbits(np.unpackbits(rows, axis=1, bitorder="little").T, axis=1, bitorder="little")


def _joined(planes: np.ndarray, mode: int, count: int) -> np.ndarray:
    if mode == 2:
        planes = np.packbits(np.unpackbits(planes, axis=1, count=count, bitorder="little").T, axis=1, bitorder="little").T
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def encode_shard(doc_ids: list, lengths: list[int], ids: np.ndarray, mode: str = "byte", block: int = BLOCK, level: int = 3) -> bytes:
    """One shard of whole documents: their ids one after another, ``lengths`` each."""
    kind, squeeze = MODES[mode], zstandard.ZstdCompressor(level=level).compress
    index, body = [], []
    for s in range(0, len(ids), block):
        for plane in _planes(ids[s : s + block], kind):
            packed = squeeze(plane.tobytes()) if plane.any() else b""
            index.append(len(packed))
            body.append(packed)
    present = np.array([d is not None for d in doc_ids], dtype=np.uint8)
    table = squeeze(np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes() + present.tobytes() + np.array(lengths, dtype="<u4").tobytes())
    rest = struct.pack("<I", len(table)) + table + np.array(index, dtype="<u4").tobytes() + b"".join(body)
    return _HEAD.pack(MAGIC, VERSION, kind, block, len(ids), len(doc_ids), zlib.crc32(rest)) + rest


class Shard:
    """A shard opened for reading: ``documents`` (doc_id, start, length) and ``read(start, stop)`` of its ids."""

    def __init__(self, data: bytes, verify: bool = True):
        magic, version, self.mode, self.block, self.count, docs, crc = _HEAD.unpack_from(data)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a bit-plane shard")
        if verify and zlib.crc32(memoryview(data)[_HEAD.size :]) != crc:
            raise ValueError("the shard's checksum differs")
        self.data, self.expand = data, zstandard.ZstdDecompressor().decompress
        (size,) = struct.unpack_from("<I", data, _HEAD.size)
        at = _HEAD.size + 4
        table = self.expand(data[at : at + size]) if docs else b""
        ids = np.frombuffer(table, dtype="<i8", count=docs)
        present = np.frombuffer(table, dtype=np.uint8, count=docs, offset=8 * docs)
        lengths = np.frombuffer(table, dtype="<u4", count=docs, offset=9 * docs).astype(np.int64)
        starts = np.cumsum(lengths) - lengths
        self.documents = [(int(d) if p else None, int(s), int(n)) for d, p, s, n in zip(ids, present, starts, lengths, strict=True)]
        self.planes = 4 if self.mode == 1 else 32
        chunks = -(-self.count // self.block)
        at += size
        self.lengths = np.frombuffer(data, dtype="<u4", count=chunks * self.planes, offset=at).astype(np.int64)
        self.offsets = at + 4 * len(self.lengths) + np.cumsum(self.lengths) - self.lengths

    def chunk(self, k: int) -> np.ndarray:
        count = min(self.block, self.count - k * self.block)
        width = count if self.mode == 1 else -(-count // 8)
        planes = np.zeros((self.planes, width), dtype=np.uint8)
        for p in range(self.planes):
            at, size = self.offsets[k * self.planes + p], self.lengths[k * self.planes + p]
            if size:
                planes[p] = np.frombuffer(self.expand(self.data[at : at + size]), dtype=np.uint8)
        return _joined(planes, self.mode, count)

    def read(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        stop = self.count if stop is None else min(stop, self.count)
        if start >= stop:
            return np.zeros(0, dtype="<u4")
        first, last = start // self.block, (stop - 1) // self.block
        ids = np.concatenate([self.chunk(k) for k in range(first, last + 1)])
        return ids[start - first * self.block : stop - first * self.block]


def _encode(path: str, end_id: int, mode: str, shard_ids: int):
    def run(batches):
        from pyspark import TaskContext

        from lexmill.llm.tokenize import loaded

        of, end = loaded(path), np.array([end_id], dtype="<u4")
        place, part = TaskContext.get().partitionId(), 0
        docs, lengths, held, count = [], [], [], 0

        def shard():
            ids = np.concatenate(held)
            return pa.RecordBatch.from_pydict({"place": pa.array([place], pa.int32()), "part": pa.array([part], pa.int32()), "n_docs": pa.array([len(docs)], pa.int64()), "n_ids": pa.array([count], pa.int64()), "shard": pa.array([encode_shard(docs, lengths, ids, mode)], pa.binary())})

        for b in batches:
            places = iter(b.column(0).to_pylist())
            for ids, sizes in of.batches(b.column(1)):
                for at, size in zip((np.cumsum(sizes) - sizes).tolist(), sizes.tolist(), strict=True):
                    docs.append(next(places))
                    lengths.append(size + 1)
                    held += (ids[at : at + size], end)
                    count += size + 1
                    if count >= shard_ids:
                        yield shard()
                        docs, lengths, held, count, part = [], [], [], 0, part + 1
        if docs:
            yield shard()
        # a worker is used again; what Arrow keeps for later would add up with what the next stage needs
        pa.default_memory_pool().release_unused()

    return run


def write_shards(docs: DataFrame, tokenizer: str, end_id: int = 0, mode: str = "byte", shard_ids: int = SHARD_IDS) -> DataFrame:
    """place, part, n_docs, n_ids, shard: the shards of all documents, staged in the shared folder.

    ``tokenizer`` is a vocabulary file that every executor has. Documents are ranged and sorted by doc_id (null
    first), then by a hash of the text and their place in the input, so that rows of one doc_id, be they a third of the
    table, still spread over ranges; encoded whole, and closed into shards. (place, part) orders the shards.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.select("doc_id", "text", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("row"))
    ranged = rows.repartitionByRange("doc_id", "tie", "row").sortWithinPartitions("doc_id", "tie", "row")
    return staged(ranged.select("doc_id", "text").mapInArrow(_encode(tokenizer, end_id, mode, shard_ids), "place int, part int, n_docs long, n_ids long, shard binary"), "shards")


def _decode(batches):
    for b in batches:
        for place, part, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            shard = Shard(data.as_py())
            ids = memoryview(shard.read().astype("<u4").tobytes())
            out = [(d, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])) for d, s, n in shard.documents]
            found, starts, lengths, crcs = zip(*out, strict=True)
            yield pa.RecordBatch.from_pydict({"place": pa.array([place] * len(out), pa.int32()), "part": pa.array([part] * len(out), pa.int32()), "doc_id": pa.array(found, pa.int64()), "local": pa.array(starts, pa.int64()), "n_tokens": pa.array(lengths, pa.int64()), "ids_crc32": pa.array(crcs, pa.int64())})


def read_shards(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the shards' bytes."""
    before = lambda *by: Window.partitionBy(*by).orderBy("part" if by else "place").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each range of documents, then the shards within a range
    places = shards.groupBy("place").agg(F.sum("n_ids").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before()), F.lit(0))).select("place", "base")
    starts = shards.select("place", "part", "n_ids").withColumn("inner", F.coalesce(F.sum("n_ids").over(before("place")), F.lit(0)))
    starts = starts.join(places, "place").select("place", "part", (F.col("base") + F.col("inner")).alias("first"))
    found = shards.select("place", "part", "shard").mapInArrow(_decode, "place int, part int, doc_id long, local long, n_tokens long, ids_crc32 long")
    return found.join(starts, ["place", "part"]).select("doc_id", (F.col("first") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def encode_and_read(docs: DataFrame, tokenizer: str, end_id: int = 0, mode: str = "byte") -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32: one row per row of ``docs``, read back from the written shards.

    Null or empty text: the end id alone. Null doc_id: first in order. Rows that share a doc_id keep one row
    each, ordered by the text's hash. Other columns are ignored; an empty table gives an empty result.
    """
    return read_shards(write_shards(docs, tokenizer, end_id, mode))

"""Sorted-string-table shards of token ids.

Documents are dealt to shards by ranges of their id, sorted, encoded and written as one file a shard:

    block*  index  bloom  footer

* block: zstd-compressed entries in key order; key and value are length-prefixed, and a key stores only what
  differs from the key before it (prefix compression);
* index: for each block its last key, offset and length (sparse: one entry a block);
* Bloom filter: ten bits a key, seven probes from one 128-bit hash;
* footer (fixed size): offsets of index and filter, counts of entries and ids, width of an id, magic.

A key is 0x00 for a null id, else 0x01 and the id as a big-endian integer with its sign bit flipped, so byte order
is id order with nulls first. A value is the ids, two bytes each where the vocabulary allows it, else four. Rows with
the same id are entries of their own; a lookup returns all of them. Each task writes to a name of its own attempt and
reports it, so a lost or repeated task leaves no wrong file behind. Files stay in the shared folder. An empty table has no
shards and no rows; only id and text are read, whatever other columns are called.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphmill.llm.bpe import coder
from glyphmill.llm.common import SLICE_ROWS, binary_values, file_system, materialise, work_dir
from glyphmill.sources.storage import open_output

MAGIC = b"GMSST001"
FOOTER = struct.Struct(">QQQQQQB7x8s")
#: Bytes of a block before compression, bits of the Bloom filter a key, its probes.
BLOCK, BLOOM_BITS, PROBES = 1 << 18, 10, 7
#: Bytes of text of a shard, on average.
SHARD_BYTES = 24 << 20


def key_of(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else b"\1" + struct.pack(">Q", (doc_id + (1 << 63)) & (2**64 - 1))


def id_of(key: bytes) -> int | None:
    return None if key == b"\0" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int) -> list[int]:
    import xxhash

    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & (2**64 - 1), h >> 64 | 1
    return [(a + i * b) % bits for i in range(PROBES)]


class Writer:
    """Writes entries, given in key order, to an open output stream."""

    def __init__(self, sink, width: int):
        import zstandard

        self.sink, self.width, self.zip = sink, width, zstandard.ZstdCompressor(level=1)
        self.at = self.n = self.ids = 0
        self.block, self.last, self.index, self.keys = bytearray(), b"", [], []

    def add(self, key: bytes, value: bytes, n_ids: int) -> None:
        shared = 0
        if self.block:
            most = min(len(key), len(self.last))
            while shared < most and key[shared] == self.last[shared]:
                shared += 1
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last = key
        self.keys.append(key)
        self.n += 1
        self.ids += n_ids
        if len(self.block) >= BLOCK:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            data = self.zip.compress(bytes(self.block))
            self.sink.write(data)
            self.index.append((self.last, self.at, len(data)))
            self.at += len(data)
            self.block = bytearray()

    def close(self) -> None:
        self._flush()
        index = b"".join(_varint(len(k)) + k + _varint(o) + _varint(n) for k, o, n in self.index)
        bits = max(64, BLOOM_BITS * self.n)
        bloom = np.zeros((bits + 7) // 8, np.uint8)
        for k in self.keys:
            for p in _probes(k, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        self.sink.write(index + bloom.tobytes() + FOOTER.pack(self.at, len(index), bits, len(bloom), self.n, self.ids, self.width, MAGIC))
        self.sink.close()


class Reader:
    """Scans a shard or looks keys up by binary search in its block index."""

    def __init__(self, uri: str):
        import zstandard

        system, path = file_system(uri)
        self.source = system.open_input_file(path)
        end = self.source.size()
        if end < FOOTER.size:
            raise ValueError(f"{uri}: too short for a shard")
        index_at, index_n, self.bits, bloom_n, self.n, self.ids, self.width, magic = FOOTER.unpack(self.source.read_at(FOOTER.size, end - FOOTER.size))
        if magic != MAGIC or index_at + index_n + bloom_n + FOOTER.size != end:
            raise ValueError(f"{uri}: not a shard, or cut short")
        self.unzip = zstandard.ZstdDecompressor()
        data, at, self.index = self.source.read_at(index_n, index_at), 0, []
        while at < index_n:
            k, at = _read_varint(data, at)
            key, at = data[at : at + k], at + k
            offset, at = _read_varint(data, at)
            length, at = _read_varint(data, at)
            self.index.append((key, offset, length))
        self.bloom = self.source.read_at(bloom_n, index_at + index_n)
        self.dtype = np.dtype("<u2" if self.width == 2 else "<u4")

    def _block(self, i: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, offset, length = self.index[i]
        data, at, key = self.unzip.decompress(self.source.read_at(length, offset)), 0, b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            rest, at = _read_varint(data, at)
            n, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield key, np.frombuffer(data, self.dtype, n // self.width, at)
            at += n

    def scan(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for i in range(len(self.index)):
            for key, ids in self._block(i):
                yield id_of(key), ids

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        key = key_of(doc_id)
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, self.bits)):
            return []
        out, i = [], bisect_left(self.index, key, key=lambda e: e[0])
        while i < len(self.index):
            seen = [(k, v) for k, v in self._block(i) if k >= key]
            out += [v for k, v in seen if k == key]
            if any(k > key for k, _ in seen):
                break
            i += 1
        return out


def write_shards(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None, special: bool = True) -> DataFrame:
    """Encode every whole text (null: empty), append ``end_id`` and write shards in ascending id order.

    Returns the manifest, a row a shard: shard, uri, n_docs, n_tokens. By default a shard has about ``SHARD_BYTES`` of
    text. One range shuffle of (id, text), in which rows of one id (or none) are dealt by their texts, so they may fill
    several shards, one after the other; a shard streams through its task block by block.
    """
    d = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    spark = d.sparkSession
    folder = work_dir(spark, "sst")
    n = shards or max(1, -(-(d.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SHARD_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ctx = TaskContext.get()
        c = coder(path, special)
        width = 2 if max(max(c.name), end_id) < 1 << 16 else 4
        dtype, writer, name = np.dtype("<u2" if width == 2 else "<u4"), None, f"{folder}/shard-{ctx.partitionId():06d}-{ctx.taskAttemptId()}.sst"
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                part = whole.slice(at, SLICE_ROWS)
                for doc_id, text in zip(part.column(0).to_pylist(), binary_values(part.column(1))):
                    if writer is None:
                        writer = Writer(open_output(name), width)
                    ids = np.frombuffer(b"".join(c.encode_parts(text)), "<u4").astype(dtype)
                    writer.add(key_of(doc_id), ids.tobytes() + dtype.type(end_id).tobytes(), len(ids) + 1)
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pylist([{"shard": ctx.partitionId(), "uri": name, "n_docs": writer.n, "n_tokens": writer.ids}], pa.schema([("shard", pa.int64()), ("uri", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    ranged = d.withColumn("salt", F.xxhash64("text")).repartitionByRange(n, "doc_id", "salt").sortWithinPartitions("doc_id").drop("salt")
    made = ranged.mapInArrow(run, "shard bigint, uri string, n_docs bigint, n_tokens bigint")
    return materialise(made, "sst-manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every entry, from the files."""
    # One small row a shard: the window's single task doesn't grow with the documents.
    placed = manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    spread = placed.repartition(max(1, manifest.count()))  # about a shard a task
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                at, out = row["start"], []
                for doc_id, ids in Reader(row["uri"]).scan():
                    out.append({"doc_id": doc_id, "start": at, "n_tokens": len(ids), "ids_crc32": zlib.crc32(ids.astype("<u4").tobytes())})
                    at += len(ids)
                    if len(out) >= 10_000:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out = []
                yield pa.RecordBatch.from_pylist(out, schema)

    return spread.select("uri", "start").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def lookup(manifest: DataFrame, wanted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Ids of the wanted documents (doc_id, ids) by Bloom filter and binary search; ``wanted`` is a bounded query set.

    Each shard's file is opened once; ``wanted`` is collected after its size is checked (100,000 ids at most).
    """
    ids = [r[0] for r in wanted.select(id_col).distinct().limit(100_001).collect()]
    if len(ids) > 100_000:
        raise ValueError("more than 100,000 ids: join with read_shards instead")
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                r = Reader(uri)
                for i in ids:
                    if found := r.get(i):
                        yield pa.RecordBatch.from_pylist([{"doc_id": i, "ids": x.astype(np.int64).tolist()} for x in found], schema)

    return manifest.select("uri").mapInArrow(run, "doc_id bigint, ids array<bigint>")


def shard_digests(docs: DataFrame, path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return read_shards(write_shards(docs, path, end_id, id_col, text_col))

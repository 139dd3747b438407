"""Binary model files and their text companions.

Parquet is the working format of all models; these files are for exchange. All integers are big-endian. A finished model is
small (a vocabulary) or written row by row from a sorted iterator, so the driver never holds a model; files are read by
Spark's ``binaryFile`` source.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphmill.functions import codec
from glyphmill.sources.storage import cut, file_system, open_output

#: The header's magic and the types of file.
MAGIC, DICTIONARY, VOCABULARY, NGRAM = 0x564C4D31, 1, 2, 3
SLOTS = 255


def _header(kind: int) -> bytes:
    return struct.pack(">ii", MAGIC, kind)


def _check(data: bytes, kind: int, name: str) -> bytes:
    if len(data) < 8 or struct.unpack(">ii", data[:8]) != (MAGIC, kind):
        raise ValueError(f"{name}: not a model file of type {kind}")
    return data[8:]


def packed_length(tokens: int) -> int:
    """Bytes of a word of so many tokens."""
    return -(-tokens * 6 // 8)


def pack_word(token_text: str) -> bytes:
    """Four tokens in three bytes, the last byte padded with zero bits."""
    n = 0
    for c in token_text:
        n = n << 6 | codec.ALPHABET.index(c)
    size = packed_length(len(token_text))
    return (n << (size * 8 - len(token_text) * 6)).to_bytes(size, "big")


def unpack_word(data: bytes, tokens: int) -> str:
    n = int.from_bytes(data, "big") >> (len(data) * 8 - tokens * 6)
    return "".join(codec.ALPHABET[n >> 6 * (tokens - 1 - i) & 63] for i in range(tokens))


def _int32(n: int, what: str) -> int:
    if n >= 1 << 31:
        raise ValueError(f"{what}: {n} doesn't fit the file's 32 bits")
    return n


def write_dictionary(dic: DataFrame, path: str) -> None:
    """``path`` (lengths, then packed words, in token order) and ``path``.txt with a word a line.

    The words are sorted and packed once, into the shared folder, a piece a row; the pieces stream from there twice. More than 2**31 bytes are an error.
    """
    count, size = dic.agg(F.count("*"), F.coalesce(F.sum(F.ceil(F.length("tt") * 6 / 8)), F.lit(0))).first()
    header = _header(DICTIONARY) + struct.pack(">ii", _int32(count, "words"), _int32(int(size), "bytes"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tts = batch.column(0).to_pylist()
            lengths = np.array([len(t) for t in tts], ">i4").tobytes()
            parts = lengths, b"".join(map(pack_word, tts)), "".join(w + "\n" for w in batch.column(1).to_pylist()).encode()
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in parts], names=["lengths", "words", "text"])

    ordered = dic.select("idx", codec.validated(F.col("tt")).alias("tt"), "word").orderBy("idx").select("tt", "word")
    packed = cut(ordered.mapInArrow(pack, "lengths binary, words binary, text binary"))
    with open_output(path) as f, open_output(path + ".txt") as text:
        f.write(header)
        for r in packed.select("lengths").toLocalIterator(True):
            f.write(bytes(r[0]))
        for r in packed.select("words", "text").toLocalIterator(True):
            f.write(bytes(r[0]))
            text.write(bytes(r[1]))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value) of a text file, from 1. Its blocks are read apart; a line's number is its place in the block and the lines before."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("k"))
    sizes = rows.groupBy("block").agg(F.count("*").alias("n"))  # a row for each block
    before = sizes.select("block", F.coalesce(F.sum("n").over(W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    line = F.col("before") + F.row_number().over(W.partitionBy("block").orderBy("k"))
    return rows.join(F.broadcast(before), "block").select(line.cast("bigint").alias("line"), "value")


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(idx, tt, word, length); wrong sizes and words out of order are errors."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                body = _check(data, DICTIONARY, name)
                count, size = struct.unpack(">ii", body[:8])
                if count < 0 or len(body) != 8 + 4 * count + size:
                    raise ValueError(f"{name}: wrong size")
                lengths = np.frombuffer(body, ">i4", count, 8).tolist()
                at, out, last = 8 + 4 * count, [], ""
                for i, n in enumerate(lengths):
                    end = at + packed_length(n)
                    word = unpack_word(body[at:end], n)
                    if n < 1 or word <= last:
                        raise ValueError(f"{name}: word {i} is out of order")
                    out.append((i, word))
                    at, last = end, word
                if at != len(body):
                    raise ValueError(f"{name}: wrong size")
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in out], pa.int64()), pa.array([w for _, w in out], pa.string())], names=["idx", "tt"])

    rows = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(parse, "idx bigint, tt string")
    return rows.select("idx", "tt", codec.decode(F.col("tt")).alias("word"), F.length("tt").cast("int").alias("length"))


def write_vocabulary(entries: tuple[tuple[int, str], ...], path: str) -> None:
    """255 packed sequences (0 where there is none) and a companion with a readable line for each."""
    slots = [0] * SLOTS
    for token, seq in entries:
        slots[token] = codec.pack_value(seq)
    plain = str.maketrans(codec.DECODE_FROM, codec.DECODED)
    with open_output(path) as f, open_output(path + ".txt") as text:
        f.write(_header(VOCABULARY) + struct.pack(f">{SLOTS}q", *slots))
        text.write("".join(f'Vocab[{i}] = {v} // "{codec.pack_rows(v).translate(plain)}"\n' for i, v in enumerate(slots)).encode())


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(token, seq, packed) of the filled slots."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                body = _check(data, VOCABULARY, name)
                if len(body) != 8 * SLOTS:
                    raise ValueError(f"{name}: wrong size")
                rows = [(i, codec.pack_rows(v), v) for i, v in enumerate(struct.unpack(f">{SLOTS}q", body)) if v]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], names=["token", "seq", "packed"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(parse, "token int, seq string, packed bigint")


def write_ngrams(model: DataFrame, path: str) -> None:
    """Six bytes an entry, by key: signed key, then the second and the first token (255: none)."""
    signed = F.when(F.col("ctx") >= 2**31, F.col("ctx") - 2**32).otherwise(F.col("ctx"))
    entry = np.dtype([("k", ">i4"), ("second", "u1"), ("first", "u1")])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            e = np.empty(batch.num_rows, entry)
            for i, name in enumerate(("k", "first", "second")):
                e[name] = batch.column(i).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array([e.tobytes()], pa.binary())], names=["entries"])

    rows = model.select(signed.alias("k"), "first", F.coalesce("second", F.lit(255)).alias("second")).orderBy("k")
    packed = cut(rows.mapInArrow(pack, "entries binary"))
    with open_output(path) as f:
        f.write(_header(NGRAM))
        for r in packed.toLocalIterator(True):
            f.write(bytes(r[0]))


#: Entries that are read together from a file of n-grams.
PIECE = 1 << 20


def read_ngrams(spark: SparkSession, path: str) -> DataFrame:
    """(ctx, first, second). Pieces of a file are read apart, so it may be larger than a value of Spark's can be."""
    entry = np.dtype([("k", ">u4"), ("second", "u1"), ("first", "u1")])
    fields = "ctx bigint, first int, second int"

    def rows(e: np.ndarray) -> Iterator[pa.RecordBatch]:
        second = pa.array(e["second"].astype(np.int32), mask=e["second"] == 255)
        yield pa.RecordBatch.from_arrays([pa.array(e["k"].astype(np.int64)), pa.array(e["first"].astype(np.int32)), second], names=["ctx", "first", "second"])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                body = _check(data, NGRAM, name)
                if len(body) % 6:
                    raise ValueError(f"{name}: wrong size")
                yield from rows(np.frombuffer(body, entry))

    def parse_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, length, at, n in zip(*(c.to_pylist() for c in batch.columns)):
                system, own = file_system(name)
                with system.open_input_file(own) as f:
                    _check(f.read(8), NGRAM, name)
                    if (length - 8) % 6:
                        raise ValueError(f"{name}: wrong size")
                    f.seek(8 + 6 * at)
                    e = np.frombuffer(f.read(6 * n), entry)
                for i in range(0, len(e), 1 << 16):
                    yield from rows(e[i : i + (1 << 16)])

    files = spark.read.format("binaryFile").load(path)
    found = files.select("path", "length").collect()
    try:
        for r in found:
            file_system(r["path"])
    except (ValueError, pa.ArrowException):  # a store that only Spark opens
        return files.select("path", "content").mapInArrow(parse, fields)
    pieces = [(r["path"], r["length"], at, PIECE) for r in found for at in range(0, max(1, (r["length"] - 8) // 6), PIECE)]
    return spark.createDataFrame(pieces, "path string, length bigint, at bigint, n bigint").repartition(len(pieces) or 1).mapInArrow(parse_pieces, fields)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of all files below a folder; text that isn't UTF-8 is an error."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    return raw.select("path", F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).otherwise(F.raise_error(F.concat(F.lit("not UTF-8: "), F.col("path")))).alias("text"))

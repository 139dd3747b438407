"""Substring deduplication behind a count-min prefilter.

A window is ``WINDOW`` consecutive words of one document. A word goes if a window covers it whose word sequence also
starts in a document with a smaller id; windows are judged on the input, not on what is left.

Documents are dealt to groups by their hashed ids. Then, with messages between groups and slices of the hash range
instead of one row a window:

1. each group sketches its windows in a count-min sketch of ``DEPTH`` rows of about
   ``WIDTH`` slots a window, and sends each slice its non-zero slots, delta-coded (about a byte a window and row);
2. a slice adds the groups' sketches and sends back to each group which of its slots reached two;
3. windows all of whose slots reached two are possibly repeated. The estimate never falls short of the count, so none
   that repeats is lost. Groups send these only, as 64-bit fingerprints with the least id that holds them; a slice
   takes the least id of all groups and sends it back with each fingerprint that a later document of the group holds;
4. each group then knows for each of its windows whether an earlier document holds it, and removes the words.

All state of a task is that of one group or one slice; both counts grow with the corpus (``GROUP_CHARS``). No row is
dropped, and frequent windows, passages or copies weigh once a group. Fingerprints stand for word sequences (equal by
chance 2**-64).

Null text has no words: nothing is kept or removed. Rows with the same id are one document for the comparison (neither
is smaller); each row is reported by itself. A null id is larger than every other id. Fewer words than a window: kept whole.
An empty table gives an empty table; only id and text are read, whatever other columns are called. A long text is one
unit of a group and costs in proportion to its length.
"""

from __future__ import annotations

import hashlib
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import binary_values
from glyphmill.llm.words import mix, window_hashes, word_hashes

WINDOW, DEPTH, WIDTH = 13, 2, 4
#: Characters of a group's documents, on average.
GROUP_CHARS = 8_000_000
#: Stands for a null id in comparisons.
NO_ID = np.iinfo(np.int64).max
_SEEDS = (np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F))


def pack(sorted_values: np.ndarray) -> bytes:
    """Sorted unsigned integers as zstd-compressed byte planes of their differences."""
    import zstandard

    if len(sorted_values) == 0:
        return b""
    d = np.diff(sorted_values.astype(np.uint64), prepend=np.uint64(0))
    planes = d.astype("<u8").view(np.uint8).reshape(-1, 8).T
    used = max((i + 1 for i in range(8) if planes[i].any()), default=1)
    return bytes([used]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes[:used]).tobytes())


def unpack(data: bytes) -> np.ndarray:
    import zstandard

    if not data:
        return np.zeros(0, np.uint64)
    used, raw = data[0], np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8)
    planes = raw.reshape(used, -1)
    d = np.zeros((planes.shape[1], 8), np.uint8)
    d[:, :used] = planes.T
    return np.cumsum(d.view("<u8").ravel(), dtype=np.uint64)


def _zip(ids: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(ids.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes())


def _unzip(data: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<i8").ravel()


def _inside(x: np.ndarray, sorted_values: np.ndarray) -> np.ndarray:
    """Whether each x is in a sorted array."""
    if len(sorted_values) == 0:
        return np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)
    return sorted_values[at] == x


def slots(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    """Slots of fingerprints in a row of the sketch of 2**bits slots."""
    return mix(h ^ _SEEDS[row]) >> np.uint64(64 - bits)


def _by_slice(sorted_values: np.ndarray, shift: int, n_slices: int) -> list[tuple[int, int, int]]:
    """(slice, from, to) of the runs of a sorted array whose top bits tell the slice."""
    edges = np.searchsorted(sorted_values, np.arange(1, n_slices, dtype=np.uint64) << np.uint64(shift))
    edges = [0, *edges.tolist(), len(sorted_values)]
    return [(s, a, b) for s, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]


class Members:
    """Membership in a sorted array: a table of low bits turns most strangers away before the binary search."""

    BITS = 22

    def __init__(self, sorted_values: np.ndarray):
        self.values = sorted_values
        self.mask = np.uint64((1 << self.BITS) - 1)
        self.table = np.zeros(1 << self.BITS, bool)
        self.table[sorted_values & self.mask] = True

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in x, places in the array) of the x that are in it."""
        if len(self.values) == 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.table[x & self.mask])
        to = np.minimum(np.searchsorted(self.values, x[at]), len(self.values) - 1)
        ok = self.values[to] == x[at]
        return at[ok], to[ok]


class Group:
    """Documents of one group: ids, words and fingerprints of windows."""

    def __init__(self, ids: list[int | None], texts: list[bytes | None], window: int):
        self.raw_ids, self.window = ids, window
        self.words: list[bytes] = []
        n = []
        for t in texts:
            w = t.split() if t else []
            self.words += w
            n.append(len(w))
        self.n = np.array(n, np.int64)
        self.ends = np.cumsum(self.n)
        own = np.array([NO_ID if i is None else i for i in ids], np.int64)
        per_doc = np.maximum(self.n - window + 1, 0)
        #: Window k starts at word ``at[k]`` and belongs to document id ``owner[k]``.
        self.owner = np.repeat(own, per_doc)
        first = np.repeat(self.ends - self.n, per_doc)
        self.at = first + np.arange(len(first)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
        h = window_hashes(word_hashes(self.words), window) if len(self.words) >= window else np.zeros(0, np.uint64)
        self.h = h[self.at] if len(self.at) else np.zeros(0, np.uint64)


def _groups(docs: DataFrame, id_col: str, text_col: str, group_chars: int) -> tuple[DataFrame, int, int]:
    """(g, id, text) for all documents, the number of groups, and the bits of the sketch's rows."""
    d = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    chars = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-chars // group_chars))
    bits = max(10, int(np.ceil(np.log2(max(1, WIDTH * chars / 6)))))
    # Rows without id need not meet: they are dealt by their texts.
    g = F.pmod(F.when(F.col("id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("id", F.lit(9))), F.lit(n)).cast("int")
    return d.select(g.alias("g"), "id", "text"), n, bits


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table({f.name: pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)}, schema=schema)


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, group_chars: int = GROUP_CHARS, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row, and with ``with_text`` the kept words joined by spaces."""
    grouped, n_groups, bits = _groups(docs, id_col, text_col, group_chars)
    spark = docs.sparkSession
    n_slices = 1 << max(0, int(np.ceil(np.log2(n_groups / 4))))  # a slice gathers about what four groups hold
    top = n_slices.bit_length() - 1
    parts = max(n_groups // 2, spark.sparkContext.defaultParallelism)
    grouped = grouped.repartition(parts, "g")
    sent = pa.schema([("row", pa.int32()), ("slice", pa.int32()), ("g", pa.int32()), ("data", pa.binary())])
    ddl = "row int, slice int, g int, data binary"

    def group_of(t: pa.Table) -> Group:
        return Group(t.column("id").to_pylist(), binary_values(t.column("text")), window)

    def sketch(t: pa.Table) -> pa.Table:
        if t.num_rows == 0:
            return sent.empty_table()
        h, g, out = group_of(t).h, t.column("g")[0].as_py(), []
        for row in range(DEPTH):
            # A slot counts twice where two windows of the group meet in it; two of one document may, which only overestimates.
            s = np.sort(slots(h, row, bits))
            first = np.r_[True, s[1:] != s[:-1]] if len(s) else np.zeros(0, bool)
            double = np.unique(s[~first])
            s = s[first]
            for part, values in ((row, s), (row + DEPTH, double)):
                for k, a, b in _by_slice(values, bits - top, n_slices):
                    out.append((part, k, g, pack(values[a:b] - np.uint64(k << (bits - top)))))
        return _table(out, sent)

    def add_up(t: pa.Table) -> pa.Table:
        """One slice of one row: the groups' slots, added."""
        rows, gs, data = t.column("row").to_pylist(), t.column("g").to_pylist(), t.column("data").to_pylist()
        row, k = min(rows), t.column("slice")[0].as_py()
        row = row % DEPTH
        mine = [(g, unpack(x)) for r, g, x in zip(rows, gs, data) if r < DEPTH]
        again = [unpack(x) for r, x in zip(rows, data) if r >= DEPTH]
        s = np.sort(np.concatenate([x for _, x in mine] + again))
        reached = np.unique(s[1:][s[1:] == s[:-1]])
        out = []
        for g, x in mine:
            hit = x[_inside(x, reached)]
            if len(hit):
                out.append((row, k, g, pack(hit)))
        return _table(out, sent)

    def suspects(h: np.ndarray, answers: pa.Table) -> np.ndarray:
        """Places of the windows all of whose slots reached two."""
        at = np.arange(len(h))
        rows, ks, data = (answers.column(c).to_pylist() for c in ("row", "slice", "data"))
        for row in range(DEPTH):
            got = [unpack(x) + np.uint64(k << (bits - top)) for r, k, x in sorted(zip(rows, ks, data), key=lambda v: v[:2]) if r == row]
            hit, _ = Members(np.concatenate(got) if got else np.zeros(0, np.uint64)).find(slots(h[at], row, bits))
            at = at[hit]
        return at

    asked = pa.schema([("slice", pa.int32()), ("g", pa.int32()), ("keys", pa.binary()), ("ids", pa.binary()), ("twice", pa.binary())])

    def ask(t: pa.Table, answers: pa.Table) -> pa.Table:
        """Suspect fingerprints with the least id of the group that holds each, and whether another id does."""
        if t.num_rows == 0:
            return asked.empty_table()
        group, g = group_of(t), t.column("g")[0].as_py()
        at = suspects(group.h, answers)
        h, owner = group.h[at], group.owner[at]
        order = np.argsort(h, kind="stable")
        h, owner = h[order], owner[order]
        if len(h) == 0:
            return asked.empty_table()
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        least, most = np.minimum.reduceat(owner, first), np.maximum.reduceat(owner, first)
        keys, twice = h[first], least != most
        return _table([(k, g, pack(keys[a:b]), _zip(least[a:b]), np.packbits(twice[a:b]).tobytes()) for k, a, b in _by_slice(keys, 64 - top, n_slices)], asked)

    told = pa.schema([("g", pa.int32()), ("slice", pa.int32()), ("keys", pa.binary()), ("ids", pa.binary())])

    def answer(t: pa.Table) -> pa.Table:
        """To each group its fingerprints that some later document of it holds, with the least id of all groups."""
        k, mine = t.column("slice")[0].as_py(), []
        for g, keys, ids, twice in zip(*(t.column(c).to_pylist() for c in ("g", "keys", "ids", "twice"))):
            x = unpack(keys)
            mine.append((g, x, _unzip(ids), np.unpackbits(np.frombuffer(twice, np.uint8), count=len(x)).astype(bool)))
        h, ids = np.concatenate([x[1] for x in mine]), np.concatenate([x[2] for x in mine])
        order = np.argsort(h, kind="stable")
        h, ids = h[order], ids[order]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        keys, least = h[first], np.minimum.reduceat(ids, first)
        out = []
        for g, x, own, twice in mine:
            all_least = least[np.searchsorted(keys, x)]
            hit = twice | (all_least < own)
            if hit.any():
                out.append((g, k, pack(x[hit]), _zip(all_least[hit])))
        return _table(out, told)

    result = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), *([("kept_text", pa.string())] if with_text else [])])

    def finish(t: pa.Table, earlier: pa.Table) -> pa.Table:
        if t.num_rows == 0:
            return result.empty_table()
        group = group_of(t)
        told_rows = sorted(zip(earlier.column("slice").to_pylist(), earlier.column("keys").to_pylist(), earlier.column("ids").to_pylist()))
        drop = np.zeros(len(group.words) + 1, np.int64)
        if told_rows:
            keys, least = np.concatenate([unpack(x[1]) for x in told_rows]), np.concatenate([_unzip(x[2]) for x in told_rows])
            at, to = Members(keys).find(group.h)
            gone = group.at[at[least[to] < group.owner[at]]]
            np.add.at(drop, gone, 1)
            np.add.at(drop, gone + window, -1)
        out, rows, start = np.cumsum(drop[:-1]) > 0, [], 0
        for i, end in zip(group.raw_ids, group.ends.tolist()):
            words, mark = group.words[start:end], out[start:end]
            kept = [w for w, o in zip(words, mark.tolist()) if not o] if mark.any() else words
            text = b" ".join(kept)
            rows.append((i, len(words), len(words) - len(kept), hashlib.sha256(text).hexdigest(), *([text.decode("utf-8")] if with_text else [])))
            start = end
        return _table(rows, result)

    # One plan: the shuffle of the texts is made once and reused by all three passes.
    by_group = grouped.groupBy("g")
    sketches = by_group.applyInArrow(sketch, ddl)
    reached = sketches.withColumn("sketch_row", F.col("row") % DEPTH).groupBy("sketch_row", "slice").applyInArrow(add_up, ddl)
    asks = by_group.cogroup(reached.groupBy("g")).applyInArrow(ask, "slice int, g int, keys binary, ids binary, twice binary")
    held = asks.groupBy("slice").applyInArrow(answer, "g int, slice int, keys binary, ids binary")
    kinds = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + (", kept_text string" if with_text else "")
    return by_group.cogroup(held.groupBy("g")).applyInArrow(finish, kinds)

"""Arrow and NumPy kernels of the learners: token codes of texts, greedy matches, and sums by key.

Sums by key are exact. Tasks sum what they have read, pack the sums of each bucket of keys into one value (sorted keys as
differences, bytes of like weight together, compressed), and what is shuffled are these values. A bucket's task merges them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from glyphmill.functions import codec

#: Characters of the texts that are worked on together, at least one whole text; bounds memory, not work.
SLICE_CHARS = 1 << 20
#: Words that a task sums before it passes them on (a quarter of these), and into how many buckets all keys are dealt.
HELD, BUCKETS = 1 << 22, 2_048
#: Numbers, of all columns, that a task sums before it passes them on.
NUMBERS = 9 << 20
#: Rows of an Arrow batch that goes back to Spark.
OUT_ROWS = 1 << 16

_DROP, _SPACE = 254, 255


def _table(unknown: int) -> np.ndarray:
    """Code of each character below U+FFFF, which stands for all from there on."""
    out = np.full(1 << 16, unknown, np.uint8)
    out[0] = codec.ALPHABET.index(codec.SEPARATOR)
    for c, t in zip(codec.SOURCE, codec.TARGET):
        out[ord(c)] = codec.ALPHABET.index(t)
    return out


_RAW = _table(codec.ALPHABET.index(codec.UNKNOWN))
_STREAM = _table(_DROP)
for _a, _b in ((0x09, 0x0D), (0x1C, 0x20), (0x1680, 0x1680), (0x2000, 0x2006), (0x2008, 0x200A), (0x2028, 0x2029), (0x205F, 0x205F), (0x3000, 0x3000)):
    _STREAM[_a : _b + 1] = _SPACE


def slices(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """Batches of about ``SLICE_CHARS`` bytes of the text column at most, or of one row."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        part, at = np.cumsum(size) // SLICE_CHARS, 0
        for end in [*(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]:
            if end > at:
                yield batch.slice(at, end - at)
            at = end


def _characters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row, and how many each has."""
    values = texts.cast(pa.large_binary()).to_pylist()
    try:
        whole = b"".join(v for v in values if v).decode()
        size = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    except UnicodeDecodeError:
        own = [(v or b"").decode(errors="replace") for v in values]
        whole, size = "".join(own), np.array([len(v) for v in own], np.int64)
    return np.frombuffer(whole.encode("utf-32-le"), np.uint32), size


def raw_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Codes of ``codec.encode_all`` for all texts in a row, and how many each has."""
    points, size = _characters(texts)
    return _RAW[np.minimum(points, 0xFFFF)], size


def stream_codes(texts: pa.Array, single: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Codes of ``codec.stream`` for all texts in a row, and how many each has; with ``single`` runs of separators are one."""
    points, size = _characters(texts)
    framed = size + 2
    first = np.cumsum(framed) - framed
    data = np.full(int(framed.sum()), _SPACE, np.uint8)
    data[np.arange(len(points)) + np.repeat(first + 1 - (np.cumsum(size) - size), size)] = _STREAM[np.minimum(points, 0xFFFF)]
    space = data == _SPACE
    keep = data != _DROP
    again = space[1:] & space[:-1]
    again[first[1:] - 1] = False  # the frame of the next text
    keep[1:] &= ~again
    data[space] = codec.ALPHABET.index(codec.SEPARATOR)
    size = np.add.reduceat(keep, first, dtype=np.int64) if len(first) else size
    data = data[keep]
    if single and len(data):
        first, gap = np.cumsum(size) - size, data == codec.ALPHABET.index(codec.SEPARATOR)
        again = gap[1:] & gap[:-1]
        again[first[1:] - 1] = False
        keep = np.ones(len(data), bool)
        keep[1:] &= ~again
        size, data = np.add.reduceat(keep, first, dtype=np.int64), data[keep]
    return data, size


def windows(data: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sorted codes of the nine characters from each place on, as one number; those after a text's end are null codes.
    The n-grams that begin with the same characters stand in a row, of each length."""
    n = len(data)
    one = np.zeros(n + 8, np.int64)
    one[:n] = data
    two = one[:-1] << 6 | one[1:]
    four = two[:-2] << 12 | two[2:]
    out = (four[:-4] << 24 | four[4:])[:n] << 6 | one[8:]
    ends = np.cumsum(size)
    for k in range(1, 9):
        at = ends[size >= k] - k
        out[at] = out[at] >> 6 * (9 - k) << 6 * (9 - k)
    out.sort()
    return out


_LETTER = np.frombuffer(codec.ALPHABET.encode(), np.uint8)
_BREAKS = np.isin(np.arange(256), [codec.ALPHABET.index(c) for c in (codec.NULL, codec.SEPARATOR, codec.SENTENCE_END)])


def words(data: np.ndarray, size: np.ndarray) -> pa.Array:
    """Token text of the words of all texts in a row, whose codes end with a break each."""
    inside = ~_BREAKS[data]
    ends = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    offsets = np.r_[0, np.cumsum(inside)[ends - 1]].astype(np.int32) if len(data) else np.zeros(1, np.int32)
    return pa.StringArray.from_buffers(len(ends), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(_LETTER[data[inside]])))


def word_sums(df: DataFrame) -> DataFrame:
    """(all columns but the last, tt, cnt): partial counts of the words of the texts, which the last column has."""
    *by, text = df.columns
    own_types = [pa.field(c, t) for c, t in zip(by, _arrow_types(df, tuple(by)))]
    schema = pa.schema([*own_types, pa.field("tt", pa.string()), pa.field("cnt", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[pa.Table]] = {}
        rows = 0

        def give(key: tuple) -> Iterator[pa.RecordBatch]:
            for b in held[key][0].to_batches(max_chunksize=OUT_ROWS):
                yield pa.RecordBatch.from_arrays([*(pa.array([v] * b.num_rows, f.type) for v, f in zip(key, own_types)), b.column("tt"), b.column("cnt")], schema=schema)

        def meet() -> int:
            for key, parts in held.items():
                met = pa.concat_tables(parts).combine_chunks().group_by("tt").aggregate([("cnt", "sum")])
                held[key] = [met.rename_columns({"cnt_sum": "cnt"}).select(["tt", "cnt"])]
            return sum(parts[0].num_rows for parts in held.values())

        for part in slices(batches, len(by)):
            for key, own in by_key(part, len(by)):
                counted = pc.value_counts(words(*stream_codes(own)))
                held.setdefault(key, []).append(pa.table({"tt": counted.field("values"), "cnt": counted.field("counts")}))
                rows += len(counted)
            if rows >= HELD // 4:
                rows = meet()
                if rows >= HELD // 8:
                    for key in held:
                        yield from give(key)
                    held, rows = {}, 0
        meet()
        for key in held:
            yield from give(key)

    kinds = "".join(f"{c} {df.schema[c].dataType.simpleString()}, " for c in by)
    return df.mapInArrow(run, kinds + "tt string, cnt bigint")


def by_key(part: pa.RecordBatch, width: int) -> Iterator[tuple[tuple, pa.Array]]:
    """The column after the first ``width`` ones, by the values of these."""
    if not width:
        yield (), part.column(0)
        return
    groups: dict[tuple, list[int]] = {}
    for i, key in enumerate(zip(*(part.column(k).to_pylist() for k in range(width)))):
        groups.setdefault(key, []).append(i)
    for key, rows in groups.items():
        yield key, part.column(width).take(pa.array(rows))


_SEVEN = np.full(1 << 16, codec.SEVEN_UNKNOWN, np.uint8)
_SEVEN[0x20:0x7F] = np.arange(1, codec.SEVEN_LAST + 1)
_SEVEN[np.flatnonzero(_STREAM == _SPACE)] = 1
_PRINTED = np.full(256, ord("?"), np.uint8)
_PRINTED[1 : codec.SEVEN_LAST + 1] = np.arange(0x20, 0x7F)


def seven_bit(df: DataFrame) -> DataFrame:
    """(key, plain, n, n_unknown, total) of (key, text): a text's tokens of the seven-bit code as characters, their number, those unknown, their sum."""
    key = df.columns[0]
    kinds = f"{key} {df.schema[key].dataType.simpleString()}, plain string, n bigint, n_unknown bigint, total bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            texts = part.column(1)
            points, size = _characters(texts)
            tokens, none = _SEVEN[np.minimum(points, 0xFFFF)], np.asarray(texts.is_null())
            at = np.r_[0, np.cumsum(size)]
            sums_of = lambda x: np.diff(np.r_[0, np.cumsum(x, dtype=np.int64)][at])
            plain = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(at), pa.py_buffer(_PRINTED[tokens])).cast(pa.string())
            columns = [pc.if_else(pa.array(none), pa.scalar(None, pa.string()), plain), *(pa.array(x, mask=none) for x in (size, sums_of(tokens == codec.SEVEN_UNKNOWN), sums_of(tokens)))]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=[key, "plain", "n", "n_unknown", "total"])

    return df.mapInArrow(run, kinds)


#: Characters of a block: blocks are walked side by side.
BLOCK = 256


class Matcher:
    """Greedy longest match of entries (token, token text). What no entry matches is skipped."""

    def __init__(self, entries):
        self.entries = tuple(entries)
        self.longest = max((len(s) for _, s in self.entries), default=1)
        self.ready = False

    def _build(self) -> None:
        """Nodes of a tree of all entries. Each knows the best match so far; a node without a way on leads to the end node of that match."""
        ways, best = [{}], [(0, 0)]
        for token, seq in sorted(self.entries, key=lambda e: len(e[1])):  # so an entry's prefixes are known before it
            at = 0
            for c in map(codec.ALPHABET.index, seq):
                if c not in ways[at]:
                    ways[at][c] = len(ways)
                    ways.append({})
                    best.append(best[at])
                at = ways[at][c]
            best[at] = (token, len(seq))
        ends = {m: len(ways) + i for i, m in enumerate(dict.fromkeys(best))}
        step = np.zeros((len(ways) + len(ends), 64), np.int32)
        for at, own in enumerate(ways):
            step[at] = ends[best[at]]
            for c, n in own.items():
                step[at, c] = n
        for m, n in ends.items():
            step[n] = n
        every = best + list(ends)
        self.step, self.ready = step.ravel() * 64, True  # nodes times 64
        self.token, self.length = np.array([t for t, _ in every], np.int32), np.array([max(1, n) for _, n in every], np.int32)

    def __call__(self, data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all texts in a row, and how many each has."""
        if not self.ready:
            self._build()
        n = len(data)
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(size), np.int64)
        # Texts start at multiples of BLOCK and end with a null code at least, which no entry has.
        blocks = np.where(size > 0, size // BLOCK + 1, 0)
        first = (np.cumsum(blocks) - blocks) * BLOCK
        many = int(blocks.sum())
        place = np.arange(n) + np.repeat(first - (np.cumsum(size) - size), size)
        whole = np.zeros(many * BLOCK + self.longest, np.int32)
        whole[place] = data
        node = self.step[whole[: many * BLOCK]]
        for k in range(1, self.longest):
            node = self.step[node + whole[k : k + many * BLOCK]]
        node >>= 6
        jump = np.ascontiguousarray(self.length[node].reshape(many, BLOCK).T)
        lane = np.arange(many)
        # Where one leaves a block that is entered at each of its places.
        leave = np.zeros((BLOCK + self.longest, many), np.int32)
        leave[BLOCK:] = np.arange(self.longest)[:, None]
        flat = leave.ravel()
        for at in range(BLOCK - 1, -1, -1):
            leave[at] = flat[(jump[at] + at) * many + lane]
        # Long entries may pass over the last block of a text, or over several.
        enter, begin, end = np.zeros(many, np.int64), 0, 0
        ways = leave[: max(1, min(self.longest, BLOCK))].T.tolist()
        starts = set((np.cumsum(blocks) - blocks).tolist())
        for b in range(many):
            begin = 0 if b in starts else end
            enter[b] = begin
            end = ways[b][begin] if begin < len(ways[b]) else (int(leave[begin, b]) if begin < BLOCK else begin - BLOCK)
        on = np.zeros((BLOCK + self.longest, many), bool)
        ok = enter < BLOCK
        on[enter[ok], lane[ok]] = True
        reach = on.ravel()
        for at in range(BLOCK):
            here = np.flatnonzero(on[at])
            reach[(jump[at][here] + at) * many + here] = True
        hit = np.ascontiguousarray(on[:BLOCK].T).ravel()
        found = self.token[node]
        hit &= found > 0
        total = np.add.reduceat(hit, first[size > 0], dtype=np.int64)
        out = np.zeros(len(size), np.int64)
        out[size > 0] = total
        return found[hit], out


# --- Sums by key ------------------------------------------------------------------------------------------------------


#: Standing for no document and no place: later than all.
NEVER = np.iinfo(np.int64).max
#: Documents from 0 to before this one and a place make one number.
DOCUMENTS, _PLACE_BITS = (1 << 32) - 1, 31


def seen(doc: np.ndarray, place: np.ndarray) -> list[np.ndarray]:
    """When keys were seen first: one column that orders as (document, place) where the documents allow it, or else both."""
    never = place == NEVER
    if len(doc) and not ((doc >= 0) & (doc < DOCUMENTS) | never).all():
        return [doc, place]
    return [np.where(never, NEVER, doc << _PLACE_BITS | place & (1 << _PLACE_BITS) - 1)]


def seen_at(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Document and place of ``seen``."""
    if len(columns) == 2:
        return columns[0], columns[1]
    never = columns[0] == NEVER
    return np.where(never, NEVER, columns[0] >> _PLACE_BITS), np.where(never, NEVER, columns[0] & (1 << _PLACE_BITS) - 1)


def _packed(columns: list[np.ndarray]) -> bytes:
    """Sorted distinct keys and what belongs to them: the bytes that each column needs at most, then the columns."""
    parts = [np.diff(columns[0], prepend=0), *columns[1:]]
    need = [8 if p.min() < 0 else (int(p.max()).bit_length() + 7) // 8 for p in parts]
    raw = np.concatenate([np.ascontiguousarray(p).view(np.uint8).reshape(-1, 8).T[:n].ravel() for p, n in zip(parts, need)])
    return bytes([len(need), *need]) + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(value: bytes, rows: int, width: int) -> list[np.ndarray]:
    need = value[1 : 1 + width]
    raw, at, out = np.frombuffer(pa.decompress(value[1 + width :], rows * sum(need), codec="zstd"), np.uint8), 0, []
    for n in need:
        own = np.zeros((rows, 8), np.uint8)
        own[:, :n] = raw[at : at + rows * n].reshape(n, rows).T
        out.append(own.view(np.int64).ravel())
        at += rows * n
    return [np.cumsum(out[0]), *out[1:]]


def merged(columns: list[np.ndarray]) -> list[np.ndarray]:
    """(keys, counts) and possibly ``seen`` with each key once: counts added, the first time it was seen."""
    return _joined([columns])


def _joined(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    """``merged`` of several parts, a column after the other."""
    width = max(map(len, parts))
    parts = [p if len(p) == width else [*p[:2], *seen_at(p[2:])] for p in parts]
    column = lambda i: np.concatenate([p[i] for p in parts]) if len(parts) > 1 else parts[0][i]
    keys = column(0)
    if not len(keys):
        return [column(i) for i in range(width)]
    order = np.argsort(keys)
    keys = keys[order]
    new = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    at = np.flatnonzero(new)
    out = [keys[at]]
    del keys, new
    out.append(np.add.reduceat(column(1)[order], at))
    if width > 2:
        a = column(2)[order]
        out.append(np.minimum.reduceat(a, at))
    if width > 3:
        b = np.where(a == np.repeat(out[2], np.diff(np.r_[at, len(a)])), column(3)[order], NEVER)
        out.append(np.minimum.reduceat(b, at))
    return out


def _bucket(keys: np.ndarray, shift: int, bits: int = 63) -> np.ndarray:
    """Bucket of each key; keys that agree in the ``bits`` bits before their last ``shift`` ones stay together."""
    return ((keys >> shift & (1 << bits) - 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(53)).astype(np.int16) % BUCKETS


def sums(
    df: DataFrame,
    partial: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[tuple, list[np.ndarray]]]],
    shift: int,
    finish: Callable[[list[np.ndarray]], dict[str, pa.Array]],
    fields: str,
    by: tuple[str, ...] = (),
    bits: int = 63,
    spread: Callable[[list[np.ndarray]], Iterator[tuple[list[np.ndarray], bool]]] | None = None,
    follow: Callable[[list[np.ndarray]], list[np.ndarray]] | None = None,
) -> DataFrame:
    """Rows that ``finish`` makes of each bucket's merged columns.

    ``partial`` gives (values of ``by``, columns): columns are int64 arrays, keys (not negative) first, then counts, then
    possibly ``seen``. ``shift``, ``bits``: see ``_bucket``. ``spread`` makes of a task's merged columns those that are passed on, and
    says of each whether ``follow`` has to make others of them in the bucket's task, once they are merged there.
    """
    kinds = "".join(f"{c} {df.schema[c].dataType.simpleString()}, " for c in by)
    own_types = [pa.field(c, t) for c, t in zip(by, _arrow_types(df, by))]
    packed_schema = pa.schema([*own_types, pa.field("bucket", pa.int32()), pa.field("n", pa.int32()), pa.field("sums", pa.binary())])

    def give(key: tuple, columns: list[np.ndarray], more: bool) -> Iterator[pa.RecordBatch]:
        bucket = _bucket(columns[0], shift, bits)
        order = np.argsort(bucket, kind="stable")  # keys stay sorted
        bucket = bucket[order]
        at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        values = [bytes([more]) + _packed([c[order[i:j]] for c in columns]) for i, j in zip(at, np.r_[at[1:], len(bucket)])]
        n = np.diff(np.r_[at, len(bucket)]).astype(np.int32)
        own = [pa.array([v] * len(n), f.type) for v, f in zip(key, own_types)]
        yield pa.RecordBatch.from_arrays([*own, pa.array(bucket[at].astype(np.int32)), pa.array(n), pa.array(values, pa.binary())], schema=packed_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[list[np.ndarray]]] = {}

        def pass_on(key: tuple, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            for own, more in spread(columns) if spread else ((columns, False),):
                yield from give(key, own, more)

        total = 0
        for key, columns in partial(batches):
            held.setdefault(key, []).append(columns)
            total += sum(map(len, columns))
            if total >= NUMBERS:
                total = 0
                for k in list(held):
                    held[k] = [_joined(held[k])]
                    total += sum(map(len, held[k][0]))
                if total >= NUMBERS // 2:
                    for k in list(held):
                        yield from pass_on(k, held.pop(k)[0])
                    total = 0
        for k in list(held):
            one = _joined(held.pop(k))
            if len(one[0]):
                yield from pass_on(k, one)

    def meet(table: pa.Table) -> pa.Table:
        parts, again = [], []
        for n, v in zip(table.column("n").to_pylist(), table.column("sums").to_pylist()):
            (again if v[0] else parts).append(_unpacked(v[1:], n, v[1]))
        if again:
            own = _joined(again)
            parts += [own, follow(own)]
            del again, own
        key = [table.column(c)[0] for c in by]
        made = finish(_joined(parts))
        rows = len(next(iter(made.values())))
        own = {c: pa.array([v.as_py()] * rows, v.type) for c, v in zip(by, key)}
        out = pa.table({**own, **made})
        return pa.Table.from_batches(out.to_batches(max_chunksize=OUT_ROWS), out.schema)

    met = df.mapInArrow(run, f"{kinds}bucket int, n int, sums binary")
    return met.groupBy(*by, "bucket").applyInArrow(meet, kinds + fields)


def _arrow_types(df: DataFrame, columns: tuple[str, ...]) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(df.schema[c].dataType) for c in columns]


def lists(values: np.ndarray, size: np.ndarray) -> pa.Array:
    """An array column: so many of the values for each row, in a row."""
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.array(values.astype(np.int32)))

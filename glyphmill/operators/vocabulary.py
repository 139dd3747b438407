"""Vocabulary of character n-grams: counts, weights, selection, and greedy tokenisation."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.functions import codec
from glyphmill.operators import kernel
from glyphmill.sources.storage import cut

LENGTHS = range(1, 10)
#: Entries of the vocabulary: ids 1 to 48 are the characters, 49 the sentence end, the others selected n-grams up to 254.
CHARACTERS, SIZE = 49, 254
#: Most frequent n-grams of one length that may be selected.
CAP = 3_000_000
#: N-grams seen once in so many characters are counted first, for the selection; rarer ones only where these don't suffice.
SHARES = (1 << 14, 1 << 18)
#: N-grams that are looked for side by side, at most; beyond, all are counted.
MOST_LOOKED_FOR = 1 << 20
#: Characters that are sorted together.
SORTED_CHARS = 1 << 21


def gram_counts(docs: DataFrame, lengths=LENGTHS, text_col: str = "text", by: tuple[str, ...] = ()) -> DataFrame:
    """(by, len, packed, cnt) of all character n-grams of each document's stream, crossing words and sentences."""
    lengths = list(lengths)
    at = len(by)

    def counted(texts: pa.Array) -> Iterator[list[np.ndarray]]:
        data, size = kernel.stream_codes(texts)
        left = np.repeat(np.cumsum(size), size) - np.arange(len(data))  # characters from here to the document's end
        code = np.zeros(len(data), np.int64)
        for n in range(1, max(lengths) + 1):
            if n > len(data):
                break
            code = (code[: len(data) - n + 1] << 6) | data[n - 1 :]
            if n in lengths:
                own = np.sort(code[left[: len(code)] >= n])
                first = np.flatnonzero(np.r_[len(own) > 0, own[1:] != own[:-1]])
                yield [own[first], np.diff(np.r_[first, len(own)])]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[np.ndarray]]]:
        for part in kernel.slices(batches, at):
            for key, texts in kernel.by_key(part, at):
                for columns in counted(texts):
                    yield key, columns

    def finish(columns: list[np.ndarray]) -> dict[str, pa.Array]:
        return {"len": pa.array(_length(columns[0])), "packed": pa.array(columns[0]), "cnt": pa.array(columns[1])}

    d = docs.select(*by, F.col(text_col).alias("__text"))
    return kernel.sums(d, partial, 18, finish, "len int, packed bigint, cnt bigint", by)


def _sorted_windows(docs: DataFrame, text_col: str, by: tuple[str, ...], each, fields: str) -> DataFrame:
    """(by, what ``each`` gives of ``kernel.windows`` of about ``SORTED_CHARS`` characters). ``each`` makes, for a task, a pair of
    functions: of (values of ``by``, windows), and of nothing, which gives (values of ``by``, columns) at the end."""
    at = len(by)
    d = docs.select(*by, F.col(text_col).alias("__text"))
    own_types = [pa.field(c, t) for c, t in zip(by, kernel._arrow_types(d, by))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        see, end = each()
        held: dict[tuple, list[tuple[np.ndarray, np.ndarray]]] = {}
        chars: dict[tuple, int] = {}

        def sort(key: tuple, parts: list[tuple[np.ndarray, np.ndarray]]) -> None:
            if parts:
                see(key, kernel.windows(*(np.concatenate([p[i] for p in parts]) for i in (0, 1))))

        for part in kernel.slices(batches, at):
            for key, texts in kernel.by_key(part, at):
                own = kernel.stream_codes(texts)
                held.setdefault(key, []).append(own)
                chars[key] = chars.get(key, 0) + len(own[0])
                if chars[key] >= 2 * SORTED_CHARS:  # half stays, so that the last windows of a task aren't few
                    total = np.cumsum([len(p[0]) for p in held[key]])
                    n = int(np.searchsorted(total, SORTED_CHARS)) + 1
                    sort(key, held[key][:n])
                    held[key], chars[key] = held[key][n:], int(total[-1] - total[n - 1])
            if sum(chars.values()) >= 16 * SORTED_CHARS:  # of many values
                for key in list(held):
                    sort(key, held.pop(key))
                chars = {}
        for key in list(held):
            sort(key, held.pop(key))
        for key, columns in end():
            for i in range(0, len(columns[0]), kernel.OUT_ROWS):
                columns_i = [pa.array(c[i : i + kernel.OUT_ROWS]) for c in columns]
                yield pa.RecordBatch.from_arrays([*(pa.array([v] * len(columns_i[0]), f.type) for v, f in zip(key, own_types)), *columns_i], names=[*by, *fields_names])

    fields_names = [f.split()[0] for f in fields.split(", ")]
    return d.mapInArrow(run, "".join(f"{c} {d.schema[c].dataType.simpleString()}, " for c in by) + fields)


def frequent_grams(docs: DataFrame, share: int, text_col: str = "text", by: tuple[str, ...] = ()) -> DataFrame:
    """(by, len, packed, chars, cnt, seen): n-grams of two characters and more, among them each that is seen at least once in
    ``share`` characters of the streams (of its ``by``); as 0 the number of these characters.

    Such an n-gram is as frequent in one of the parts that are sorted together. In a part it fills places in a row, so every
    so many places one is looked at. What a task has found it counts in its further parts, however rare it is there; in parts
    before, it has fewer occurrences than would have been found. ``cnt`` is what was counted; an n-gram may have as many
    occurrences more as the ``seen`` of 0 is above its own, one that isn't there as many as that of 0.
    """

    def each():
        held: dict[tuple, list] = {}  # characters; occurrences of what was found in no part, at most; by length what was found

        def see(key: tuple, windows: np.ndarray) -> None:
            none = np.zeros(0, np.int64)
            own = held.setdefault(key, [0, 0, {n: (none, none, none) for n in LENGTHS[1:]}])
            least = max(1, -(-len(windows) // share))
            some = windows[::least]
            for n, (known, cnt, before) in own[2].items():
                shift = 6 * (LENGTHS[-1] - n)
                grams = some >> shift
                grams = grams[np.r_[True, grams[1:] != grams[:-1]][: len(grams)]]
                grams = np.union1d(known, grams[grams & 63 > 0])
                here = np.searchsorted(windows, grams + 1 << shift) - np.searchsorted(windows, grams << shift)
                keep = here >= least
                at = np.searchsorted(grams, known)
                keep[at] = True
                missed = np.full(len(grams), own[1])
                missed[at] = before
                here[at] += cnt
                own[2][n] = grams[keep], here[keep], missed[keep]
            own[0] += len(windows)
            own[1] += least - 1

        def end():
            for key, (chars, most, found) in held.items():
                grams, cnt, missed = (np.concatenate(c) for c in zip(*found.values()))
                none = np.zeros(len(grams), np.int64)
                yield key, [np.r_[np.int32(0), _length(grams)], np.r_[0, grams], np.r_[chars, none], np.r_[0, cnt], np.r_[most, most - missed]]

        return see, end

    rows = _sorted_windows(docs, text_col, by, each, "len int, packed bigint, chars bigint, cnt bigint, seen bigint")
    return rows.groupBy(*by, "len", "packed").agg(*(F.sum(c).alias(c) for c in ("chars", "cnt", "seen")))


def counts_of(docs: DataFrame, grams: dict[tuple, np.ndarray], text_col: str = "text", by: tuple[str, ...] = ()) -> DataFrame:
    """(by, len, packed, cnt) of given packed n-grams (for each ``by``), as ``gram_counts`` has them."""
    bounds = {}
    for key, own in grams.items():
        own = np.sort(own)
        shift = 6 * (LENGTHS[-1] - _length(own))
        places, at = np.unique(np.concatenate([own << shift, own + 1 << shift]), return_inverse=True)
        bounds[key] = own, places, at[: len(own)], at[len(own) :]

    def each():
        total: dict[tuple, np.ndarray] = {}

        def see(key: tuple, windows: np.ndarray) -> None:
            if key in bounds:
                own, places, low, high = bounds[key]
                at = np.searchsorted(windows, places)
                total[key] = total.get(key, 0) + (at[high] - at[low])

        def end():
            for key, cnt in total.items():
                some = cnt > 0
                own = bounds[key][0][some]
                yield key, [_length(own), own, cnt[some]]

        return see, end

    rows = _sorted_windows(docs, text_col, by, each, "len int, packed bigint, cnt bigint")
    return rows.groupBy(*by, "len", "packed").agg(F.sum("cnt").alias("cnt"))


def _length(packed: np.ndarray) -> np.ndarray:
    """No stream has the null code, so a packed n-gram is at least 64 ** (n - 1)."""
    return np.searchsorted(64 ** np.arange(10, dtype=np.int64), packed, "right").astype(np.int32)


def weight(cnt: Column, length: Column) -> Column:
    return F.floor(F.log1p(cnt) * F.pow(length, F.lit(0.1)) + 0.5).cast("bigint")


def top_grams(counts: DataFrame, k: int, by: tuple[str, ...] = ()) -> DataFrame:
    """The k most frequent n-grams of each length; the smaller packed value wins a tie. For small k: limits run before the shuffle,
    and the rest of a length meets in one task."""
    w = W.partitionBy(*by, "len").orderBy(F.desc("cnt"), "packed")
    return counts.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k)


@dataclass(frozen=True)
class Vocabulary:
    """At most 254 entries (token, token text)."""

    entries: tuple[tuple[int, str], ...]

    def frame(self, spark: SparkSession) -> DataFrame:
        """(token, seq, packed, text)."""
        rows = [(t, s, codec.pack_value(s)) for t, s in self.entries]
        d = spark.createDataFrame(rows, "token int, seq string, packed bigint")
        return d.withColumn("text", codec.decode(F.col("seq")))

    @property
    def pattern(self) -> str:
        """First alternative wins, so longer entries stand first."""
        return "|".join(sorted((s for _, s in self.entries), key=lambda s: (-len(s), s)))

    def ids(self, pieces: Column) -> Column:
        """Token ids of an array of entries: a lookup by first character, then in that character's entries."""
        by: dict[str, list[tuple[int, str]]] = {}
        for t, s in self.entries:
            by.setdefault(s[0], []).append((t, s))
        table = F.create_map(*(x for c, own in sorted(by.items()) for x in (F.lit(c), F.create_map(*(F.lit(v) for t, s in own for v in (s, t))))))
        return F.transform(pieces, lambda p: F.element_at(F.element_at(table, F.substring(p, 1, 1)), p))

    def text_of(self, token: Column) -> Column:
        table = F.create_map(*(F.lit(v) for t, s in self.entries for v in (t, s.translate(str.maketrans(codec.DECODE_FROM, codec.DECODED)))))
        return F.try_element_at(table, token)


def _presets() -> list[tuple[int, str]]:
    return [(t, codec.ALPHABET[t]) for t in range(1, CHARACTERS)] + [(CHARACTERS, codec.SENTENCE_END)]


def merge_counts(*parts: DataFrame) -> DataFrame:
    """N-gram counts of several corpora as one."""
    return reduce(DataFrame.unionByName, parts).groupBy("len", "packed").agg(F.sum("cnt").alias("cnt"))


def candidates(counts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, gram, len, cnt, w, packed) of n-grams that may be selected: two characters and more."""
    return counts.where("len >= 2").select(*by, codec.unpacked(F.col("packed")).alias("gram"), "len", "cnt", weight(F.col("cnt"), F.col("len")).alias("w"), "packed")


def select_entries(cand: DataFrame, pool: int = 4_096, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, rk, gram) of the selected n-grams: by weight, leaving out those inside a longer one that ranks before them.

    Only the ``pool`` best (of each value of ``by``) are looked at; the pool grows until enough are left or there are no
    more. Among n-grams of one length the weight rises with the count, so a pool up to ``CAP`` lies within the most frequent
    ``CAP`` of each length, and that cap needs no ranking of its own.
    """
    # Of one length, n-grams sort as their packed values; what is written out are the pool's only.
    need, order = SIZE - CHARACTERS, (F.desc("w"), F.desc("cnt"), "len", "packed")
    cand = cand.drop("gram")
    while True:
        if by:  # the rank is limited before the shuffle too
            best = cand.withColumn("rk", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("rk") <= pool)
        else:
            best = cand.orderBy(*order).limit(pool).withColumn("rk", F.row_number().over(W.orderBy(*order)))  # one task ranks ``pool`` rows
        ranked = cut(best.select(*by, "rk", codec.unpacked(F.col("packed")).alias("gram"), "len"))
        s = ranked.select(*by, F.col("rk").alias("srk"), F.col("gram").alias("sgram"), F.col("len").alias("slen"))
        inside = (F.col("srk") < F.col("rk")) & (F.col("slen") > F.col("len")) & F.contains("sgram", "gram")
        if by:
            s = s.select(*(F.col(c).alias(f"s_{c}") for c in by), "srk", "sgram", "slen")
            kept = ranked.join(s, reduce(lambda a, b: a & b, (F.col(c) == F.col(f"s_{c}") for c in by)) & inside, "left_anti")
        else:
            kept = ranked.join(F.broadcast(s), inside, "left_anti")  # ``pool`` rows
        place = F.row_number().over(W.partitionBy(*by).orderBy("rk"))
        chosen = cut(kept.withColumn("place", place).where(F.col("place") <= need).select(*by, "rk", "gram"))
        # Full pools that gave too few entries have to grow.
        full = ranked.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") >= pool)
        short = full.join(chosen.groupBy(*by).agg(F.count("*").alias("m")), list(by), "left") if by else full.crossJoin(chosen.agg(F.count("*").alias("m")))
        if pool >= CAP or short.where(F.coalesce("m", F.lit(0)) < need).isEmpty():
            return chosen
        pool = min(CAP, pool * 4)


def select(docs: DataFrame, text_col: str = "text", by: tuple[str, ...] = ()) -> DataFrame:
    """``select_entries`` of all n-grams of a corpus, most of which need no counting.

    An n-gram that ``frequent_grams`` leaves out has a weight of at most that of the longest at the most occurrences it can
    have. What is heavier is counted, so a selection that is full with these is the same as from all. Those that were found
    in time by every task are counted with that; the others only if a selection isn't full with what is heavier than they can be.
    """
    need, names = SIZE - CHARACTERS, [f"b{i}" for i in range(len(by))]
    d = docs.select(*(F.col(c).alias(b) for c, b in zip(by, names)), F.col(text_col).alias("text"))
    asked, by = by, tuple(names)
    back = lambda df: df.select(*(F.col(b).alias(c) for c, b in zip(asked, by)), "rk", "gram")
    same = reduce(lambda a, b: a & b, (F.col(f"c.{b}").eqNullSafe(F.col(f"l.{b}")) for b in by), F.lit(True))
    key = lambda r: tuple(r)[: len(by)]

    def full(counts: DataFrame, above: dict[tuple, int], complete: set[tuple]) -> DataFrame | None:
        """The selection from what is heavier; none if it lacks entries where there may be others."""
        limits = d.sparkSession.createDataFrame([(*k, w) for k, w in above.items()], T.StructType([*d.select(*by).schema.fields, T.StructField("above", T.LongType())]))
        cand = candidates(counts, by).alias("c").join(F.broadcast(limits.alias("l")), same).where(F.col("w") > F.col("above")).select("c.*")
        chosen = select_entries(cand, by=by)
        enough = {key(r) for r in chosen.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") >= need).collect()}
        return chosen if above.keys() <= enough | complete else None

    for share in SHARES:
        found = cut(frequent_grams(d, share, by=by))
        if found.count() > MOST_LOOKED_FOR:
            break
        limits = found.where("packed = 0").select(*by, F.col("seen").alias("left_out"), weight(F.col("seen"), F.lit(LENGTHS[-1])).alias("above"))
        rows = limits.collect()
        above, complete = {key(r): r["above"] for r in rows}, {key(r) for r in rows if r["left_out"] <= 0}
        at_most = F.col("cnt") + F.col("left_out") - F.col("seen")
        known = found.where("packed > 0").alias("c").join(F.broadcast(limits.alias("l")), same).select("c.*", at_most.alias("at_most"), "above")
        sure, unsure = known.where("cnt = at_most"), known.where((F.col("cnt") < F.col("at_most")) & (weight(F.col("at_most"), F.col("len")) > F.col("above")))
        heaviest = {key(r): r["w"] for r in unsure.groupBy(*by).agg(F.max(weight(F.col("at_most"), F.col("len"))).alias("w")).where("w IS NOT NULL").collect()}
        chosen = full(sure, above | heaviest, complete - heaviest.keys())
        if chosen is None and heaviest:
            rows = unsure.select(*by, "packed").toArrow()
            grams: dict[tuple, list[int]] = {}
            for k, g in zip(zip(*(rows.column(b).to_pylist() for b in by)) if by else [()] * rows.num_rows, rows.column("packed").to_pylist()):
                grams.setdefault(k, []).append(g)
            counts = cut(counts_of(d, {k: np.array(g, np.int64) for k, g in grams.items()}, by=by))
            chosen = full(sure.select(*counts.columns).unionByName(counts), above, complete)
        if chosen is not None:
            return back(chosen)
    return back(select_entries(candidates(gram_counts(d, LENGTHS[1:], by=by), by), by=by))


def _of(chosen: list[str]) -> Vocabulary:
    return Vocabulary(tuple(_presets() + [(CHARACTERS + 1 + i, g) for i, g in enumerate(chosen)]))


def learn(docs: DataFrame, text_col: str = "text") -> Vocabulary:
    return _of([r["gram"] for r in select(docs, text_col).orderBy("rk").collect()])


def learn_by(docs: DataFrame, column: str, text_col: str = "text") -> dict[str, Vocabulary]:
    """A vocabulary for each value of a column; all are counted and selected in the same jobs."""
    known = docs.where(F.col(column).isNotNull())
    chosen: dict[str, list[str]] = {r[0]: [] for r in known.select(column).distinct().collect()}
    for r in select(known, text_col, (column,)).orderBy(column, "rk").collect():  # 205 rows a value
        chosen[r[0]].append(r["gram"])
    return {v: _of(grams) for v, grams in sorted(chosen.items())}


def _matched(vocab: Vocabulary, keep: tuple[str, ...], codes) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(keep, tokens) of batches of (keep, text)."""
    match = kernel.Matcher(vocab.entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in kernel.slices(batches, len(keep)):
            tokens = kernel.lists(*match(*codes(part.column(len(keep)))))
            yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], tokens], names=[*keep, "tokens"])

    return run


def _tokenised(docs: DataFrame, vocab: Vocabulary, keep: tuple[str, ...], text_col: str, codes) -> DataFrame:
    d, run = docs.select(*keep, F.col(text_col).alias("tokens")), _matched(vocab, keep, codes)
    return d.mapInArrow(run, T.StructType([*d.schema.fields[: len(keep)], T.StructField("tokens", T.ArrayType(T.IntegerType()))]))


def _training_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return kernel.stream_codes(texts, single=True)


def training_tokens(vocab: Vocabulary, id_col: str = "doc_id") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``tokenize_training`` of batches of (id, text), for tasks that go on with the tokens."""
    return _matched(vocab, (id_col,), _training_codes)


def tokenize_training(docs: DataFrame, vocab: Vocabulary, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """(keep, tokens): greedy longest match over the stream, runs of separators as one; what no entry matches is skipped."""
    return _tokenised(docs, vocab, keep, text_col, _training_codes)


def tokenize_inference(texts: DataFrame, vocab: Vocabulary, keep: tuple[str, ...], text_col: str = "text") -> DataFrame:
    """(keep, tokens) of raw text: unknown characters break matches, separators aren't collapsed."""
    return _tokenised(texts, vocab, keep, text_col, kernel.raw_codes)


def token_frequency(tokenised: DataFrame) -> DataFrame:
    return tokenised.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("cnt"))

"""Near-duplicate classes by fast similarity sketches, banding and exact verification.

Sketch: ``SIZE`` coordinates are filled in rounds. In round r < SIZE every shingle is thrown into a hashed bin with
value r + a hashed fraction; in round SIZE + r all shingles go to bin r. A bin keeps its least value. Throwing stops
when no bin is empty: at the latest after 2 SIZE rounds every coordinate is filled, and matching coordinates estimate
the Jaccard similarity with Chernoff-style bounds at about n + SIZE log SIZE hash values, not n SIZE.

1. Each document gets its shingle count, a 128-bit fingerprint of its shingle set and its sketch (one row-wise pass,
   written to the shared folder). Documents with equal sets are one *class* from here on.
2. The sketch is cut into ``BANDS`` bands of ``ROWS`` coordinates. Classes that agree on a band share a bucket. Two
   classes at the threshold 0.85 share none with a chance of (1 - 0.85**6)**40 < 1e-8.
3. Every class is paired with one leader of each of its buckets only: the class with most crowded buckets, which is
   where near copies of one text have their common origin. These star pairs are verified on the full sets.
4. Components of the verified pairs. Links may still join classes that met the same leader but are in different
   components: these are compared inside NumPy, in pairs of blocks of about ``BLOCK_SHINGLES`` shingles, by their sketches
   (six deviations below the threshold and more), then on the full sets. So no link between two texts depends on the
   leader, and no task ever holds more than two blocks.
5. Components of all links; each component is named by the least doc_id in it.

Shingles are compared as 64-bit fingerprints. Documents without words are linked with nothing, not even with each
other, and are kept. Rows without doc_id are linked like others, but can't name a component: it has the least id that there
is, and is null and kept where there is none. Rows with the same doc_id are judged by their own texts. Empty tables give
empty results. Columns of any other name may be there; only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import free_name, map_rows, materialise, spread_join
from glyphmill.llm.components import components
from glyphmill.llm.words import mix, window_hashes, word_hashes

SIZE, BANDS, ROWS = 240, 40, 6
#: Shingles of the members of one block of the block-wise comparison, about.
BLOCK_SHINGLES = 200_000
#: Pairs whose sets are Python objects at a time.
VERIFY_ROWS = 64
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_32 = np.uint64(32)
_LOW = np.uint64(0xFFFFFFFF)


def shingles(text: bytes | None, n: int) -> np.ndarray:
    """Sorted distinct fingerprints of a text's shingles of n words, A-Z in lower case."""
    words = (text or b"").lower().split()  # bytes.lower() touches A-Z only
    return np.unique(window_hashes(word_hashes(words), n))


def sketch(s: np.ndarray, size: int = SIZE) -> np.ndarray:
    """16-bit fingerprints of the coordinates of a non-empty set's fast similarity sketch."""
    out, filled = np.zeros(size, np.uint64), np.zeros(size, bool)
    t, r, last = np.uint64(size), 0, 2 * size
    while r < last and not filled.all():
        rounds = np.arange(r, min(last, r + max(1, size * 2 // len(s))), dtype=np.uint64)
        r += len(rounds)
        h = mix(s[None, :] + (rounds[:, None] + np.uint64(1)) * _GOLD).ravel()
        turn = np.repeat(rounds, len(s))
        place = np.where(turn < t, ((h >> _32) * t) >> _32, turn - t).astype(np.int64)
        value = (turn << _32) | (h & _LOW)
        order = np.argsort(value, kind="stable")[::-1]  # the least value is assigned last, and stays
        best = np.zeros(size, np.uint64)
        hit = np.zeros(size, bool)
        best[place[order]] = value[order]
        hit[place] = True
        new = hit & ~filled
        out[new] = best[new]
        filled |= hit
    return (mix(out) >> np.uint64(48)).astype("<u2")


def _fingerprint(s: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(s.tobytes())


def _text_key(text_col: str) -> Column:
    """128 bits that tell the texts of rows with the same doc_id apart."""
    return F.unhex(F.md5(F.col(text_col).cast("binary")))


def sketched(docs: DataFrame, n_words: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, sig, sketch, text_key of each row (sig and sketch null without words)."""
    d = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), _text_key(text_col).alias("text_key"))

    def make():
        def f(ids, texts, keys):
            out = []
            for i, t, key in zip(ids, texts, keys):
                s = shingles(t, n_words)
                some = len(s) > 0
                out.append({"doc_id": i, "n_shingles": len(s), "sig": _fingerprint(s) if some else None, "sketch": sketch(s).tobytes() if some else None, "text_key": key})
            return out

        return f

    return map_rows(d, ["doc_id", "text", "text_key"], "r", "struct<doc_id: bigint, n_shingles: bigint, sig: binary, sketch: binary, text_key: binary>", make, keep=False, owner="words").select("r.*")


def _sets(docs: DataFrame, wanted: DataFrame, n_words: int, id_col: str, text_col: str) -> DataFrame:
    """(sig, hashes) of the wanted classes (doc_id, text_key, sig): full sets from the text of one row of each."""
    d = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), _text_key(text_col).alias("key"))
    d = d.join(wanted, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("key") == F.col("text_key"))).select("sig", "text")

    def make():
        def f(sigs, texts):
            out = []
            for g, t in zip(sigs, texts):
                s = shingles(t, n_words)
                out.append({"sig": g, "hashes": s.tobytes()} if len(s) and _fingerprint(s) == bytes(g) else None)
            return out

        return f

    return map_rows(d, ["sig", "text"], "r", "struct<sig: binary, hashes: binary>", make, keep=False, owner="words").where("r is not null").select("r.*").dropDuplicates(["sig"])


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) with 100 * intersection >= percent * union, on the full sets."""
    a = sets.select(F.col("sig").alias("u"), F.col("hashes").alias("a"))
    b = sets.select(F.col("sig").alias("v"), F.col("hashes").alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, VERIFY_ROWS):
                part = whole.slice(at, VERIFY_ROWS)
                us, vs, xs, ys = (part.column(i).to_pylist() for i in range(4))
                keep = []
                for x, y in zip(xs, ys):
                    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * both >= percent * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays([pa.array([u for u, k in zip(us, keep) if k], pa.binary()), pa.array([v for v, k in zip(vs, keep) if k], pa.binary())], names=["u", "v"])

    return pairs.select("u", "v").join(a, "u").join(b, "v").select("u", "v", "a", "b").mapInArrow(run, "u binary, v binary")


def _alike(percent: int):
    """Sizes of which one set can have the similarity with the other."""
    return F.least("n_u", "n_v") * 100 >= F.greatest("n_u", "n_v") * percent


def _across(members: DataFrame, sets: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) between members of one leader that are in different components, on the full sets.

    members: (leader, sig, comp). Only members outside the leader's component have to be compared, with all members:
    blocks of the former times blocks of the latter. A block tests pairs by their sketches, then by their sets, and
    reports a link for each pair of a member and a component at most. Rows are slim until they are dealt to blocks;
    each block is a key of its own in the last shuffle, so a leader's blocks lie in many tasks.
    """
    own = members.where("sig = leader").select("leader", F.col("comp").alias("home"))
    m = spread_join(members.join(sets.select("sig", "n"), "sig"), own, "leader", "sig")
    away = F.when(F.col("comp") != F.col("home"), F.col("n"))
    sizes = m.groupBy("leader").agg(F.sum("n").alias("all"), F.sum(away).alias("out")).where("out > 0")
    m = materialise(spread_join(m, sizes, "leader", "sig"), "members")
    blocks = lambda c: F.ceil(F.col(c) / BLOCK_SHINGLES).cast("bigint")
    place = lambda c: F.pmod(F.xxhash64("sig"), blocks(c))
    all_of = lambda c: F.explode(F.sequence(F.lit(0).cast("bigint"), blocks(c) - 1))
    left = m.where("comp <> home").select("leader", place("out").alias("i"), all_of("all").alias("j"), F.lit(True).alias("asks"), "sig", "n", "comp")
    right = m.select("leader", all_of("out").alias("i"), place("all").alias("j"), F.lit(False).alias("asks"), "sig", "n", "comp")
    heavy = full.join(sets.select("sig", "sketch"), "sig")
    dealt = left.unionByName(right).join(heavy, "sig").repartition("leader", "i", "j")
    least = percent / 100 - 6 * np.sqrt(percent / 100 * (1 - percent / 100) / SIZE)

    def compare(group: pa.Table) -> pa.Table:
        asks = np.array(group.column("asks").to_pylist(), bool)
        sig, n = group.column("sig").to_pylist(), np.array(group.column("n").to_pylist(), np.int64)
        names = {c: k for k, c in enumerate(dict.fromkeys(group.column("comp").to_pylist()))}
        comp = np.array([names[c] for c in group.column("comp").to_pylist()], np.int64)
        k = np.frombuffer(b"".join(group.column("sketch").to_pylist()), "<u2").reshape(len(sig), SIZE)
        sets = [np.frombuffer(x, np.uint64) for x in group.column("hashes").to_pylist()]
        told = np.flatnonzero(~asks)
        us, vs = [], []
        for x in np.flatnonzero(asks):
            near = (comp[told] != comp[x]) & (100 * np.minimum(n[told], n[x]) >= percent * np.maximum(n[told], n[x]))
            near[near] = (k[told[near]] == k[x]).mean(1) >= least
            linked = set()
            for y in told[near].tolist():
                if comp[y] in linked:
                    continue
                both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                if 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                    linked.add(comp[y])
                    us.append(max(sig[x], sig[y]))
                    vs.append(min(sig[x], sig[y]))
        return pa.table({"u": pa.array(us, pa.binary()), "v": pa.array(vs, pa.binary())})

    return dealt.groupBy("leader", "i", "j").applyInArrow(compare, "u binary, v binary").distinct()


def classes(docs: DataFrame, n_words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row (see the module's text)."""
    return _judged(docs, n_words, percent, id_col, text_col).select("doc_id", "n_shingles", "component_id", "kept")


def _judged(docs: DataFrame, n_words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """``classes`` with each row's text_key and whether its id and text are those of the row that stays for its component."""
    rows = materialise(sketched(docs, n_words, id_col, text_col), "sketches")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    sets = rows.where("sig is not null").groupBy("sig").agg(F.min(first).alias("first"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    band = lambda b: F.xxhash64(b, F.substring("sketch", F.lit(1) + b * (2 * ROWS), F.lit(2 * ROWS)))
    buckets = sets.select("sig", "n", F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), band)).alias("bucket"))
    # Crowding of a class: the sizes of its buckets, summed. The most crowded class leads a bucket.
    crowded = buckets.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    met = materialise(buckets.join(crowded, "bucket").select("bucket", "sig", "n", "size"), "buckets")
    weight = met.groupBy("sig").agg(F.sum("size").alias("weight"))
    met = met.join(weight, "sig")
    leaders = met.groupBy("bucket").agg(F.max(F.struct("weight", "sig", "n")).alias("lead"))
    stars = materialise(met.join(leaders, "bucket").where("sig <> lead.sig").select(F.col("sig").alias("u"), F.col("lead.sig").alias("v"), F.col("n").alias("n_u"), F.col("lead.n").alias("n_v")).distinct(), "stars")
    ends = stars.select(F.col("u").alias("sig")).unionByName(stars.select(F.col("v").alias("sig"))).distinct()
    wanted = sets.join(ends, "sig", "left_semi").select("first.doc_id", "first.text_key", "sig")
    full = materialise(_sets(docs, wanted, n_words, id_col, text_col), "sets")
    links = materialise(_verify(stars.where(_alike(percent)), full, percent), "links")
    comp = components(links)
    members = stars.select(F.col("v").alias("leader"), F.col("u").alias("sig")).unionByName(stars.select(F.col("v").alias("leader"), F.col("v").alias("sig"))).distinct()
    named = members.join(comp.withColumnRenamed("vertex", "sig"), "sig", "left").select("leader", "sig", F.coalesce("root", "sig").alias("comp"))
    # Leaders all of whose members are in one component need no second look.
    split = named.groupBy("leader").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b").select("leader")
    extra = materialise(_across(spread_join(named, split, "leader", "sig"), sets, full, percent), "more-links")
    if not extra.isEmpty():
        comp = components(links.unionByName(extra))
    labels = sets.select("sig", "first").join(comp.withColumnRenamed("vertex", "sig"), "sig", "left").select("sig", F.coalesce("root", "sig").alias("root"), "first")
    least = labels.groupBy("root").agg(F.min("first").alias("first"))
    by_sig = labels.drop("first").join(least, "root").select("sig", "first")
    out = rows.select("doc_id", "n_shingles", "sig", "text_key").join(by_sig, "sig", "left")
    component = F.when(F.col("sig").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id"))
    stays = F.col("sig").isNull() | (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key")))
    judged = out.select("doc_id", "n_shingles", component.alias("component_id"), "text_key", F.col("sig").isNotNull().alias("some"), stays.alias("stays"))
    return judged.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def deduplicate(docs: DataFrame, n_words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: that of the least doc_id (null ids last), then of the least text digest.

    Rows are told apart by id and text, so rows with the same id go or stay each by its own text. Of rows equal in both,
    one stays, whatever their other columns hold. Rows without words are copies of nothing and all stay.
    """
    gone, key = free_name(docs, "gone_id"), free_name(docs, "gone_key")
    named = (F.col("doc_id").alias(gone), F.col("text_key").alias(key))
    judged = materialise(_judged(docs, n_words, percent, id_col, text_col).where("some").select("doc_id", "text_key", "stays"), "verdicts")
    removed = judged.where("not stays").select(*named).distinct()
    again = judged.where("stays").groupBy("doc_id", "text_key").agg(F.count("*").alias("n")).where("n > 1").select(*named)
    same = F.col(id_col).cast("bigint").eqNullSafe(F.col(gone)) & (_text_key(text_col) == F.col(key))
    if again.isEmpty():
        return docs.join(removed, same, "left_anti")
    single = docs.join(removed.unionByName(again), same, "left_anti")
    one = docs.join(again, same, "left_semi").withColumn(key, _text_key(text_col)).dropDuplicates([id_col, key]).drop(key)
    return single.unionByName(one)

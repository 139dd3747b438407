"""N-gram model: context keys, counts, top-2 tables, prediction, back-off, generation and beams.

A context is eight previous tokens, p1 the latest; a missing one is 0. A strategy packs it into an unsigned 32-bit key
of four bytes, kept as a bigint, and says which keys each token is counted under.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphmill.operators import kernel
from glyphmill.operators.vocabulary import Vocabulary, tokenize_inference, tokenize_training, training_tokens
from glyphmill.sources.storage import cut

Previous = dict[int, Column]


def pack4(a: Column, b: Column, c: Column, d: Column) -> Column:
    return a.cast("bigint") * 16777216 + b.cast("bigint") * 65536 + c.cast("bigint") * 256 + d.cast("bigint")


def fold(a: Column, b: Column) -> Column:
    """One byte of two tokens: the first turned left by five bits, then xor the second."""
    return (a.bitwiseAND(F.lit(7)) * 32).bitwiseXOR(b)


def linear(p: Previous) -> Column:
    return pack4(p[4], p[3], p[2], p[1])


def skipping(p: Previous) -> Column:
    return pack4(p[7], p[4], p[2], p[1])


def xor(p: Previous) -> Column:
    """Each further byte counts only if all nearer tokens are there."""
    none = F.lit(0)
    near = (p[2] == 0) | (p[3] == 0)
    far = near | (p[4] == 0) | (p[5] == 0) | (p[7] == 0)
    return pack4(F.when(far, none).otherwise(fold(p[7], p[8])), F.when(near, none).otherwise(fold(p[3], p[4])), p[2], p[1])


def _only(p: Previous, *kept: int) -> Previous:
    return {k: v if k in kept else F.lit(0) for k, v in p.items()}


#: Strategy: key of a full context; (key, weight) pairs under which a token is counted.
STRATEGIES: dict[str, tuple[Callable[[Previous], Column], Callable[[Previous], list[tuple[Column, int]]]]] = {
    "linear": (linear, lambda p: [(linear(_only(p, *range(1, n + 1))), 1) for n in (4, 3, 2, 1)]),
    "skipping": (skipping, lambda p: [(skipping(_only(p, *kept)), 1) for kept in ((7, 4, 2, 1), (4, 2, 1), (2, 1), (1,))]),
    # The levels of six and seven tokens have no fifth token and fall to the level of four: weight 3.
    "xor": (xor, lambda p: [(xor(_only(p, 1)), 1), (xor(_only(p, 1, 2)), 1), (xor(_only(p, 1, 2, 3)), 1), (xor(_only(p, 1, 2, 3, 4)), 3), (xor(p), 1)]),
}


def histories(tokenised: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, pos, tok, p1..p8) of every token; histories start anew in each document and come from its own array: no shuffle."""
    at = lambda i, k: F.when(i >= k, F.get(F.col("tokens"), i - k)).otherwise(0)
    places = F.when(F.size("tokens") > 0, F.sequence(F.lit(0), F.size("tokens") - 1))
    rows = F.transform(places, lambda i: F.struct(i.alias("pos"), F.get(F.col("tokens"), i).alias("tok"), *(at(i, k).alias(f"p{k}") for k in range(1, 9))))
    return tokenised.select(id_col, F.inline(rows))


def _previous() -> Previous:
    return {k: F.col(f"p{k}") for k in range(1, 9)}


def context_keys(hist: DataFrame, strategy: str, id_col: str = "doc_id") -> DataFrame:
    """(id, pos, tok, ctx): the full key at each token."""
    return hist.select(id_col, "pos", "tok", STRATEGIES[strategy][0](_previous()).alias("ctx"))


def _seen(id_: Column, place: Column) -> Column:
    """(id, place) as one number: a struct's minimum would force sorts in place of hash aggregation."""
    return id_.cast("decimal(19,0)") * F.lit(1 << 32).cast("decimal(10,0)") + place.cast("decimal(10,0)")


def context_counts(hist: DataFrame, strategy: str, id_col: str = "doc_id", least: int = 1) -> DataFrame:
    """(ctx, tok, cnt, first_seen) over all levels; with ``least`` only contexts counted so often in total."""
    levels = F.array(*(F.struct(ctx.alias("ctx"), F.lit(w).cast("bigint").alias("w")) for ctx, w in STRATEGIES[strategy][1](_previous())))
    rows = hist.select("tok", _seen(F.col(id_col), F.col("pos")).alias("seen"), F.inline(levels))
    out = rows.groupBy("ctx", "tok").agg(F.sum("w").alias("cnt"), F.min("seen").alias("first_seen"))
    if least > 1:
        keep = out.groupBy("ctx").agg(F.sum("cnt").alias("total")).where(F.col("total") >= least).select("ctx")
        out = out.join(keep, "ctx", "left_semi")
    return out


# The same in NumPy, for whole corpora: contexts and counts come from the tokens' arrays, a slice of documents at a time.

_Arrays = dict[int, np.ndarray]


def _pack4(a, b, c, d) -> np.ndarray:
    return a << 24 | b << 16 | c << 8 | d


def _fold(a, b) -> np.ndarray:
    return (a & 7) << 5 ^ b


def _linear(p: _Arrays) -> np.ndarray:
    return _pack4(p[4], p[3], p[2], p[1])


def _skipping(p: _Arrays) -> np.ndarray:
    return _pack4(p[7], p[4], p[2], p[1])


def _xor(p: _Arrays) -> np.ndarray:
    near = (p[2] == 0) | (p[3] == 0)
    far = near | (p[4] == 0) | (p[5] == 0) | (p[7] == 0)
    return _pack4(np.where(far, 0, _fold(p[7], p[8])), np.where(near, 0, _fold(p[3], p[4])), p[2], p[1])


def _xor_deep(p: _Arrays) -> np.ndarray:
    """Above the key three bits of p3, which the level of three tokens needs: there p3 is folded alone."""
    return np.where(p[2] == 0, 0, p[3] & 7) << 32 | _xor(p)


def _low(bits: int) -> Callable[[np.ndarray], np.ndarray]:
    """Of a key with its token, the last so many bits of the key."""
    return lambda key: key & (1 << bits + 8) - 1


#: As ``STRATEGIES``: key of a full context; a key that all levels follow from.
_KERNELS: dict[str, tuple[Callable[[_Arrays], np.ndarray], Callable[[_Arrays], np.ndarray]]] = {"linear": (_linear, _linear), "skipping": (_skipping, _skipping), "xor": (_xor, _xor_deep)}
#: The second rarest level has the last three bytes of the rarest, which is in the same bucket: its weight.
_SECOND = {"linear": 1, "skipping": 1, "xor": 3}
#: Tokens that are worked on together, one text at least.
SLICE_TOKENS = 1 << 19
#: Tokens of a slice that are sorted together: a place among them takes 20 bits, a key with its token 43.
SORT_BITS = 20


def _token_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(ids, tokens of all texts in a row, how many each has); tokens are bytes."""
    for batch in batches:
        lists = batch.column(1)
        size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        part, at = np.cumsum(size) // SLICE_TOKENS, 0
        for end in [*(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]:
            if end > at:
                tokens = lists.slice(at, end - at).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                if len(tokens) and not 0 <= tokens.min() <= tokens.max() <= 255:
                    raise ValueError("tokens must be from 0 to 255")
                yield batch.column(0).slice(at, end - at), tokens, size[at:end]
            at = end


def _places(size: np.ndarray) -> np.ndarray:
    """Place of each token in its text."""
    return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)


def _before(tokens: np.ndarray, place: np.ndarray) -> _Arrays:
    first = np.flatnonzero(place < 8)
    near, out = place[first], {}
    for k in range(1, 9):
        out[k] = np.zeros_like(tokens)
        out[k][k:] = tokens[:-k]
        out[k][first[near < k]] = 0
    return out


def _stats(strategy: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key = _KERNELS[strategy][0]
    for ids, tokens, size in _token_slices(batches):
        keys = key(_before(tokens, _places(size)))
        text = np.repeat(np.arange(len(size)), size)
        n = np.bincount(text, minlength=len(size))
        total = np.zeros(len(size), np.int64)
        np.add.at(total, text, keys)
        own = np.sort(text << 32 | keys)
        new = np.r_[True, own[1:] != own[:-1]][: len(own)]
        contexts = np.bincount(own[new] >> 32, minlength=len(size))
        yield pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(total), pa.array(contexts)], names=["id", "n", "total", "contexts"])


def context_stats(tokenised: DataFrame, strategy: str, id_col: str = "doc_id") -> DataFrame:
    """(id, n, total, contexts): tokens of each id, the sum of their keys and how many different keys there are."""
    d = tokenised.select(F.col(id_col).alias("id"), "tokens")
    return _stats_of(d, lambda batches: _stats(strategy, batches), lambda again: again, strategy, id_col)


def text_context_stats(docs: DataFrame, vocab: Vocabulary, strategy: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``context_stats`` of ``tokenize_training``, in one pass: tokens don't leave the task that has matched them."""
    d, tokens = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), training_tokens(vocab, "id")
    return _stats_of(d, lambda batches: _stats(strategy, tokens(batches)), lambda again: tokenize_training(again, vocab, ("id",)), strategy, id_col)


def _stats_of(d: DataFrame, run: Callable, tokenised: Callable[[DataFrame], DataFrame], strategy: str, id_col: str) -> DataFrame:
    kind = d.schema["id"].dataType.simpleString()
    each = d.mapInArrow(run, f"id {kind}, n bigint, total bigint, contexts bigint").where("n > 0")
    out = cut(each.groupBy("id").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("contexts").alias("contexts"), F.count("*").alias("texts")))
    again = out.where("texts > 1").select(F.col("id").alias("twice"))
    if not again.isEmpty():  # ids of several texts: their keys have to meet
        hist = histories(tokenised(d.join(again, F.equal_null("id", "twice"), "left_semi")), "id")
        more = context_keys(hist, strategy, "id").groupBy("id").agg(F.count("*").alias("n"), F.sum("ctx").alias("total"), F.countDistinct("ctx").alias("contexts"))
        out = out.where("texts = 1").drop("texts").unionByName(more)
    return out.select(F.col("id").alias(id_col), "n", "total", "contexts")


def _spread(strategy: str) -> Callable[[list[np.ndarray]], Iterator[tuple[list[np.ndarray], bool]]]:
    """What a task passes on of its counts of the keys that all levels follow from, one level at a time: the rarest level,
    from which the second follows in the bucket's task (so True), and the third to the last."""

    def run(columns: list[np.ndarray]) -> Iterator[tuple[list[np.ndarray], bool]]:
        keys, *rest = columns
        yield kernel.merged([_low(32)(keys), *rest]) if strategy == "xor" else columns, True
        own = kernel.merged([keys >> 40 << 29 | _low(16)(keys) if strategy == "xor" else _low(16)(keys), *rest])
        del columns, keys, rest
        yield own, False
        for bits in (16, 8) if strategy == "xor" else (8,):
            own = kernel.merged([_low(bits)(own[0]), *own[1:]])
            yield own, False

    return run


def _second(strategy: str) -> Callable[[list[np.ndarray]], list[np.ndarray]]:
    """The second rarest level of the merged rarest one."""
    return lambda columns: [_low(24)(columns[0]), columns[1] * _SECOND[strategy], *columns[2:]]


def _counted(tokenised: DataFrame, strategy: str, id_col: str, finish: Callable[[list[np.ndarray]], dict[str, pa.Array]], fields: str, seen: bool = True) -> DataFrame:
    """Rows that ``finish`` makes of (context and token as one number, count, possibly when first seen)."""
    deep = _KERNELS[strategy][1]
    many = 1 << SORT_BITS

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[np.ndarray]]]:
        for ids, tokens, size in _token_slices(batches):
            place = _places(size)
            key = deep(_before(tokens, place)) << 8 | tokens
            if not seen:
                own = np.sort(key)
                first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]][: len(own)])
                yield (), [own[first], np.diff(np.r_[first, len(own)])]
                continue
            doc = ids.fill_null(kernel.NEVER).to_numpy(zero_copy_only=False)
            never = np.asarray(ids.is_null())
            start = np.cumsum(size) - size
            text = np.repeat(np.arange(len(size)), size)
            # Tokens by document and place, so that the first of equal keys was seen first.
            rows = None if (np.diff(doc) > 0).all() else np.lexsort((place, doc[text]))
            key = key if rows is None else key[rows]
            for at in range(0, len(key), many):
                own = np.sort(key[at : at + many] << SORT_BITS | np.arange(min(many, len(key) - at)))
                which, own = own & (many - 1), own >> SORT_BITS
                first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                where = which[first] + at
                where = where if rows is None else rows[where]
                t = text[where]
                yield (), [own[first], np.diff(np.r_[first, len(own)]), *kernel.seen(doc[t], np.where(never[t], kernel.NEVER, where - start[t]))]

    d = tokenised.select(F.col(id_col).cast("bigint").alias("id"), "tokens")
    return kernel.sums(d, partial, 8, finish, fields, bits=24, spread=_spread(strategy), follow=_second(strategy))


def corpus_counts(tokenised: DataFrame, strategy: str, id_col: str = "doc_id", least: int = 1, seen: bool = True) -> DataFrame:
    """``context_counts`` of the histories of whole texts; without ``seen`` only (ctx, tok, cnt)."""

    def finish(columns: list[np.ndarray]) -> dict[str, pa.Array]:
        key, cnt, *when = _least(columns, least)
        out = {"ctx": pa.array(key >> 8), "tok": pa.array((key & 255).astype(np.int32)), "cnt": pa.array(cnt)}
        if not when:
            return out
        doc, place = kernel.seen_at(when)
        never = place == kernel.NEVER
        return {**out, "doc": pa.array(doc, mask=never), "place": pa.array(place, mask=never)}

    if not seen:
        return _counted(tokenised, strategy, id_col, finish, "ctx bigint, tok int, cnt bigint", seen=False)
    out = _counted(tokenised, strategy, id_col, finish, "ctx bigint, tok int, cnt bigint, doc bigint, place bigint")
    return out.select("ctx", "tok", "cnt", _seen(F.col("doc"), F.col("place")).alias("first_seen"))


def _least(columns: list[np.ndarray], least: int) -> list[np.ndarray]:
    if least < 2 or not len(columns[0]):
        return columns
    ctx = columns[0] >> 8
    at = np.flatnonzero(np.r_[True, ctx[1:] != ctx[:-1]])
    keep = np.repeat(np.add.reduceat(columns[1], at) >= least, np.diff(np.r_[at, len(ctx)]))
    return [c[keep] for c in columns]


def merge_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """Counts of two corpora as one; the first corpus was seen before the second."""
    both = a.withColumn("part", F.lit(0)).unionByName(b.withColumn("part", F.lit(1)))
    return both.groupBy("ctx", "tok").agg(F.sum("cnt").alias("cnt"), F.min(F.struct("part", "first_seen")).alias("s")).select("ctx", "tok", "cnt", F.struct("s.part", "s.first_seen").alias("first_seen"))


def top2(counts: DataFrame) -> DataFrame:
    """(ctx, first, second): the two most frequent next tokens; ties go to the one seen first. A context has 254 rows at most."""
    ranked = counts.where("tok <> 0").withColumn("rk", F.row_number().over(W.partitionBy("ctx").orderBy(F.desc("cnt"), "first_seen"))).where("rk <= 2")
    pick = lambda k: F.max(F.when(F.col("rk") == k, F.col("tok")))
    return ranked.groupBy("ctx").agg(pick(1).alias("first"), pick(2).alias("second"))


def _best_two(cnt: np.ndarray, when: list[np.ndarray], size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the largest count and the next one of each group of rows; ties go to the one seen first, texts without an id before all."""
    if len(when) == 2:
        doc, place = when
        order = np.lexsort((place, np.where(place == kernel.NEVER, -kernel.NEVER, doc)))
        time = np.empty_like(order)
        new = (np.diff(doc[order]) != 0) | (np.diff(place[order]) != 0)
        time[order] = np.cumsum(np.r_[False, new])
    else:
        time = np.where(when[0] == kernel.NEVER, -1, when[0])
    at = np.cumsum(size) - size
    group = np.repeat(np.arange(len(size)), size)

    def best() -> np.ndarray:
        most = left == np.maximum.reduceat(left, at)[group]
        early = np.where(most, time, kernel.NEVER)
        found = np.flatnonzero(most & (early == np.minimum.reduceat(early, at)[group]))
        return found[np.r_[True, np.diff(group[found]) > 0]]

    left = cnt.copy()
    one = best()
    left[one] = -1
    return one, best()


def model(tokenised: DataFrame, strategy: str = "xor", id_col: str = "doc_id", least: int = 1) -> DataFrame:
    """``top2`` of a corpus. All tokens of a context meet in one bucket of the counts, where the two are found at once."""

    def finish(columns: list[np.ndarray]) -> dict[str, pa.Array]:
        key, cnt, *when = _least(columns, least)
        some = (key & 255) != 0
        if not some.all():
            key, cnt, *when = (c[some] for c in (key, cnt, *when))
        ctx = key >> 8
        at = np.flatnonzero(np.r_[True, ctx[1:] != ctx[:-1]][: len(ctx)])
        size = np.diff(np.r_[at, len(ctx)])
        first = np.full(len(at), -1, np.int64)
        second = first.copy()
        alone = size == 1
        first[alone] = key[at[alone]] & 255
        if not alone.all():  # contexts of several tokens
            rows = np.flatnonzero(np.repeat(~alone, size))
            one, two = _best_two(cnt[rows], [w[rows] for w in when], size[~alone])
            first[~alone], second[~alone] = key[rows[one]] & 255, key[rows[two]] & 255
        return {"ctx": pa.array(ctx[at]), "first": pa.array(first.astype(np.int32)), "second": pa.array(second.astype(np.int32), mask=second < 0)}

    return _counted(tokenised, strategy, id_col, finish, "ctx bigint, first int, second int")


def context_of(tokens: Column) -> Column:
    """The last eight tokens, oldest first, padded with zeros in front."""
    padded = F.concat(F.array_repeat(F.lit(0), 8), tokens)
    return F.slice(padded, F.size(padded) - 7, F.lit(8))


def _of_array(ctx: Column) -> Previous:
    return {k: F.get(ctx, F.lit(8 - k)) for k in range(1, 9)}


def _backed_off(ctx: Column, level: int) -> Previous:
    return {k: v if k <= 8 - level else F.lit(0) for k, v in _of_array(ctx).items()}


#: Contexts looked up in one call, at most, for them to be broadcast to the model.
MOST_CONTEXTS = 100_000


def predict(contexts: DataFrame, mod: DataFrame, strategy: str = "xor", ctx_col: str = "context", few: bool = False) -> DataFrame:
    """Contexts with ``best`` (-1 without an entry) and ``predictions`` (none, one or two tokens). ``few``: see ``predict_backoff``."""
    keyed = contexts.withColumn("ctx", STRATEGIES[strategy][0](_of_array(F.col(ctx_col))))
    if few:
        mod = mod.join(F.broadcast(keyed.select("ctx").distinct()), "ctx", "left_semi")
    both = F.when(F.col("first").isNull(), F.array().cast("array<int>")).when(F.col("second").isNull() | (F.col("second") == F.col("first")), F.array("first")).otherwise(F.array("first", "second"))
    return keyed.join(mod, "ctx", "left").select(*contexts.columns, F.coalesce("first", F.lit(-1)).alias("best"), both.alias("predictions"))


def backoff_keys(strategy: str = "xor", ctx_col: str = "context") -> Column:
    """(level, ctx) for all eight levels of a context."""
    return F.array(*(F.struct(F.lit(n).alias("level"), STRATEGIES[strategy][0](_backed_off(F.col(ctx_col), n)).alias("ctx")) for n in range(8)))


def predict_backoff(contexts: DataFrame, mod: DataFrame, key_cols: tuple[str, ...], strategy: str = "xor", ctx_col: str = "context", few: bool = False, keys: Column | None = None) -> DataFrame:
    """Contexts with the ``predictions`` of the longest history that the model has, and its ``level`` (0: all eight tokens).

    With ``few``, for at most ``MOST_CONTEXTS`` counted contexts, these are broadcast to the model, which isn't shuffled.
    ``keys`` may be given by callers that ask again and again (see ``backoff_keys``).
    """
    keys = backoff_keys(strategy, ctx_col) if keys is None else keys
    asked = contexts.select(*key_cols, F.inline(keys))
    asked = F.broadcast(asked) if few else asked
    hits = asked.join(mod, "ctx").groupBy(*key_cols).agg(F.min(F.struct("level", "first", "second")).alias("b"))
    both = F.when(F.col("b").isNull(), F.array().cast("array<int>")).when(F.col("b.second").isNull() | (F.col("b.second") == F.col("b.first")), F.array("b.first")).otherwise(F.array("b.first", "b.second"))
    return contexts.join(hits, list(key_cols), "left").select(*contexts.columns, F.col("b.level").alias("level"), both.alias("predictions"))


def generate(prompts: DataFrame, mod: DataFrame, vocab: Vocabulary, steps: int, key_cols: tuple[str, ...], strategy: str = "xor", text_col: str = "text") -> DataFrame:
    """(keys, generated): up to ``steps`` greedy tokens after each prompt, all prompts a step at a time."""
    if steps < 0:
        raise ValueError("the number of tokens can't be negative")
    state = tokenize_inference(prompts, vocab, key_cols, text_col).select(*key_cols, context_of(F.col("tokens")).alias("context"), F.lit("").alias("generated"), F.lit(True).alias("on"))
    state, own = cut(state), not mod.is_cached
    mod = mod.persist()
    few, keys, word = state.count() <= MOST_CONTEXTS, backoff_keys(strategy), vocab.text_of(F.col("tok"))
    for _ in range(steps):
        nxt = predict_backoff(state.where("on"), mod, key_cols, strategy, few=few, keys=keys).withColumn("tok", F.get("predictions", F.lit(0)))
        moved = nxt.select(
            *key_cols,
            F.when(word.isNull(), F.col("context")).otherwise(F.concat(F.slice("context", 2, 7), F.array("tok"))).alias("context"),
            F.concat("generated", F.coalesce(word, F.lit(""))).alias("generated"),
            word.isNotNull().alias("on"),
        )
        state = cut(moved.unionByName(state.where("not on")))
    if own:
        mod.unpersist()
    return state.select(*key_cols, "generated")


def predict_branches(prompts: DataFrame, mod: DataFrame, vocab: Vocabulary, max_branches: int, max_chars: int, key_cols: tuple[str, ...], strategy: str = "xor", text_col: str = "text") -> DataFrame:
    """(keys, n, branch): completions in the order in which a breadth-first search finishes them, from n = 0.

    A branch without prediction is finished if it has text, and that is not checked against ``max_branches``, so there
    may be more of them; the search of a prompt stops after a branch or a child that leaves enough finished ones.
    """
    if max_branches < 1 or max_chars < 1:
        raise ValueError("branches and characters must be at least 1")
    keys = list(key_cols)
    live = cut(tokenize_inference(prompts, vocab, key_cols, text_col).select(*keys, F.lit(0).cast("bigint").alias("ord"), context_of(F.col("tokens")).alias("context"), F.lit("").alias("text"), F.lit(0).cast("bigint").alias("before")))
    done, own = None, not mod.is_cached
    mod = mod.persist()
    keyed, word = backoff_keys(strategy), vocab.text_of(F.col("tok"))
    for _ in range(max_chars + 1):  # each token has a character at least
        found = predict_backoff(live, mod, (*key_cols, "ord"), strategy, few=live.count() <= MOST_CONTEXTS, keys=keyed)
        child = F.posexplode_outer(F.when(F.size("predictions") > 0, F.col("predictions")))
        grown = found.select(*keys, "ord", "context", "text", "before", F.size("predictions").alias("n_children"), child.alias("child", "tok"))
        grown = grown.withColumn("word", word).where(F.col("tok").isNull() | F.col("word").isNotNull())
        text = F.concat("text", F.coalesce("word", F.lit("")))
        ends = F.when(F.col("tok").isNull(), F.col("text") != "").otherwise(F.length(text) >= max_chars)
        order = W.partitionBy(*keys).orderBy("ord", F.coalesce("child", F.lit(0)))
        ev = grown.withColumn("new_text", F.substring(text, 1, max_chars)).withColumn("ends", ends)
        ev = ev.withColumn("total", F.col("before") + F.sum(F.col("ends").cast("bigint")).over(order)).withColumn("place", F.row_number().over(order).cast("bigint"))
        stops = F.col("tok").isNotNull() & (F.col("total") >= max_branches) & (F.col("ends") | (F.col("child") == F.col("n_children") - 1))
        ev = ev.withColumn("stop", F.min(F.when(stops, F.col("place"))).over(W.partitionBy(*keys)))
        ev = cut(ev.where(F.col("stop").isNull() | (F.col("place") <= F.col("stop"))))
        new = ev.where("ends").select(*keys, (F.col("total") - 1).alias("n"), F.col("new_text").alias("branch"))
        done = new if done is None else done.unionByName(new)
        last = ev.groupBy(*keys).agg(F.max("total").alias("after"), F.max(F.col("stop").isNotNull()).alias("over"))
        go = ev.where("not ends and tok is not null").join(last, keys).where(~F.col("over") & (F.col("after") < max_branches))
        live = cut(go.select(*keys, F.col("place").alias("ord"), F.concat(F.slice("context", 2, 7), F.array("tok")).alias("context"), F.col("new_text").alias("text"), F.col("after").alias("before")))
        if live.isEmpty():
            break
    if own:
        mod.unpersist()
    return done

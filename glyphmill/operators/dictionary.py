"""Word dictionary: counting, ordering, membership, prefix ranges and edit-distance search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphmill.functions import codec
from glyphmill.operators import kernel
from glyphmill.sources.storage import cut

#: Characters that end a word, as a regular expression on token text.
BREAK = f"[{codec.SEPARATOR}{codec.SENTENCE_END}\\{codec.NULL}]+"

#: Tokens of the pieces by which edit-distance search finds candidates, at least; distance up to which shorter queries are
#: found by deletion neighbourhoods (a word of eleven tokens has 232 of up to three).
PIECE, DELETIONS = 3, 3
#: Queries, at most, that are compared with all words of like length.
FEW = 256


def accepted(word: Column) -> Column:
    """False for words of long runs: four equal tokens in a row; three, where the word is short or has few distinct tokens."""
    run4, run3 = F.regexp_like(word, F.lit("(.)\\1{3}")), F.regexp_like(word, F.lit("(.)\\1{2}"))
    distinct = F.size(F.array_distinct(F.filter(F.split(word, ""), lambda c: c != "")))
    return ~(run4 | (run3 & ((F.length(word) <= 5) | (distinct <= 3))))


def words(docs: DataFrame, text_col: str = "text", by: tuple[str, ...] = ()) -> DataFrame:
    """One row (tt) for each word of each text, unchecked."""
    return docs.select(*by, F.explode(F.split(codec.stream(F.col(text_col)), BREAK)).alias("tt")).where("tt <> ''")


def word_counts(docs: DataFrame, text_col: str = "text", by: tuple[str, ...] = ()) -> DataFrame:
    """(tt, word, cnt) of accepted words. The predicate runs on distinct words, after the partial sums met."""
    counted = kernel.word_sums(docs.select(*by, F.col(text_col).alias("__text"))).groupBy(*by, "tt").agg(F.sum("cnt").alias("cnt"))
    return counted.where(accepted(F.col("tt"))).select(*by, "tt", codec.decode(F.col("tt")).alias("word"), "cnt")


def distinct_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(tt): each word of the texts once, unchecked."""
    return kernel.word_sums(docs.select(F.col(text_col).alias("__text"))).select("tt").distinct()


def merge_counts(*parts: DataFrame) -> DataFrame:
    """Counts of several corpora as one."""
    return reduce(DataFrame.unionByName, parts).groupBy("tt", "word").agg(F.sum("cnt").alias("cnt"))


def dictionary(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(idx, tt, word, length) in token order (see ``indexed``). The words, read three times there, go to the shared folder."""
    return indexed(cut(word_counts(docs, text_col).select("tt", "word")))


def indexed(found: DataFrame) -> DataFrame:
    """Number distinct words in token order by windows of bounded groups: prefixes of two tokens, of four, words.

    At most 64 * 65 prefixes of two tokens meet in one task, 4,161 of four under each of them, and then the words of a
    prefix of four tokens, a thousandth of a language's words or so.
    """
    all_before = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    start = F.substring("tt", 1, 4)
    fours = found.groupBy(start.alias("p4")).agg(F.count("*").alias("n")).withColumn("p2", F.substring("p4", 1, 2))
    twos = fours.groupBy("p2").agg(F.sum("n").alias("n")).select("p2", F.coalesce(F.sum("n").over(all_before(W.orderBy("p2"))), F.lit(0)).alias("a"))
    within = fours.withColumn("b", F.coalesce(F.sum("n").over(all_before(W.partitionBy("p2").orderBy("p4"))), F.lit(0)))
    offsets = within.join(twos, "p2").select("p4", (F.col("a") + F.col("b")).alias("before"))
    placed = found.withColumn("p4", start).join(offsets, "p4")
    idx = F.col("before") + F.row_number().over(W.partitionBy("p4").orderBy("tt")) - 1
    return placed.select(idx.cast("bigint").alias("idx"), "tt", "word", F.length("tt").cast("int").alias("length"))


def query_token_text(word: Column) -> Column:
    """Token text of a query word; unknown characters become UNKNOWN, which no dictionary word has."""
    return codec.encode_all(word)


def contains(queries: DataFrame, dic: DataFrame, word_col: str = "query") -> DataFrame:
    """Queries with ``found``."""
    q = queries.withColumn("tt", query_token_text(F.col(word_col)))
    return q.join(dic.select("tt", F.lit(True).alias("hit")), "tt", "left").select(*queries.columns, F.coalesce("hit", F.lit(False)).alias("found"))


def index_of(queries: DataFrame, dic: DataFrame, word_col: str = "query") -> DataFrame:
    """Queries with ``idx``, -1 where the word isn't in the dictionary."""
    q = queries.withColumn("tt", query_token_text(F.col(word_col)))
    return q.join(dic.select("tt", "idx"), "tt", "left").select(*queries.columns, F.coalesce("idx", F.lit(-1)).alias("idx"))


def unknown_words(queries: DataFrame, dic: DataFrame, word_col: str = "query") -> DataFrame:
    """Queries that aren't in the dictionary."""
    q = queries.withColumn("tt", query_token_text(F.col(word_col)))
    return q.join(dic.select("tt"), "tt", "left_anti").select(*queries.columns)


def prefix_ranges(queries: DataFrame, dic: DataFrame, word_col: str = "query") -> DataFrame:
    """Queries with the first index and the end (exclusive) of the words that share their first two tokens.

    Queries of one token range over the whole dictionary; without such words both are null.
    """
    q = queries.withColumn("tt", query_token_text(F.col(word_col)))
    spans = dic.where("length >= 2").groupBy(F.substring("tt", 1, 2).alias("px")).agg(F.min("idx").alias("first"), (F.max("idx") + 1).alias("last"))
    whole = dic.agg(F.min("idx").alias("a"), (F.max("idx") + 1).alias("b"))
    long = q.where("length(tt) >= 2").withColumn("px", F.substring("tt", 1, 2)).join(spans, "px", "left").select(*queries.columns, "first", "last")
    short = q.where("length(tt) < 2").join(F.broadcast(whole), F.lit(True)).select(*queries.columns, F.col("a").alias("first"), F.col("b").alias("last"))  # one row
    return long.unionByName(short)


def _in_prefix(asked: DataFrame, dic: DataFrame) -> DataFrame:
    """(q, tt, word, idx) for the words of the prefix range of each distinct query's token text q."""
    d = dic.select("tt", "word", "idx")
    long = asked.where("length(q) >= 2").withColumn("px", F.substring("q", 1, 2)).join(d.where("length(tt) >= 2").withColumn("px", F.substring("tt", 1, 2)), "px").drop("px")
    # Queries of a single token range over everything. They are distinct, so at most 64: a broadcast of that bound.
    short = d.crossJoin(F.broadcast(asked.where("length(q) = 1").select("q")))
    return long.unionByName(short.select(*long.columns))


def _shares_prefix() -> Column:
    return (F.length("q") < 2) | ((F.length("tt") >= 2) & (F.substring("q", 1, 2) == F.substring("tt", 1, 2)))


def closest(queries: DataFrame, dic: DataFrame, word_col: str = "query") -> DataFrame:
    """Queries with the ``closest`` word of their prefix range (least distance, then least index), or null, and ``dist``.

    Words of the dictionary are their own; then come words within two edits, by deletion neighbourhoods; only queries that
    have neither are compared with their whole range.
    """
    asked = cut(queries.select(query_token_text(F.col(word_col)).alias("q")).distinct())
    best = lambda pairs: pairs.groupBy("q").agg(F.min(F.struct("dist", "idx", "word")).alias("b")).select("q", F.col("b.word").alias("closest"), F.col("b.dist").alias("dist"))
    known = asked.join(dic.select(F.col("tt").alias("q"), F.col("word").alias("closest")), "q").withColumn("dist", F.lit(0))
    rest = asked.join(dic.select(F.col("tt").alias("q")), "q", "left_anti")
    near = cut(best(within_distance_all(rest, dic, 2, None).where(_shares_prefix())))
    far = best(_in_prefix(rest.join(near, "q", "left_anti"), dic).withColumn("dist", F.levenshtein("q", "tt")))
    q = queries.withColumn("q", query_token_text(F.col(word_col)))
    return q.join(known.unionByName(near).unionByName(far), "q", "left").select(*queries.columns, "closest", "dist")


def within_distance(queries: DataFrame, dic: DataFrame, limit: int, word_col: str = "query") -> DataFrame:
    """(columns of queries, word, idx, dist) for words of the prefix range nearer than ``limit``."""
    near = within_distance_all(queries if limit > 0 else queries.limit(0), dic, max(0, limit - 1), word_col).where(_shares_prefix())
    q = queries.withColumn("q", query_token_text(F.col(word_col)))
    return q.join(near, "q").select(*queries.columns, "word", "idx", "dist")


def _shorter(word: Column) -> Column:
    """The words that lack one token of a word."""
    without = lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word)))
    return F.when(word != "", F.transform(F.sequence(F.lit(1), F.greatest(F.length(word), F.lit(1))), without)).otherwise(F.array().cast("array<string>"))


def neighbourhood(word: Column, k: int) -> Column:
    """Fingerprints of a word with up to k tokens left out. Words within k edits have one in common."""

    def deeper(level: Column, left: int) -> Column:
        if not left:
            return level
        return codec.let(F.array_distinct(F.flatten(F.transform(level, _shorter))), lambda nxt: F.concat(level, deeper(nxt, left - 1)))

    return F.array_distinct(F.transform(codec.let(F.array(word), lambda own: deeper(own, k)), lambda w: F.xxhash64(w)))


def within_distance_all(queries: DataFrame, dic: DataFrame, limit: int, word_col: str | None = "query") -> DataFrame:
    """(q, tt, word, idx, dist) for words of the whole dictionary within ``limit`` (inclusive), by equi-joins.

    Distinct queries only; without ``word_col`` they have their token text in q already. A word within d edits of a query
    keeps one of the query's d + 1 pieces unchanged, at most d places away: long queries are filed under their pieces and
    words under their substrings at those places. Where pieces would be shorter than ``PIECE`` tokens, which nearly every
    word contains, words meet by what is left of them without up to d tokens, for d up to ``DELETIONS``. Beyond, such
    queries meet the words of like length; ``nearest`` asks that of the few queries only that have no nearer word.
    """
    q = (queries.select(query_token_text(F.col(word_col)).alias("q")) if word_col else queries.select("q")).distinct().where("q <> ''")
    q = cut(q)
    d = dic.select("tt", "word", "idx")
    parts = limit + 1
    n = F.length("q")
    if q.count() <= FEW:
        near = d.join(F.broadcast(q), F.abs(n - F.length("tt")) <= limit).withColumn("dist", F.levenshtein("q", "tt", limit))
        return near.where("dist >= 0").select("q", "tt", "word", "idx", "dist")
    cut_at = lambda k: F.floor(n * k / parts).cast("int")
    pieces = q.where(n >= parts * PIECE).select("q", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), n.alias("n"), (cut_at(k) + 1).alias("at"), (cut_at(k + 1) - cut_at(k)).alias("len"), F.substring("q", cut_at(k) + 1, cut_at(k + 1) - cut_at(k)).alias("piece")) for k in range(parts)))).alias("p")).select("q", "p.*")
    shapes = pieces.select("n", "at", "len").distinct()  # a few for each length of a query
    by_length = F.sequence(F.greatest(F.lit(1), F.length("tt") - limit), F.length("tt") + limit)
    words_by_n = d.select("tt", F.explode(by_length).alias("n"))
    places = F.sequence(F.greatest(F.lit(1), F.col("at") - limit), F.col("at") + limit)
    subs = words_by_n.join(shapes, "n").select("tt", "n", "at", "len", F.explode(places).alias("start")).select("tt", "n", "at", F.substring("tt", F.col("start"), F.col("len")).alias("piece"), "len").where(F.length("piece") == F.col("len")).distinct()
    cand = pieces.join(subs, ["n", "at", "len", "piece"]).select("q", "tt").distinct()
    few = q.where(n < parts * PIECE)
    if limit <= DELETIONS:
        asked = few.select("q", F.explode(neighbourhood(F.col("q"), limit)).alias("key"))
        told = d.where(F.length("tt") < parts * PIECE + limit).select("tt", F.explode(neighbourhood(F.col("tt"), limit)).alias("key"))
        short = asked.join(told, "key").where(F.abs(n - F.length("tt")) <= limit).select("q", "tt").distinct()
    else:
        short = few.withColumn("m", F.explode(F.sequence(F.greatest(F.lit(1), n - limit), n + limit))).join(d.select("tt", F.length("tt").alias("m")), "m").select("q", "tt")
    near = cand.unionByName(short).withColumn("dist", F.levenshtein("q", "tt", limit)).where("dist >= 0")
    return near.join(d, "tt").select("q", "tt", "word", "idx", "dist")


def nearest(queries: DataFrame, dic: DataFrame, limit: int, word_col: str = "query") -> DataFrame:
    """(q, words): the words at the least distance up to ``limit``, in dictionary order, for queries that have any.

    By rising distance: only queries without a word at one distance are asked for the next. What a round finds and what it
    leaves go to the shared folder.
    """
    rest = cut(queries.select(query_token_text(F.col(word_col)).alias("q")).distinct().where("q <> ''"))
    if rest.count() <= FEW:
        by_dist = within_distance_all(rest, dic, limit, None).groupBy("q", "dist").agg(F.array_sort(F.collect_list(F.struct("idx", "word"))).alias("w"))
        return by_dist.groupBy("q").agg(F.min_by("w", "dist").alias("w")).select("q", F.transform("w", lambda x: x["word"]).alias("words"))
    found = None
    for k in range(limit + 1):
        near = cut(within_distance_all(rest, dic, k, None).groupBy("q").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "word"))), lambda x: x["word"]).alias("words")))
        found = near if found is None else found.unionByName(near)
        rest = cut(rest.join(near, "q", "left_anti"))
        if rest.isEmpty():
            break
    return found


def within_distance_grouped(queries: DataFrame, dic: DataFrame, limit: int, word_col: str = "query") -> DataFrame:
    """(query, dist, words): for each query and distance up to ``limit`` the words at it, in dictionary order."""
    near = within_distance_all(queries, dic, limit, word_col).groupBy("q", "dist").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "word"))), lambda x: x["word"]).alias("words"))
    q = queries.withColumn("q", query_token_text(F.col(word_col)))
    return q.join(near, "q").select(*queries.columns, "dist", "words")


def spell_check(texts: DataFrame, dic: DataFrame, limit: int, id_cols: tuple[str, ...], text_col: str = "text") -> DataFrame:
    """(ids, word, start, end, length, recognised, corrections) for every word of the texts.

    Corrections are the words at the least distance up to ``limit``, for words that aren't recognised only.
    """
    from glyphmill.functions.markup import input_words

    if limit < 1:
        raise ValueError("the distance must be at least 1")
    w = texts.select(*id_cols, F.inline(input_words(F.col(text_col)))).withColumn("tt", query_token_text(F.col("word")))
    checked = w.join(dic.select("tt", F.lit(True).alias("hit")), "tt", "left").withColumn("recognised", F.coalesce("hit", F.lit(False))).drop("hit")
    misses = checked.where("not recognised").select(F.col("word").alias("query")).distinct()
    best = nearest(misses, dic, limit).withColumnRenamed("words", "near")
    none = F.array().cast("array<string>")
    out = checked.join(best.withColumnRenamed("q", "tt"), "tt", "left")
    return out.select(*id_cols, "word", "start", "end", (F.col("end") - F.col("start")).alias("length"), "recognised", F.when(F.col("recognised"), none).otherwise(F.coalesce("near", none)).alias("corrections"))


def ordering_violations(dic: DataFrame) -> DataFrame:
    """Words that are not greater than the word before them (none in a valid dictionary)."""
    before = dic.select((F.col("idx") + 1).alias("idx"), F.col("tt").alias("previous"))
    return dic.join(before, "idx").where("previous >= tt").select("idx", "previous", "tt")


def correct_sentence(texts: DataFrame, dic: DataFrame, id_cols: tuple[str, ...], text_col: str = "text") -> DataFrame:
    """Each word of a sentence replaced by its closest word, where there is one."""
    w = texts.select(*id_cols, F.posexplode(F.split(F.trim(F.regexp_replace(text_col, "\\s+", " ")), " ")).alias("pos", "query")).where("query <> ''")
    fixed = closest(w, dic)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("closest", "query").alias("w")))), lambda x: x["w"]), " ")
    return fixed.groupBy(*id_cols).agg(joined.alias("corrected"))

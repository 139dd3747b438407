"""Registry: one query for each operator of the engine over the driver's tables, and its DuckDB oracle.

What the prediction and lookup queries ask is trained once for each session and corpus: the vocabulary (254 entries on the
driver), the dictionary and the n-gram model (persisted). Queries about the training itself compute it anew.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions import codec, markup
from glyphmill.operators import dictionary as dic
from glyphmill.operators import kernel, ngram, vocabulary
from glyphmill.plans import bundle
from glyphmill.plans import oracles as o
from glyphmill.sources import formats
from glyphmill.sources.storage import work_dir

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}
_VOCABULARIES: dict[tuple, vocabulary.Vocabulary] = {}
_MODELS: dict[tuple, DataFrame] = {}

#: Prompts that the example programs of this kind of engine use.
EXAMPLE_TEXT = "I would like to walkX my dog!"
EXAMPLE_PROMPT = "i am the first one that "


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _ORACLES[name] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _corpus(spark: SparkSession, sf_dir: str) -> tuple:
    """Session, folder and state of its documents' files."""
    files = _docs(spark, sf_dir).select("_metadata.file_path", "_metadata.file_size", F.col("_metadata.file_modification_time").cast("string")).distinct()
    return (spark.sparkContext.applicationId, sf_dir, *sorted(map(tuple, files.collect())))


def _kept(kind: str, spark: SparkSession, sf_dir: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A trained model, persisted for the session: queries ask a model, they don't train it again unless the corpus changed."""
    k = (kind, *_corpus(spark, sf_dir))
    if k not in _MODELS:
        for old in [o for o in _MODELS if o[0] == kind and o[1:3] == k[1:3]]:
            _MODELS.pop(old).unpersist()
        _MODELS[k] = make().persist(StorageLevel.MEMORY_AND_DISK)
    return _MODELS[k]


def _dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept("words", spark, sf_dir, lambda: dic.dictionary(_docs(spark, sf_dir)))


def _vocab(spark: SparkSession, sf_dir: str) -> vocabulary.Vocabulary:
    k = _corpus(spark, sf_dir)
    if k not in _VOCABULARIES:
        _VOCABULARIES[k] = vocabulary.learn(_docs(spark, sf_dir))
    return _VOCABULARIES[k]


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.tokenize_training(_docs(spark, sf_dir), _vocab(spark, sf_dir))


def _model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept("contexts", spark, sf_dir, lambda: ngram.model(_tokens(spark, sf_dir)))


def _asked(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Distinct words of a table's texts, as queries."""
    return table(spark, sf_dir, name).select(F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}'-]+"), 0)).alias("query")).distinct()


# --- Text -----------------------------------------------------------------------------------------------------------


@query("normalize_text", o.select(o.STREAMS, "SELECT doc_id, tt AS token_text FROM s"))
def normalize_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", codec.stream(F.col("text")).alias("token_text"))


@query("decode_text", o.select(o.STREAMS, f"SELECT doc_id, {o.decode('tt')} AS plain FROM s"))
def decode_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", codec.decode(codec.stream(F.col("text"))).alias("plain"))


@query("encode_unknown", f"SELECT conv_id, turn, {o.encode_all('text')} AS token_text FROM conversations")
def encode_unknown(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", codec.encode_all(F.col("text")).alias("token_text"))


@query("seven_bit_encode", f"SELECT doc_id, regexp_replace(regexp_replace(text, '{o.WS}', ' ', 'g'), '[^ -~]', chr(127), 'g') AS seven FROM documents")
def seven_bit_encode(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", codec.seven_bit(F.col("text")).alias("seven"))


_SEVEN_SQL = f"""WITH s AS (SELECT doc_id, regexp_replace(regexp_replace(text, '{o.WS}', ' ', 'g'), '[^ -~]', chr(127), 'g') AS s FROM documents)
SELECT doc_id, replace(s, chr(127), '?') AS plain, length(s)::BIGINT AS n, (length(s) - length(replace(s, chr(127), '')))::BIGINT AS n_unknown,
 list_sum(list_transform(string_split(s, ''), lambda c: CASE WHEN c = '' THEN 0 WHEN c = chr(127) THEN 127 ELSE ascii(c) - 31 END))::BIGINT AS total FROM s"""


@query("seven_bit_decode", _SEVEN_SQL)
def seven_bit_decode(spark, sf_dir):
    return kernel.seven_bit(_docs(spark, sf_dir).select("doc_id", "text"))


@query("corpus_scan", "SELECT line, count(*) AS n FROM (SELECT unnest(string_split(html, chr(10))) AS line FROM pages) WHERE line <> '' GROUP BY line")
def corpus_scan(spark, sf_dir):
    """All pages written as text files in nested folders, found again by the recursive scan with its check of the encoding."""
    path = work_dir(spark, "corpus")
    pages = table(spark, sf_dir, "pages").withColumn("part", F.col("page_id") % 10).withColumn("half", F.col("page_id") % 2)
    pages.select("half", "part", "html").write.partitionBy("half", "part").text(path)
    found = formats.read_corpus(spark, path).where(F.col("path").endswith(".txt"))
    return found.select(F.explode(F.split("text", "\n")).alias("line")).where("line <> ''").groupBy("line").agg(F.count("*").alias("n"))


_MARKUP_SQL = """WITH t AS (SELECT page_id, 'dropped <doc id="' || page_id || '">' || html || '</doc> kept' AS t FROM pages),
p AS (SELECT page_id, regexp_extract_all(regexp_replace(t, '<[^>]*$', ''), '<[^>]*>|[^<]+') AS p FROM t),
f AS (SELECT page_id, p, list_position(list_transform(p, lambda x: starts_with(x, '<') AND starts_with(lower('<' || ltrim(substr(x, 2))), '<doc ')), true) AS st FROM p)
SELECT page_id, array_to_string(list_transform(list_slice(p, st, len(p)), lambda x: CASE WHEN starts_with(x, '<') AND starts_with(lower('<' || ltrim(substr(x, 2))), '<doc ') THEN ' ' WHEN starts_with(x, '<') THEN '' ELSE x END), '') AS plain FROM f"""


@query("strip_markup", _MARKUP_SQL)
def strip_markup(spark, sf_dir):
    wrapped = F.concat(F.lit('dropped <doc id="'), F.col("page_id").cast("string"), F.lit('">'), F.col("html"), F.lit("</doc> kept"))
    return table(spark, sf_dir, "pages").select("page_id", markup.strip_markup(wrapped).alias("plain"))


@query("latest_dump_date", "SELECT max(d) AS latest FROM (SELECT unnest(regexp_extract_all('<a href=\"' || strftime(o_orderdate, '%Y%m%d') || '/\">', 'href=\"(\\d{8})/\"', 1)) AS d FROM orders)")
def latest_dump_date(spark, sf_dir):
    index = F.concat(F.lit('<a href="'), F.date_format("o_orderdate", "yyyyMMdd"), F.lit('/">'))
    return table(spark, sf_dir, "orders").select(F.explode(markup.dump_dates(index)).alias("d")).agg(F.max("d").alias("latest"))


@query("article_dump", "SELECT page_id, 'wiki-' || page_id || '-pages-articles-multistream.xml.bz2' AS file FROM pages")
def article_dump(spark, sf_dir):
    page = F.concat(F.col("html"), F.lit('<a href="/dump/wiki-'), F.col("page_id").cast("string"), F.lit('-pages-articles-multistream.xml.bz2">'))
    return table(spark, sf_dir, "pages").select("page_id", markup.article_dump(page).alias("file"))


# --- Dictionary -----------------------------------------------------------------------------------------------------

_DICT = (o.STREAMS, o.WORDS, o.COUNTS, o.DICT)


@query("word_counts", o.select(o.STREAMS, o.WORDS, o.COUNTS, "SELECT tt, word, cnt FROM wc"))
def word_counts(spark, sf_dir):
    return dic.word_counts(_docs(spark, sf_dir))


@query("word_counts_by_lang", o.select(o.STREAMS, o.WORDS, f"SELECT lang, tt, {o.decode('tt')} AS word, count(*)::BIGINT AS cnt FROM w GROUP BY lang, tt HAVING {o.accepted('tt')}"))
def word_counts_by_lang(spark, sf_dir):
    return dic.word_counts(_docs(spark, sf_dir), by=("lang",))


@query("word_acceptance", o.select(o.STREAMS, o.WORDS, f"SELECT DISTINCT tt, {o.accepted('tt')} AS accepted FROM w"))
def word_acceptance(spark, sf_dir):
    return dic.distinct_words(_docs(spark, sf_dir)).select("tt", dic.accepted(F.col("tt")).alias("accepted"))


@query("word_dictionary", o.select(*_DICT, "SELECT * FROM d"))
def word_dictionary(spark, sf_dir):
    return dic.dictionary(_docs(spark, sf_dir))


@query("merge_counts", o.select(o.STREAMS, o.WORDS, f"SELECT tt, {o.decode('tt')} AS word, count(*)::BIGINT AS cnt FROM w GROUP BY tt HAVING {o.accepted('tt')}"))
def merge_counts(spark, sf_dir):
    d = _docs(spark, sf_dir)
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    return dic.merge_counts(dic.word_counts(d.where(english)), dic.word_counts(d.where(~english)))


_SWAPPED = "CASE idx % 1000 WHEN 0 THEN idx + 1 WHEN 1 THEN idx - 1 ELSE idx END"


@query("dictionary_ordering", o.select(*_DICT, f"SELECT idx, previous, tt FROM (SELECT idx, lag(tt) OVER (ORDER BY idx) AS previous, tt FROM (SELECT {_SWAPPED} AS idx, tt FROM d)) WHERE previous >= tt"))
def dictionary_ordering(spark, sf_dir):
    """Violations in a dictionary in which every thousandth word has changed places with the next."""
    return dic.ordering_violations(_dictionary(spark, sf_dir).withColumn("idx", F.expr(_SWAPPED)))


@query("dictionary_file", o.select(*_DICT, "SELECT * FROM d"))
def dictionary_file(spark, sf_dir):
    """The dictionary written as a binary file and read back with all checks."""
    path = work_dir(spark, "dictionary") + "/dictionary.bin"
    formats.write_dictionary(_dictionary(spark, sf_dir), path)
    return formats.read_dictionary(spark, path)


@query("dictionary_text_file", o.select(*_DICT, "SELECT idx + 1 AS line, word FROM d"))
def dictionary_text_file(spark, sf_dir):
    """Lines of the dictionary's text companion, in order."""
    path = work_dir(spark, "dictionary") + "/dictionary.bin"
    formats.write_dictionary(_dictionary(spark, sf_dir), path)
    return formats.read_lines(spark, path + ".txt").withColumnRenamed("value", "word")


@query("word_at", o.select(*_DICT, "SELECT DISTINCT item_id * 7 AS idx, word FROM benchmark JOIN d ON d.idx = item_id * 7"))
def word_at(spark, sf_dir):
    wanted = table(spark, sf_dir, "benchmark").select((F.col("item_id") * 7).alias("idx")).distinct()
    return wanted.join(_dictionary(spark, sf_dir), "idx").select("idx", "word")


@query("dictionary_contains", o.select(*_DICT, o.raw_words("conversations"), "SELECT query, d.tt IS NOT NULL AS found FROM q LEFT JOIN d ON d.tt = q.q"))
def dictionary_contains(spark, sf_dir):
    return dic.contains(_asked(spark, sf_dir, "conversations"), _dictionary(spark, sf_dir))


@query("dictionary_index_of", o.select(*_DICT, o.raw_words("conversations"), "SELECT query, coalesce(idx, -1) AS idx FROM q LEFT JOIN d ON d.tt = q.q"))
def dictionary_index_of(spark, sf_dir):
    return dic.index_of(_asked(spark, sf_dir, "conversations"), _dictionary(spark, sf_dir))


@query("unknown_words", o.select(*_DICT, o.raw_words("conversations"), "SELECT query FROM q WHERE q NOT IN (SELECT tt FROM d)"))
def unknown_words(spark, sf_dir):
    return dic.unknown_words(_asked(spark, sf_dir, "conversations"), _dictionary(spark, sf_dir))


@query("prefix_range", o.select(*_DICT, o.raw_words("benchmark"), "px AS (SELECT left(tt, 2) AS p, min(idx) AS first, max(idx) + 1 AS last FROM d WHERE length >= 2 GROUP BY p), al AS (SELECT min(idx) AS first, max(idx) + 1 AS last FROM d)", "SELECT query, px.first, px.last FROM q LEFT JOIN px ON px.p = left(q, 2) WHERE length(q) >= 2 UNION ALL SELECT query, first, last FROM q, al WHERE length(q) < 2"))
def prefix_range(spark, sf_dir):
    return dic.prefix_ranges(_asked(spark, sf_dir, "benchmark"), _dictionary(spark, sf_dir))


_PAIRS = "prs AS MATERIALIZED (SELECT query, q, d.*, levenshtein(q, d.tt)::INT AS dist FROM q JOIN d ON left(d.tt, 2) = left(q, 2) WHERE length(q) >= 2 AND d.length >= 2 UNION ALL SELECT query, q, d.*, levenshtein(q, d.tt)::INT FROM q, d WHERE length(q) = 1)"


@query("closest_word", o.select(*_DICT, o.raw_words("benchmark"), _PAIRS, "b AS (SELECT query, word, dist, row_number() OVER (PARTITION BY query ORDER BY dist, idx) AS rk FROM prs)", "SELECT q.query, b.word AS closest, b.dist FROM q LEFT JOIN b ON b.query = q.query AND rk = 1"))
def closest_word(spark, sf_dir):
    return dic.closest(_asked(spark, sf_dir, "benchmark"), _dictionary(spark, sf_dir))


@query("within_distance", o.select(*_DICT, o.raw_words("benchmark"), _PAIRS, "SELECT query, word, idx, dist FROM prs WHERE dist < 3"))
def within_distance(spark, sf_dir):
    return dic.within_distance(_asked(spark, sf_dir, "benchmark"), _dictionary(spark, sf_dir), 3)


_MISSES = "q0 AS MATERIALIZED (SELECT query, q FROM q WHERE q NOT IN (SELECT tt FROM d))"
_WORD = "[\\p{L}''-]+"
_EXAMPLE = f"t AS (SELECT 1::BIGINT AS item_id, '{EXAMPLE_TEXT}' AS text)"


def _near_sql(k: int, asked: str) -> str:
    return f"nr AS MATERIALIZED (SELECT * FROM (SELECT query, d.word, d.idx, levenshtein(q, d.tt)::INT AS dist FROM {asked} JOIN d ON d.length BETWEEN length(q) - {k} AND length(q) + {k}) WHERE dist <= {k})"


def _grouped_sql(source: str) -> str:
    return o.select(*_DICT, *([_EXAMPLE] if source == "t" else []), o.raw_words(source), _near_sql(3, "q"), "SELECT query, dist, array_to_string(list(word ORDER BY idx), ' ') AS words FROM nr GROUP BY query, dist")


def _grouped(spark, sf_dir, asked):
    return dic.within_distance_grouped(asked, _dictionary(spark, sf_dir), 3).select("query", "dist", F.array_join("words", " ").alias("words"))


@query("within_distance_grouped", _grouped_sql("t"))
def within_distance_grouped(spark, sf_dir):
    t = spark.createDataFrame([(EXAMPLE_TEXT,)], "text string")
    return _grouped(spark, sf_dir, t.select(F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}'-]+"), 0)).alias("query")).distinct())


@query("within_distance_grouped_benchmark", _grouped_sql("benchmark"))
def within_distance_grouped_benchmark(spark, sf_dir):
    return _grouped(spark, sf_dir, _asked(spark, sf_dir, "benchmark"))


def _spell_sql(source: str) -> str:
    words = f"tw AS (SELECT item_id, unnest(regexp_extract_all(text, '{_WORD}')) AS word, generate_subscripts(regexp_extract_all(text, '{_WORD}'), 1) AS k, string_split_regex(text, '{_WORD}') AS gaps FROM {source})"
    before = "sum(length(word)) OVER (PARTITION BY item_id ORDER BY k) - length(word) + length(array_to_string(gaps[1:k], ''))"
    places = f'ps AS MATERIALIZED (SELECT item_id, word, ({before})::INT AS "start" FROM tw)'
    nearest = "nst AS MATERIALIZED (SELECT query, array_to_string(list(word ORDER BY idx), ' ') AS words FROM (SELECT * FROM nr QUALIFY rank() OVER (PARTITION BY query ORDER BY dist) = 1) GROUP BY query)"
    out = f'SELECT item_id, ps.word, "start", ("start" + length(ps.word))::INT AS "end", length(ps.word)::INT AS length, q0.query IS NULL AS recognised, coalesce(nst.words, \'\') AS corrections'
    return o.select(*_DICT, *([_EXAMPLE] if source == "t" else []), o.raw_words(source), _MISSES, _near_sql(5, "q0"), nearest, words, places, f"{out} FROM ps LEFT JOIN q0 ON q0.query = ps.word LEFT JOIN nst ON nst.query = ps.word")


def _spelled(spark, sf_dir, texts, ids=("item_id",)):
    return dic.spell_check(texts, _dictionary(spark, sf_dir), 5, ids).withColumn("corrections", F.array_join("corrections", " "))


@query("spell_check", _spell_sql("t"))
def spell_check(spark, sf_dir):
    return _spelled(spark, sf_dir, spark.createDataFrame([(1, EXAMPLE_TEXT)], "item_id bigint, text string"))


@query("spell_check_benchmark", _spell_sql("benchmark"))
def spell_check_benchmark(spark, sf_dir):
    return _spelled(spark, sf_dir, table(spark, sf_dir, "benchmark").select("item_id", "text"))


_FIXED = (
    "pos AS (SELECT item_id, unnest(string_split_regex(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) AS query, generate_subscripts(string_split_regex(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), 1) AS k FROM benchmark)",
    f"q AS MATERIALIZED (SELECT DISTINCT query, {o.encode_all('query')} AS q FROM pos)",
    _PAIRS,
    "b AS MATERIALIZED (SELECT query, word FROM prs QUALIFY row_number() OVER (PARTITION BY query ORDER BY dist, idx) = 1)",
    "fx AS MATERIALIZED (SELECT item_id, string_agg(coalesce(word, query), ' ' ORDER BY k) AS corrected FROM pos LEFT JOIN b USING (query) GROUP BY item_id)",
)


@query("correct_sentence", o.select(*_DICT, *_FIXED, "SELECT * FROM fx"))
def correct_sentence(spark, sf_dir):
    return dic.correct_sentence(table(spark, sf_dir, "benchmark"), _dictionary(spark, sf_dir), ("item_id",))


@query("packed_dictionary_stats", o.select(*_DICT, "SELECT count(*) AS words, sum(ceil(length * 6 / 8.0))::BIGINT AS bytes, max(length) AS longest FROM d"))
def packed_dictionary_stats(spark, sf_dir):
    d = _dictionary(spark, sf_dir)
    return d.agg(F.count("*").alias("words"), F.sum(F.ceil(F.col("length") * 6 / 8)).cast("bigint").alias("bytes"), F.max("length").alias("longest"))


# --- Vocabulary -----------------------------------------------------------------------------------------------------

_GRAM = o.GRAMS.format


def _gram_query(n: int) -> None:
    @query(f"gram_counts_len{n}", o.select(o.STREAMS, _GRAM(a=n, b=n + 1), "SELECT len, gram, cnt FROM g"))
    def gram_counts(spark, sf_dir):
        return vocabulary.gram_counts(_docs(spark, sf_dir), [n]).select("len", codec.unpacked(F.col("packed")).alias("gram"), "cnt")


def _gram_digest_query(n: int) -> None:
    """Long n-grams are many: the counts of all of them, summed up by their first four characters."""

    @query(f"gram_counts_len{n}", o.select(o.STREAMS, _GRAM(a=n, b=n + 1), "SELECT len, left(gram, 4) AS start, count(*) AS n_grams, sum(cnt)::BIGINT AS total, sum(cnt * cnt)::BIGINT AS squares, min(gram) AS least FROM g GROUP BY ALL"))
    def gram_counts(spark, sf_dir):
        g = vocabulary.gram_counts(_docs(spark, sf_dir), [n])  # of one length, so packed values sort as n-grams
        g = g.groupBy("len", F.shiftright("packed", 6 * (n - 4)).alias("start")).agg(F.count("*").alias("n_grams"), F.sum("cnt").alias("total"), F.sum(F.col("cnt") * F.col("cnt")).alias("squares"), F.min("packed").alias("least"))
        return g.withColumn("start", codec.unpacked(F.col("start"))).withColumn("least", codec.unpacked(F.col("least")))


for _n in range(1, 6):
    _gram_query(_n)
for _n in range(6, 10):
    _gram_digest_query(_n)


@query("gram_stats", o.select(o.STREAMS, _GRAM(a=1, b=10), "SELECT len, count(*) AS n_grams, sum(cnt)::BIGINT AS total, max(cnt) AS most FROM g GROUP BY len"))
def gram_stats(spark, sf_dir):
    return vocabulary.gram_counts(_docs(spark, sf_dir)).groupBy("len").agg(F.count("*").alias("n_grams"), F.sum("cnt").alias("total"), F.max("cnt").alias("most"))


@query("gram_weights", o.select(o.STREAMS, _GRAM(a=1, b=10), f"SELECT len, {o.WEIGHT} AS w, count(*) AS n FROM g GROUP BY ALL"))
def gram_weights(spark, sf_dir):
    g = vocabulary.gram_counts(_docs(spark, sf_dir))
    return g.groupBy("len", vocabulary.weight(F.col("cnt"), F.col("len")).alias("w")).agg(F.count("*").alias("n"))


@query("gram_topk", o.select(o.STREAMS, _GRAM(a=1, b=10), "SELECT len, gram, cnt, rk::INT AS rk FROM (SELECT *, row_number() OVER (PARTITION BY len ORDER BY cnt DESC, gram) AS rk FROM g) WHERE rk <= 100"))
def gram_topk(spark, sf_dir):
    top = vocabulary.top_grams(vocabulary.gram_counts(_docs(spark, sf_dir)), 100)
    return top.select("len", codec.unpacked(F.col("packed")).alias("gram"), "cnt", "rk")


_VOC = (o.STREAMS, o.vocabulary())


@query("vocabulary", o.select(*_VOC, f"SELECT token, seq, {o.decode('seq')} AS text FROM v"))
def vocabulary_entries(spark, sf_dir):
    return _vocab(spark, sf_dir).frame(spark).select("token", "seq", "text")


@query("vocabulary_packed", o.select(*_VOC, f"SELECT token, list_reduce(list_transform(string_split(seq, ''), lambda c: (instr('{o.ALPHABET}', c) - 1)::BIGINT), lambda a, b: a * 64 + b) AS packed FROM v"))
def vocabulary_packed(spark, sf_dir):
    return _vocab(spark, sf_dir).frame(spark).select("token", codec.packed(F.col("seq")).alias("packed"))


@query("vocabulary_file", o.select(*_VOC, f"SELECT token, seq, list_reduce(list_transform(string_split(seq, ''), lambda c: (instr('{o.ALPHABET}', c) - 1)::BIGINT), lambda a, b: a * 64 + b) AS packed FROM v"))
def vocabulary_file(spark, sf_dir):
    """The vocabulary written as a binary file and read back."""
    path = work_dir(spark, "vocabulary") + "/vocabulary.bin"
    formats.write_vocabulary(_vocab(spark, sf_dir).entries, path)
    return formats.read_vocabulary(spark, path)


@query("merge_gram_counts", o.select(o.STREAMS, _GRAM(a=1, b=5), "SELECT len, gram, cnt FROM g"))
def merge_gram_counts(spark, sf_dir):
    """N-gram counts of two parts of the corpus, merged."""
    d, n = _docs(spark, sf_dir), range(1, 5)
    odd = F.coalesce(F.col("doc_id") % 2 == 1, F.lit(False))
    both = vocabulary.merge_counts(vocabulary.gram_counts(d.where(odd), n), vocabulary.gram_counts(d.where(~odd), n))
    return both.select("len", codec.unpacked(F.col("packed")).alias("gram"), "cnt")


def _by_lang_sql() -> str:
    parts = []
    for lang in ("de", "en", "es", "fr"):
        v = o.vocabulary()
        s = f"s AS MATERIALIZED (SELECT doc_id, {o.stream('text')} AS tt FROM documents WHERE lang = '{lang}')"
        parts.append("(" + o.select(s, v, f"SELECT '{lang}' AS lang, token, seq FROM v") + ")")
    return " UNION ALL ".join(f"SELECT * FROM {p}" for p in parts)


@query("vocabulary_by_lang", _by_lang_sql())
def vocabulary_by_lang(spark, sf_dir):
    found = vocabulary.learn_by(_docs(spark, sf_dir), "lang")
    rows = [(lang, t, s) for lang, v in found.items() for t, s in v.entries]
    return spark.createDataFrame(rows, "lang string, token int, seq string")


_TOK = (*_VOC, o.TOKENS)


@query("tokenize_training", o.select(*_TOK, "SELECT doc_id, string_agg(tok, ' ' ORDER BY pos) AS tokens FROM tk GROUP BY doc_id"))
def tokenize_training(spark, sf_dir):
    return _tokens(spark, sf_dir).where(F.size("tokens") > 0).select("doc_id", F.array_join(F.transform("tokens", lambda t: t.cast("string")), " ").alias("tokens"))


@query("tokenize_inference", o.select(*_VOC, f"pieces AS (SELECT conv_id, turn, regexp_extract_all({o.encode_all('text')}, (SELECT p FROM pat)) AS ps FROM conversations), vm AS (SELECT map_from_entries(list((seq, token))) AS mp FROM v)", "SELECT conv_id, turn, array_to_string(list_transform(ps, lambda x: mp[x]::VARCHAR), ' ') AS tokens FROM pieces, vm"))
def tokenize_inference(spark, sf_dir):
    t = vocabulary.tokenize_inference(table(spark, sf_dir, "conversations"), _vocab(spark, sf_dir), ("conv_id", "turn"))
    return t.select("conv_id", "turn", F.array_join(F.transform("tokens", lambda x: x.cast("string")), " ").alias("tokens"))


@query("token_frequency", o.select(*_TOK, "SELECT tok AS token, count(*) AS cnt FROM tk GROUP BY tok"))
def token_frequency(spark, sf_dir):
    return vocabulary.token_frequency(_tokens(spark, sf_dir))


# --- N-grams --------------------------------------------------------------------------------------------------------

_HIST = (*_TOK, o.HISTORY)


#: Models have millions of contexts: all of them enter sums, by the last two tokens.
_TOP2_SQL = "SELECT ctx % 65536 AS tail, count(*) AS contexts, sum(first)::BIGINT AS firsts, sum(second)::BIGINT AS seconds, sum((ctx // 65536 % 65521) * (first + 300 * coalesce(second, 255)))::BIGINT AS digest FROM m GROUP BY ALL"


def _model_digest(model: DataFrame) -> DataFrame:
    own = (F.floor(F.col("ctx") / 65536) % 65521) * (F.col("first") + 300 * F.coalesce("second", F.lit(255)))
    return model.groupBy((F.col("ctx") % 65536).alias("tail")).agg(F.count("*").alias("contexts"), F.sum("first").alias("firsts"), F.sum("second").alias("seconds"), F.sum(own).alias("digest"))


def _strategy_queries(name: str) -> None:
    @query(f"context_{name}", o.select(*_HIST, f"SELECT doc_id, count(*) AS n, sum({o.key(name)})::BIGINT AS total, count(DISTINCT {o.key(name)}) AS contexts FROM h GROUP BY doc_id"))
    def contexts(spark, sf_dir):
        return ngram.text_context_stats(_docs(spark, sf_dir), _vocab(spark, sf_dir), name)

    @query(f"ngram_counts_{name}", o.select(*_HIST, o.counts(name), "SELECT (ctx % 65536)::BIGINT AS tail, tok, count(*) AS contexts, sum(cnt)::BIGINT AS total FROM c GROUP BY ALL"))
    def counts(spark, sf_dir):
        c = ngram.corpus_counts(_tokens(spark, sf_dir), name, seen=False)
        return c.groupBy((F.col("ctx") % 65536).alias("tail"), "tok").agg(F.count("*").alias("contexts"), F.sum("cnt").alias("total"))

    @query(f"ngram_top2_{name}", o.select(*_HIST, o.counts(name), o.MODEL, _TOP2_SQL))
    def top2(spark, sf_dir):
        return _model_digest(ngram.model(_tokens(spark, sf_dir), name))


for _s in ("linear", "skipping", "xor"):
    _strategy_queries(_s)


@query("ngram_pruned", o.select(*_HIST, o.counts("xor", least=2), o.MODEL, _TOP2_SQL))
def ngram_pruned(spark, sf_dir):
    return _model_digest(ngram.model(_tokens(spark, sf_dir), "xor", least=2))


_MOD = (*_HIST, o.counts("xor"), o.MODEL)
_PROMPTS = o.prompts("benchmark", "item_id")


def _prompt_contexts(spark, sf_dir):
    """Contexts after the benchmark's texts, and whether they are few."""
    t = vocabulary.tokenize_inference(table(spark, sf_dir, "benchmark"), _vocab(spark, sf_dir), ("item_id",))
    return t.select("item_id", ngram.context_of(F.col("tokens")).alias("context")), table(spark, sf_dir, "benchmark").count() <= ngram.MOST_CONTEXTS


@query("predict", o.select(*_MOD, _PROMPTS, f"SELECT item_id, coalesce(m.first, -1) AS best FROM (SELECT item_id, {o.key('xor')} AS ctx FROM pr) LEFT JOIN m USING (ctx)"))
def predict(spark, sf_dir):
    contexts, few = _prompt_contexts(spark, sf_dir)
    return ngram.predict(contexts, _model(spark, sf_dir), few=few).select("item_id", "best")


@query("predict_all", o.select(*_MOD, _PROMPTS, f"SELECT item_id, concat_ws(' ', m.first, CASE WHEN m.second <> m.first THEN m.second END) AS predictions FROM (SELECT item_id, {o.key('xor')} AS ctx FROM pr) LEFT JOIN m USING (ctx)"))
def predict_all(spark, sf_dir):
    contexts, few = _prompt_contexts(spark, sf_dir)
    p = ngram.predict(contexts, _model(spark, sf_dir), few=few)
    return p.select("item_id", F.array_join(F.transform("predictions", lambda t: t.cast("string")), " ").alias("predictions"))


_BACKED = " UNION ALL ".join(f"SELECT item_id, {n} AS level, {o.key('xor', range(1, 9 - n))} AS ctx FROM {{src}}" for n in range(8))


@query("predict_backoff", o.select(*_MOD, _PROMPTS, f"bk AS ({_BACKED.format(src='pr')})", "hit AS (SELECT item_id, level, first, second FROM bk JOIN m USING (ctx) QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY level) = 1)", "SELECT item_id, level::INT AS level, concat_ws(' ', first, CASE WHEN second <> first THEN second END) AS predictions FROM pr LEFT JOIN hit USING (item_id)"))
def predict_backoff(spark, sf_dir):
    contexts, few = _prompt_contexts(spark, sf_dir)
    p = ngram.predict_backoff(contexts, _model(spark, sf_dir), ("item_id",), few=few)
    return p.select("item_id", "level", F.array_join(F.transform("predictions", lambda t: t.cast("string")), " ").alias("predictions"))


#: Tokens that the example program generates, branches and characters that it asks for.
GENERATED, BRANCHES, CHARACTERS = 75, 5, 10


@query("generate", o.select(*_MOD, _PROMPTS, o.generation(GENERATED), "SELECT item_id, arg_max(txt, step) AS generated FROM gen GROUP BY item_id", recursive=True))
def generate(spark, sf_dir):
    return ngram.generate(table(spark, sf_dir, "benchmark"), _model(spark, sf_dir), _vocab(spark, sf_dir), GENERATED, ("item_id",))


@query("correct_and_generate", o.select(*_DICT, *_FIXED, o.vocabulary(), o.TOKENS, o.HISTORY, o.counts("xor"), o.MODEL, o.prompts("fx", "item_id", "corrected"), o.generation(GENERATED), "SELECT item_id, corrected, generated FROM fx JOIN (SELECT item_id, arg_max(txt, step) AS generated FROM gen GROUP BY item_id) USING (item_id)", recursive=True))
def correct_and_generate(spark, sf_dir):
    models = bundle.LanguageModels(_dictionary(spark, sf_dir), _vocab(spark, sf_dir), _model(spark, sf_dir))
    return models.correct_and_generate(table(spark, sf_dir, "benchmark").select("item_id", "text"), GENERATED, ("item_id",))


def _branches_sql() -> str:
    asked = o.prompts(f"(SELECT item_id, text FROM benchmark UNION ALL SELECT -1, '{EXAMPLE_PROMPT}')", "item_id")
    parts, last = o.branches(BRANCHES, CHARACTERS)
    return o.select(*_MOD, asked, *parts, last)


@query("predict_branches", _branches_sql())
def predict_branches(spark, sf_dir):
    example = spark.createDataFrame([(-1, EXAMPLE_PROMPT)], "item_id bigint, text string")
    prompts = table(spark, sf_dir, "benchmark").select("item_id", "text").unionByName(example)
    return ngram.predict_branches(prompts, _model(spark, sf_dir), _vocab(spark, sf_dir), BRANCHES, CHARACTERS, ("item_id",))


@query("ngram_file", o.select(*_MOD, _TOP2_SQL))
def ngram_file(spark, sf_dir):
    """The model written as a binary file and read back, as a digest of all contexts."""
    path = work_dir(spark, "ngrams") + "/ngrams.bin"
    formats.write_ngrams(_model(spark, sf_dir), path)
    return _model_digest(formats.read_ngrams(spark, path))


@query("model_sizes", o.select(*_DICT, o.vocabulary(), o.TOKENS, o.HISTORY, o.counts("xor"), "SELECT (SELECT count(*) FROM d) AS words, (SELECT count(*) FROM v) AS entries, (SELECT count(DISTINCT ctx) FROM c) AS contexts"))
def model_sizes(spark, sf_dir):
    words = _dictionary(spark, sf_dir).agg(F.count("*").alias("words"))
    entries = _vocab(spark, sf_dir).frame(spark).agg(F.count("*").alias("entries"))
    contexts = _model(spark, sf_dir).agg(F.count("*").alias("contexts"))
    k = F.lit(1).alias("k")
    return words.select(k, "words").join(entries.select(k, "entries"), "k").join(contexts.select(k, "contexts"), "k").drop("k")


_IDENTITY_SQL = """SELECT 'words' AS model, count(*) AS entries, count(*) FILTER (idx % 100 = 0) AS differences FROM d
UNION ALL SELECT 'vocabulary', count(*), count(*) FILTER (token % 100 = 0) FROM v
UNION ALL SELECT 'contexts', count(*), count(*) FILTER (ctx % 100 = 0) FROM m"""


def _differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """How many rows of one the other lacks, both ways."""
    both = a.withColumn("n", F.lit(1)).unionByName(b.withColumn("n", F.lit(-1))).groupBy(*a.columns).agg(F.sum("n").alias("n"))
    return both.agg(F.coalesce(F.sum(F.abs("n")), F.lit(0)).alias("differences"))


@query("model_identity", o.select(*_DICT, o.vocabulary(), o.TOKENS, o.HISTORY, o.counts("xor"), o.MODEL, _IDENTITY_SQL))
def model_identity(spark, sf_dir):
    """Each model built again from rows in another order, without a hundredth of its entries, compared both ways."""
    again = _docs(spark, sf_dir).sortWithinPartitions(F.xxhash64("doc_id"))
    vocab = _vocab(spark, sf_dir)
    pairs = {
        "words": (_dictionary(spark, sf_dir), dic.dictionary(again), "idx"),
        "vocabulary": (vocab.frame(spark), vocabulary.learn(again).frame(spark), "token"),
        "contexts": (_model(spark, sf_dir), ngram.model(vocabulary.tokenize_training(again, vocab)), "ctx"),
    }
    rows = []
    for name, (a, b, key) in pairs.items():
        b = b.where(F.col(key) % 100 != 0)
        gap = _differences(a, b)
        rows.append(a.agg(F.lit(name).alias("model"), F.count("*").alias("entries")).crossJoin(gap))  # one row each
    return rows[0].unionByName(rows[1]).unionByName(rows[2])

import random

import pytest
from pyspark.sql import functions as F

from glyphmill.operators import dictionary as dic
from glyphmill.plans import catalog
from glyphmill.sources import formats
from glyphmill.streaming import ingest


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def words_of(df, column="word"):
    return [r[column] for r in df.orderBy("idx").collect()]


def test_words_and_order(spark):
    d = docs(spark, "don't A1b well-known où.", "z é a ab", None, "")
    assert words_of(dic.dictionary(d)) == ["a", "ab", "dont", "known", "o", "well", "z", "é"]
    counts = {r["word"]: r["cnt"] for r in dic.word_counts(d).collect()}
    assert counts["ab"] == 2
    assert dic.ordering_violations(dic.dictionary(d)).count() == 0


@pytest.mark.parametrize("word, ok", [("aaaa", False), ("aaab", False), ("abaaab", False), ("aabb", True), ("abcaaad", True), ("a", True)])
def test_acceptance(spark, word, ok):
    assert (dic.dictionary(docs(spark, word)).count() == 1) == ok


def test_lookup(spark):
    d = dic.dictionary(docs(spark, "cat car bat"))
    q = spark.createDataFrame([("cat",), ("Bat",), ("dog",), ("c1t",)], "query string")
    assert {r["query"]: r["found"] for r in dic.contains(q, d).collect()} == {"cat": True, "Bat": True, "dog": False, "c1t": False}
    assert {r["query"]: r["idx"] for r in dic.index_of(q, d).collect()} == {"cat": 2, "Bat": 0, "dog": -1, "c1t": -1}
    assert {r["query"] for r in dic.unknown_words(q, d).collect()} == {"dog", "c1t"}


def test_distances(spark):
    d = dic.dictionary(docs(spark, "cat car bat"))
    q = spark.createDataFrame([("cat",)], "query string")
    assert [r["word"] for r in dic.within_distance(q, d, 1).collect()] == ["cat"]
    assert dic.within_distance(q, d, 0).count() == 0
    grouped = {r["dist"]: r["words"] for r in dic.within_distance_grouped(q, d, 1).collect()}
    assert grouped == {0: ["cat"], 1: ["bat", "car"]}
    assert dic.closest(q, dic.dictionary(docs(spark, "bat"))).first()["closest"] is None
    assert dic.closest(q, dic.dictionary(docs(spark, "car cap"))).first()["closest"] == "cap"


@pytest.mark.parametrize("piece, few", [(1, 0), (3, 0), (3, 99)])
def test_pigeonhole_equals_all_pairs(spark, monkeypatch, piece, few):
    monkeypatch.setattr(dic, "PIECE", piece)
    monkeypatch.setattr(dic, "FEW", few)
    rng = random.Random(3)
    make = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 9)))
    d = dic.dictionary(docs(spark, " ".join(make() for _ in range(150))))
    q = spark.createDataFrame([(w,) for w in {make() for _ in range(30)}], "query string")
    for limit in (1, 2, 4):
        got = {tuple(r) for r in dic.within_distance_all(q, d, limit).select("q", "tt", "dist").collect()}
        want = q.select(dic.query_token_text(F.col("query")).alias("q")).join(d.select("tt"), F.lit(True)).withColumn("dist", F.levenshtein("q", "tt")).where(F.col("dist") <= limit)
        assert got == {tuple(r) for r in want.select("q", "tt", "dist").collect()}


def test_closest_equals_all_distances(spark, monkeypatch):
    monkeypatch.setattr(dic, "FEW", 0)
    rng = random.Random(4)
    make = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 12)))
    d = dic.dictionary(docs(spark, " ".join(make() for _ in range(80))))
    q = spark.createDataFrame([(w,) for w in {make() for _ in range(40)}], "query string")
    words = [(r["word"], r["idx"]) for r in d.collect()]
    for r in dic.closest(q, d).collect():
        own = [(slow_distance(r["query"], w), i, w) for w, i in words if len(r["query"]) < 2 or w[:2] == r["query"][:2]]
        assert (r["dist"], r["closest"]) == ((min(own)[0], min(own)[2]) if own else (None, None))


def test_spell_check(spark):
    d = dic.dictionary(docs(spark, "don't stop"))
    t = spark.createDataFrame([(1, "don't stop")], "id bigint, text string")
    got = {r["word"]: (r["recognised"], r["corrections"]) for r in dic.spell_check(t, d, 5, ("id",)).collect()}
    assert got == {"don't": (False, ["dont"]), "stop": (True, [])}
    with pytest.raises(ValueError):
        dic.spell_check(t, d, 0, ("id",))


def slow_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("few", [0, 256])
def test_whole_tables_are_spell_checked(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(dic, "FEW", few)
    rng = random.Random(15)
    make = lambda: "".join(rng.choice("abcd") for _ in range(rng.randint(2, 24)))
    docs(spark, " ".join(make() for _ in range(60)), None).write.parquet(str(tmp_path / "documents.parquet"))
    d = dic.dictionary(spark.read.parquet(str(tmp_path / "documents.parquet"))).orderBy("idx").collect()
    known = [r["word"] for r in d]
    texts = [(i, " ".join([make(), known[3 * i], known[i][:-1] + "d", make()])) for i in range(5)] + [(9, None), (10, "")]
    spark.createDataFrame(texts, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    q = catalog.queries()
    dist = {w: {k: slow_distance(w, k) for k in known} for _, t in texts for w in (t or "").split()}
    near = {(w, n, " ".join(k for k in known if by[k] == n)) for w, by in dist.items() for n in set(by.values()) if n <= 3}
    assert {tuple(r) for r in q["within_distance_grouped_benchmark"](spark, str(tmp_path)).collect()} == near
    want = []
    for i, t in texts:
        at = 0
        for w in (t or "").split():
            least = min(dist[w].values())
            fix = " ".join(k for k in known if dist[w][k] == least) if 0 < least <= 5 else ""
            want.append((i, w, at, at + len(w), len(w), least == 0, fix))
            at += len(w) + 1
    assert sorted(tuple(r) for r in q["spell_check_benchmark"](spark, str(tmp_path)).collect()) == sorted(want)


def test_empty(spark):
    d = dic.dictionary(docs(spark).limit(0))
    assert d.count() == 0


def test_dictionary_file(spark, tmp_path):
    d = dic.dictionary(docs(spark, "z é a ab known"))
    path = str(tmp_path / "words.bin")
    formats.write_dictionary(d, path)
    assert sorted(map(tuple, formats.read_dictionary(spark, path).collect())) == sorted(map(tuple, d.collect()))
    assert (tmp_path / "words.bin.txt").read_text().split() == ["a", "ab", "known", "z", "é"]
    (tmp_path / "bad.bin").write_bytes(b"nonsense")
    with pytest.raises(Exception, match="not a model file"):
        formats.read_dictionary(spark, str(tmp_path / "bad.bin")).collect()


def test_streaming_counts(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in ("a b a", "b c"):
        docs(spark, part).coalesce(1).write.mode("append").parquet(src)
        ingest.count_words(spark, src, out, str(tmp_path / "check")).awaitTermination(60)
    assert {r["word"]: r["cnt"] for r in ingest.counts(spark, out).collect()} == {"a": 2, "b": 2, "c": 1}

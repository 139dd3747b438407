"""The Arrow and NumPy kernels against the column expressions of the same operators and plain restatements."""

import random
import re
import string
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glyphmill.functions import codec
from glyphmill.operators import dictionary, kernel, ngram, vocabulary
from glyphmill.plans import catalog
from glyphmill.sources import formats

RNG = random.Random(5)
ODD = ["", " ", "a \t b", "x\0\0y", "É-ß_œ, .", "日本 😀 text￿", "a § b", "\u001c .", "- -,_ .. "]
TEXTS = ODD + ["".join(RNG.choice("abé, .\n-§") for _ in range(RNG.randint(0, 900))) for _ in range(20)] + [None]


def docs(spark, texts=TEXTS):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def split(data, size):
    text = "".join(codec.ALPHABET[c] for c in data.tolist())
    ends = np.cumsum(size).tolist()
    return [text[e - n : e] for e, n in zip(ends, size.tolist())]


def test_codes(spark):
    d = docs(spark).orderBy("doc_id")
    rows = d.select(codec.stream(F.col("text")).alias("s"), codec.encode_all(F.coalesce("text", F.lit(""))).alias("r")).collect()
    texts = pa.array(TEXTS, pa.string())
    assert split(*kernel.stream_codes(texts)) == [r["s"] for r in rows]
    assert split(*kernel.stream_codes(texts, single=True)) == [re.sub("Q+", "Q", r["s"]) for r in rows]
    assert split(*kernel.raw_codes(texts)) == [r["r"] for r in rows]


def test_matcher():
    for _ in range(60):
        seqs = sorted({"".join(RNG.choice("01Qy") for _ in range(RNG.choice([1, 2, 3, 5, 9, 12]))) for _ in range(RNG.randint(1, 30))})
        ids = {s: i + 1 for i, s in enumerate(seqs)}
        texts = ["".join(RNG.choice("01Qy") for _ in range(RNG.choice([0, 1, 255, 256, 257, 512, 700]))) for _ in range(4)]
        data = np.array([codec.ALPHABET.index(c) for t in texts for c in t], np.uint8)
        tokens, size = kernel.Matcher([(i, s) for s, i in ids.items()])(data, np.array([len(t) for t in texts]))
        pattern = "|".join(sorted(seqs, key=lambda s: (-len(s), s)))
        want = [[ids[p] for p in re.findall(pattern, t)] for t in texts]
        assert size.tolist() == [len(w) for w in want] and tokens.tolist() == [t for w in want for t in w]


def test_words(spark):
    got = {(r["tt"], r["word"]): r["cnt"] for r in dictionary.word_counts(docs(spark)).collect()}
    rows = dictionary.words(docs(spark)).groupBy("tt").agg(F.count("*").alias("cnt")).where(dictionary.accepted(F.col("tt")))
    assert got == {(r["tt"], r["word"]): r["cnt"] for r in rows.select("tt", codec.decode(F.col("tt")).alias("word"), "cnt").collect()} and got
    by = docs(spark).withColumn("lang", F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") % 3))
    total = dictionary.word_counts(by, by=("lang",)).groupBy("tt").agg(F.sum("cnt").alias("cnt")).collect()
    assert {r["tt"]: r["cnt"] for r in total} == {tt: n for (tt, _), n in got.items()}


def test_packed_sums():
    parts = []
    for _ in range(3):
        keys = np.unique(np.array([RNG.randint(0, 1 << 54) for _ in range(50)] + [7, 1 << 40], np.int64))
        parts.append([keys, np.ones(len(keys), np.int64), keys % 5, keys % 3])
    packed = [kernel._unpacked(kernel._packed(p), len(p[0]), 4) for p in parts]
    assert all((a == b).all() for p, q in zip(parts, packed) for a, b in zip(p, q))
    one = kernel.merged([np.concatenate([p[i] for p in parts]) for i in range(4)])
    want = Counter(k for p in parts for k in p[0].tolist())
    assert dict(zip(one[0].tolist(), one[1].tolist())) == want and (np.diff(one[0]) > 0).all()


def key_rows(df):
    return {r["doc_id"]: (r["n"], r["total"], r["contexts"]) for r in df.collect()}


@pytest.mark.parametrize("strategy", ["linear", "skipping", "xor"])
def test_contexts_and_counts(spark, strategy):
    """Also ids of several texts, texts without id, in any order."""
    rows = [(i, [RNG.randint(1, 9) for _ in range(RNG.randint(0, 40))]) for i in [9, 3, 3, 7, 1, None, None, 5, 3]] + [(20, None), (21, [])]
    tok = spark.createDataFrame(rows, "doc_id bigint, tokens array<int>")
    hist = ngram.histories(tok)
    slow = ngram.context_keys(hist, strategy).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("ctx").alias("total"), F.countDistinct("ctx").alias("contexts"))
    assert key_rows(ngram.context_stats(tok, strategy)) == key_rows(slow)
    for least in (1, 3):
        counts = ngram.context_counts(hist, strategy, least=least)
        assert {tuple(r) for r in ngram.corpus_counts(tok, strategy, least=least).collect()} == {tuple(r) for r in counts.collect()}
        known = tok.where("doc_id <> 3")  # of tokens first seen at one place of one id either may win
        assert {tuple(r) for r in ngram.model(known, strategy, least=least).collect()} == {tuple(r) for r in ngram.top2(ngram.context_counts(ngram.histories(known), strategy, least=least)).collect()}


def test_tokens_must_be_bytes(spark):
    with pytest.raises(Exception, match="from 0 to 255"):
        ngram.model(spark.createDataFrame([(0, [256])], "doc_id bigint, tokens array<int>")).collect()


def test_seven_bit(spark):
    d = docs(spark)
    t = d.select("doc_id", codec.seven_bit_tokens(F.col("text")).alias("t"))
    want = t.select("doc_id", codec.seven_bit_text(F.col("t")).alias("plain"), F.size("t").cast("bigint").alias("n"), F.size(F.filter("t", codec.is_unknown)).cast("bigint").alias("u"), F.aggregate("t", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("s"))
    assert sorted(map(tuple, kernel.seven_bit(d).collect())) == sorted(map(tuple, want.collect()))


def test_files_in_pieces(spark, tmp_path, monkeypatch):
    rows = [(RNG.randrange(1 << 32), RNG.randint(1, 254), RNG.choice([None, 1, 254])) for _ in range(500)]
    formats.write_ngrams(spark.createDataFrame(rows, "ctx bigint, first int, second int"), str(tmp_path / "n.bin"))
    data = (tmp_path / "n.bin").read_bytes()
    signed = [int.from_bytes(data[i : i + 4], "big", signed=True) for i in range(8, len(data), 6)]
    assert len(data) == 8 + 6 * 500 and signed == sorted(signed)
    monkeypatch.setattr(formats, "PIECE", 64)
    got = formats.read_ngrams(spark, str(tmp_path / "n.bin"))
    assert Counter(map(tuple, got.collect())) == Counter(rows)
    lines = ["".join(RNG.choice(string.ascii_lowercase) for _ in range(RNG.randint(1, 9))) for _ in range(300)]
    (tmp_path / "w.txt").write_text("".join(w + "\n" for w in lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        assert sorted(map(tuple, formats.read_lines(spark, str(tmp_path / "w.txt")).collect())) == [(i + 1, w) for i, w in enumerate(lines)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_identity_counts_repeated_rows(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (3, "z")], "k int, v string")
    assert catalog._differences(a, b).first()[0] == 3 == a.exceptAll(b).unionByName(b.exceptAll(a)).count()


@pytest.mark.parametrize("strategy", ["linear", "skipping", "xor"])
def test_levels_follow_from_one_key(strategy):
    """F8, F9, F13 to F15: a task sorts its tokens once; the counts of all levels come from those sums."""
    p = {k: np.array([RNG.choice([0, 0, 1, 7, 8, 15, 200, 254]) for _ in range(3_000)], np.int64) for k in range(1, 9)}
    tok = np.array([RNG.choice([1, 2, 254]) for _ in range(3_000)], np.int64)
    when = [np.arange(3_000) << 31]
    deep = ngram._KERNELS[strategy][1](p) << 8 | tok
    parts = list(ngram._spread(strategy)(kernel.merged([deep, np.ones(3_000, np.int64), *when])))
    assert all((np.diff(x[0]) > 0).all() for x, _ in parts) and [more for _, more in parts][:2] == [True, False]
    got = kernel._joined([*(x for x, _ in parts), ngram._second(strategy)(parts[0][0])])
    kept = {"linear": [(range(1, n + 1), 1) for n in (4, 3, 2, 1)], "skipping": [((7, 4, 2, 1), 1), ((4, 2, 1), 1), ((2, 1), 1), ((1,), 1)], "xor": [((1,), 1), ((1, 2), 1), ((1, 2, 3), 1), ((1, 2, 3, 4), 3), (range(1, 9), 1)]}
    levels = [(ngram._KERNELS[strategy][0]({k: v if k in own else v * 0 for k, v in p.items()}), w) for own, w in kept[strategy]]
    want = kernel.merged([np.concatenate([ctx << 8 | tok for ctx, _ in levels]), np.concatenate([np.full(3_000, w) for _, w in levels]), np.concatenate([when[0]] * len(levels))])
    assert all((a == b).all() for a, b in zip(got, want, strict=True))


def test_ids_of_any_size(spark):
    """Ids that one number with a place can't hold, beside ones it can, null ids and counts without places."""
    rows = [(i, [RNG.randint(1, 4) for _ in range(RNG.randint(0, 30))]) for i in [5, -3, 1 << 40, (1 << 32) - 1, (1 << 32) - 2, 0, None, -(1 << 62), 8, 2, 1, 77]]
    tok = spark.createDataFrame(rows, "doc_id bigint, tokens array<int>").repartition(5)
    hist = ngram.histories(tok)
    for strategy in ("linear", "xor"):
        counts = ngram.context_counts(hist, strategy)
        assert {tuple(r) for r in ngram.corpus_counts(tok, strategy).collect()} == {tuple(r) for r in counts.collect()}
        assert {tuple(r) for r in ngram.corpus_counts(tok, strategy, seen=False).collect()} == {tuple(r)[:3] for r in counts.collect()}
        assert {tuple(r) for r in ngram.model(tok, strategy).collect()} == {tuple(r) for r in ngram.top2(counts).collect()}


def test_few_contexts_meet_the_model(spark):
    """F16, F17: few contexts are sent to the model, which isn't shuffled, with the same predictions."""
    tok = spark.createDataFrame([(i, [RNG.randint(1, 5) for _ in range(40)]) for i in range(8)], "doc_id bigint, tokens array<int>")
    asked = tok.select("doc_id", ngram.context_of(F.slice("tokens", 1, F.col("doc_id").cast("int") + 1)).alias("context")).unionByName(spark.createDataFrame([(9, [9] * 8)], "doc_id bigint, context array<int>"))
    mod = ngram.model(tok)
    every, few = (ngram.predict(asked, mod, few=f).orderBy("doc_id").collect() for f in (False, True))
    assert every == few and {r["best"] for r in every} > {-1}


@pytest.mark.parametrize("strategy", ["linear", "skipping", "xor"])
def test_contexts_in_one_pass(spark, strategy):
    """texts become context statistics in one pass of Python, also ids of several texts and texts without id."""
    d = docs(spark).select(F.when(F.col("doc_id") % 7 > 0, F.col("doc_id") % 23).alias("doc_id"), "text")
    v = vocabulary.learn(docs(spark))
    once = docs(spark)
    for own in (d, once):
        assert key_rows(ngram.text_context_stats(own, v, strategy)) == key_rows(ngram.context_stats(vocabulary.tokenize_training(own, v), strategy))
    hist = ngram.histories(vocabulary.tokenize_training(once, v))
    slow = ngram.context_keys(hist, strategy).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("ctx").alias("total"), F.countDistinct("ctx").alias("contexts"))
    got = ngram.text_context_stats(once, v, strategy)
    assert key_rows(got) == key_rows(slow)

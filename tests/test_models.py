"""Vocabulary and n-gram model against plain restatements."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmill.functions import codec
from glyphmill.operators import ngram, vocabulary
from glyphmill.operators.vocabulary import Vocabulary
from glyphmill.sources import archive, formats

RNG = random.Random(11)
TEXTS = ["".join(RNG.choice("abc, .") for _ in range(RNG.randint(0, 60))) for _ in range(25)] + ["", "a, b", "the cat the cat the car"]


def docs(spark, texts=TEXTS):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def streams(spark, texts=TEXTS):
    return [r[0] for r in docs(spark, texts).orderBy("doc_id").select(codec.stream(F.col("text"))).collect()]


def test_gram_counts(spark):
    want = Counter((n, s[i : i + n]) for s in streams(spark) for n in range(1, 10) for i in range(len(s) - n + 1))
    got = vocabulary.gram_counts(docs(spark)).select("len", codec.unpacked(F.col("packed")).alias("g"), "cnt").collect()
    assert {(r["len"], r["g"]): r["cnt"] for r in got} == want


def test_weights(spark):
    w = spark.range(1).select(vocabulary.weight(F.lit(1), F.lit(1)).alias("a"), vocabulary.weight(F.lit(100), F.lit(2)).alias("b")).first()
    assert (w["a"], w["b"]) == (1, 5)


def test_selection_equals_greedy_loop(spark):
    cand = vocabulary.candidates(vocabulary.gram_counts(docs(spark), range(2, 10)))
    rows = sorted(cand.collect(), key=lambda r: (-r["w"], -r["cnt"], r["len"], r["gram"]))
    chosen = []
    for r in rows:
        if len(chosen) == vocabulary.SIZE - vocabulary.CHARACTERS:
            break
        if not any(len(c) > len(r["gram"]) and r["gram"] in c for c in chosen):
            chosen.append(r["gram"])
    got = [r["gram"] for r in vocabulary.select_entries(cand, pool=64).orderBy("rk").collect()]
    assert got == chosen


def greedy(tt, entries):
    out, i = [], 0
    ids = {s: t for t, s in entries}
    while i < len(tt):
        for n in range(min(10, len(tt) - i), 0, -1):
            if tt[i : i + n] in ids:
                out.append(ids[tt[i : i + n]])
                i += n
                break
        else:
            i += 1
    return out


def test_tokenisers(spark):
    v = Vocabulary(((1, "0"), (2, "1"), (27, "Q"), (50, "01")))
    d = docs(spark, ["a1b", "a, b", "abba", None])
    run = lambda f: {r["doc_id"]: r["tokens"] for r in f.collect()}
    train, infer = run(vocabulary.tokenize_training(d, v)), run(vocabulary.tokenize_inference(d, v, ("doc_id",)))
    assert train[0][1:-1] == [50] and infer[0] == [1, 2]
    assert train[1][1:-1] == [1, 27, 2] and infer[1] == [1, 27, 27, 2]
    assert infer[3] == []
    full = vocabulary.learn(docs(spark))
    got = run(vocabulary.tokenize_training(docs(spark), full))
    for i, s in enumerate(streams(spark)):
        import re

        assert got[i] == greedy(re.sub("Q+", "Q", s), full.entries)


def rotate(*ts):
    r = 0
    for t in ts:
        r = (r << 5) ^ t
    return r & 0xFF


def xor_key(p):
    if p[2] == 0:
        b = (0, 0, 0)
    elif p[3] == 0:
        b = (0, 0, p[2])
    elif p[4] == 0:
        b = (0, rotate(p[3], 0), p[2])
    elif p[5] == 0:
        b = (0, rotate(p[3], p[4]), p[2])
    elif p[7] == 0:
        b = (rotate(p[6], 0, 0), rotate(p[3], p[4]), p[2])
    elif p[8] == 0:
        b = (rotate(p[6], p[7], 0), rotate(p[3], p[4]), p[2])
    else:
        b = (rotate(p[6], p[7], p[8]), rotate(p[3], p[4]), p[2])
    return b[0] << 24 | b[1] << 16 | b[2] << 8 | p[1]


def test_keys(spark):
    rows = [tuple(range(1, 9))] + [tuple(RNG.choice([0, 0, 1, 7, 8, 200, 254]) for _ in range(8)) for _ in range(300)]
    d = spark.createDataFrame(rows, ", ".join(f"p{k} int" for k in range(1, 9)))
    p = {k: F.col(f"p{k}") for k in range(1, 9)}
    got = d.select("*", ngram.xor(p).alias("x"), ngram.linear(p).alias("l"), ngram.skipping(p).alias("s")).collect()
    assert [got[0]["x"].to_bytes(4, "big"), got[0]["l"].to_bytes(4, "big"), got[0]["s"].to_bytes(4, "big")] == [bytes([232, 100, 2, 1]), bytes([4, 3, 2, 1]), bytes([7, 4, 2, 1])]
    for r in got:
        assert r["x"] == xor_key({k: r[f"p{k}"] for k in range(1, 9)})


def reference_model(sequences):
    counts = defaultdict(dict)
    for seq in sequences:
        for i, tok in enumerate(seq):
            p = {k: seq[i - k] if i >= k else 0 for k in range(1, 9)}
            for kept in ([1], [1, 2], [1, 2, 3], [1, 2, 3, 4], [1, 2, 3, 4, 6], [1, 2, 3, 4, 6, 7], range(1, 9)):
                own = counts[xor_key({k: v if k in kept else 0 for k, v in p.items()})]
                own[tok] = own.get(tok, 0) + 1
    out = {}
    for ctx, own in counts.items():
        best = sorted(own, key=lambda t: -own[t])  # stable: first seen first
        out[ctx] = (best[0], best[1] if len(best) > 1 else None)
    return out


def back_off(model, ctx):
    """ctx: p1 first."""
    for n in range(8):
        hit = model.get(xor_key({k: ctx[k - 1] if k <= 8 - n else 0 for k in range(1, 9)}))
        if hit:
            return [hit[0]] + ([hit[1]] if hit[1] not in (None, hit[0]) else [])
    return []


def branches(model, text_of, ctx, most, chars):
    live, done = [(ctx, "")], []
    while live and len(done) < most:
        nxt = []
        for c, text in live:
            found = back_off(model, c)
            if not found:
                if text:
                    done.append(text)
                continue
            for t in found:
                if t not in text_of:
                    continue
                new = text + text_of[t]
                if len(new) >= chars:
                    done.append(new[:chars])
                    if len(done) >= most:
                        break
                    continue
                nxt.append(([t] + c[:7], new))
            if len(done) >= most:
                break
        live = nxt
    return done


def test_model_prediction_and_search(spark):
    d = docs(spark)
    v = vocabulary.learn(d)
    tok = vocabulary.tokenize_training(d, v)
    seqs = [r["tokens"] for r in tok.orderBy("doc_id").collect()]
    want = reference_model(seqs)
    mod = ngram.model(tok)
    assert {r["ctx"]: (r["first"], r["second"]) for r in mod.collect()} == want
    plain = str.maketrans(codec.DECODE_FROM, codec.DECODED)
    text_of = {t: s.translate(plain) for t, s in v.entries}
    prompts = spark.createDataFrame([(i, t) for i, t in enumerate(["", "the cat ", "a, b", "zzz", "cab c"])], "item_id bigint, text string")
    ctxs = {r["item_id"]: r["c"] for r in vocabulary.tokenize_inference(prompts, v, ("item_id",)).select("item_id", ngram.context_of(F.col("tokens")).alias("c")).collect()}
    generated = {r["item_id"]: r["generated"] for r in ngram.generate(prompts, mod, v, 4, ("item_id",)).collect()}
    for i, c in ctxs.items():
        p, text = c[::-1], ""
        for _ in range(4):
            found = back_off(want, p)
            if not found:
                break
            p, text = [found[0]] + p[:7], text + text_of[found[0]]
        assert generated[i] == text
    for most, chars in ((5, 10), (2, 3)):
        got = defaultdict(list)
        for r in sorted(ngram.predict_branches(prompts, mod, v, most, chars, ("item_id",)).collect(), key=lambda r: r["n"]):
            got[r["item_id"]].append(r["branch"])
        for i, c in ctxs.items():
            assert got[i] == branches(want, text_of, c[::-1], most, chars)
    with pytest.raises(ValueError):
        ngram.generate(prompts, mod, v, -1, ("item_id",))


def test_first_token(spark):
    tok = spark.createDataFrame([(0, [5])], "doc_id bigint, tokens array<int>")
    got = ngram.context_counts(ngram.histories(tok), "xor").collect()
    assert [(r["ctx"], r["tok"], r["cnt"]) for r in got] == [(0, 5, 7)]


def test_merge(spark):
    a = spark.createDataFrame([(0, [1, 2, 1, 3])], "doc_id bigint, tokens array<int>")
    b = spark.createDataFrame([(0, [1, 3])], "doc_id bigint, tokens array<int>")
    c = lambda t: ngram.context_counts(ngram.histories(t), "linear")
    merged = {(r["ctx"], r["tok"]): r["cnt"] for r in ngram.merge_counts(c(a), c(b)).collect()}
    assert merged[1, 3] == c(a).where("ctx = 1 and tok = 3").first()["cnt"] + c(b).where("ctx = 1 and tok = 3").agg(F.sum("cnt")).first()[0]


def test_files(spark, tmp_path):
    v = vocabulary.learn(docs(spark))
    path = str(tmp_path / "v.bin")
    formats.write_vocabulary(v.entries, path)
    assert (tmp_path / "v.bin").stat().st_size == 8 + 8 * 255
    assert sorted((r["token"], r["seq"]) for r in formats.read_vocabulary(spark, path).collect()) == sorted(v.entries)
    mod = ngram.model(vocabulary.tokenize_training(docs(spark), v))
    formats.write_ngrams(mod, str(tmp_path / "n.bin"))
    assert {tuple(r) for r in formats.read_ngrams(spark, str(tmp_path / "n.bin")).collect()} == {tuple(r) for r in mod.collect()}
    out = archive.archive([path, path + ".txt"], {"wiki": 'a "b"'}, str(tmp_path / "rel"), "models-en")
    assert out.endswith("models-en.zip") and (tmp_path / "rel" / "v.bin.txt").exists()
    with pytest.raises(FileExistsError):
        archive.archive([path], {}, str(tmp_path / "rel"), "models-en")


def test_selection_counts_frequent_grams_only(spark, monkeypatch):
    """the vocabulary without counting all n-grams, in all and by a column; parts of few characters, so that there are many."""
    words = ["".join(RNG.choice("etaoinsh") for _ in range(RNG.randint(1, 7))) for _ in range(400)]
    texts = [" ".join(words[int(RNG.random() ** 3 * len(words))] for _ in range(RNG.randint(0, 300))) for _ in range(80)] + ["", None, "a"]
    d = docs(spark, texts).withColumn("lang", F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") % 3))
    every = vocabulary.gram_counts(d, range(2, 10))
    want = [r["gram"] for r in vocabulary.select_entries(vocabulary.candidates(every)).orderBy("rk").collect()]
    by = {v: vocabulary.learn(d.where(F.col("lang") == v)) for v in (1, 2)}
    known = {(r["packed"]): r["cnt"] for r in every.collect()}
    monkeypatch.setattr(vocabulary, "SORTED_CHARS", 3_000)
    for share in (1, 700, 1 << 20):
        found = {r["packed"]: r["chars"] for r in vocabulary.frequent_grams(d, share).collect()}
        chars = found.pop(0)
        assert chars == sum(map(len, streams(spark, texts))) and {g for g, n in known.items() if n * share >= chars} <= set(found)
        got = vocabulary.counts_of(d, {(): np.array([*found, 1 << 50], np.int64)}).collect()
        assert {r["packed"]: r["cnt"] for r in got} == {g: known[g] for g in found}
        assert all(64 ** (r["len"] - 1) <= r["packed"] < 64 ** r["len"] for r in got)
    for shares in ((700,), (5, 700, 1 << 20), (1, 1 << 20)):
        monkeypatch.setattr(vocabulary, "SHARES", shares)
        with monkeypatch.context() as m:
            if shares[-1] > 700:
                m.setattr(vocabulary, "gram_counts", None)
            assert [r["gram"] for r in vocabulary.select(d).orderBy("rk").collect()] == want
            assert vocabulary.learn_by(d, "lang") == by
    monkeypatch.setattr(vocabulary, "MOST_LOOKED_FOR", 10)
    assert [r["gram"] for r in vocabulary.select(d).orderBy("rk").collect()] == want


def test_found_grams_are_counted(spark, monkeypatch):
    """what every task finds in time is counted in the same pass, and bounds of the rest hold; no second pass where that suffices."""
    words = ["".join(RNG.choice("etaoinsh") for _ in range(RNG.randint(1, 7))) for _ in range(400)]
    texts = [" ".join(words[int(RNG.random() ** 3 * len(words))] for _ in range(RNG.randint(0, 300))) for _ in range(80)]
    texts += [" ".join(RNG.choice(("zq zq", "xjx")) for _ in range(400)) for _ in range(4)] + ["", None]  # frequent in the last task only
    d = docs(spark, texts).coalesce(1).repartitionByRange(3, "doc_id").cache()
    every = vocabulary.gram_counts(d, range(2, 10)).cache()
    known = {r["packed"]: r["cnt"] for r in every.collect()}
    want = [r["gram"] for r in vocabulary.select_entries(vocabulary.candidates(every)).orderBy("rk").collect()]
    monkeypatch.setattr(vocabulary, "SORTED_CHARS", 3_000)
    sure = set()
    for share in (1_000, 1 << 20):
        found = {r["packed"]: r for r in vocabulary.frequent_grams(d, share).collect()}
        most = found.pop(0)["seen"]
        assert all(r["cnt"] <= known[g] <= r["cnt"] + most - r["seen"] for g, r in found.items())
        assert all(n <= most for g, n in known.items() if g not in found)
        sure.add((any(r["seen"] == most for r in found.values()), any(r["seen"] < most for r in found.values())))
    assert sure >= {(True, True), (True, False)}
    counted = []
    counts_of = vocabulary.counts_of
    monkeypatch.setattr(vocabulary, "counts_of", lambda d, grams, **k: counted.append({g for own in grams.values() for g in own.tolist()}) or counts_of(d, grams, **k))
    for shares, passes in (((1_000, 1 << 20), True), ((1 << 20,), False)):
        monkeypatch.setattr(vocabulary, "SHARES", shares)
        assert [r["gram"] for r in vocabulary.select(d).orderBy("rk").collect()] == want
        assert bool(counted) == passes and all(own <= known.keys() for own in counted)
        counted.clear()

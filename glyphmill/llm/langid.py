"""Language identification with string kernels.

The kernel of two texts is their blended-spectrum presence kernel: the number of character n-grams (n = 1, 2, 3) that
occur in both, divided by the geometric mean of their numbers of distinct n-grams. Training picks landmark texts in
each language, maps a bounded sample through the Nyström features of the landmarks and solves ridge regression, one
language against the rest. Kernel and solution fold into one matrix, so a batch of texts is scored by two matrix
products: presence x landmarks, then kernels x weights.

Characters are folded first: case is dropped, the most frequent letters of the sample keep a code of their own, other
letters share ``HASHED`` codes by their hash, everything else is a gap. Null text and text without a letter are ``und``
with score 0. A null ``lang`` teaches nothing. Equal scores go to the language that sorts first. With no labelled text at
all, every text is ``und``. Repeated rows are judged alike and a long text by all of it; an empty table gives an empty
table, and columns of any other name are carried along.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import free_name, map_rows, materialise

#: Letters with a code of their own, codes of other letters, n-gram lengths, landmarks (more where there are more
#: languages), sampled texts (one of each language at least), ridge.
ALPHABET, HASHED, LENGTHS, LANDMARKS, SAMPLE_ROWS, RIDGE = 94, 32, (1, 2, 3), 128, 2_000, 1e-3
#: Texts of a language that are drawn beyond its share: with these, one goes without any with a chance under 2e-5.
SPARE = 10


@dataclass
class Model:
    langs: list[str]
    alphabet: str
    grams: np.ndarray  # codes of the landmarks' n-grams
    landmarks: np.ndarray  # presence, landmarks x grams
    norms: np.ndarray  # distinct n-grams of each landmark
    weights: np.ndarray  # landmarks x langs
    bias: np.ndarray  # of each lang


class Folder:
    """Texts to arrays of folded characters and codes of n-grams."""

    def __init__(self, alphabet: str):
        code = {c: i + 1 for i, c in enumerate(alphabet)}
        self.first, self.size = len(alphabet) + 1, len(alphabet) + 1 + HASHED
        self.table = np.zeros(1 << 16, np.int32)
        for cp in range(1 << 16):
            c = chr(cp)
            if c.isalpha():
                self.table[cp] = code.get(c.lower(), self._other(cp))
        self.offset, at = [], 0
        for n in LENGTHS:
            self.offset.append(at)
            at += self.size**n
        self.total = at

    def _other(self, cp: int) -> int:
        return self.first + (cp * 2654435761 >> 16) % HASHED

    def letters(self, text: bytes | None) -> np.ndarray | None:
        """Folded characters; None without a letter."""
        if not text:
            return None
        s = text.decode("utf-8")
        cp = np.frombuffer(s.encode("utf-32-le"), np.uint32)
        high = cp > 0xFFFF
        if high.any():
            out = self.table[np.where(high, 0, cp)]
            for i in np.flatnonzero(high).tolist():
                out[i] = self._other(int(cp[i])) if s[i].isalpha() else 0
        else:
            out = self.table[cp]
        return out if out.any() else None

    def codes(self, c: np.ndarray) -> np.ndarray:
        parts, run = [], c
        for n, at in zip(LENGTHS, self.offset):
            if n > 1:
                run = run[:-1] * self.size + c[n - 1 :]
            parts.append(run + at)
            if len(run) < 2:
                break
        return np.concatenate(parts)


class Scorer:
    def __init__(self, m: Model):
        self.m, self.fold = m, Folder(m.alphabet)
        self.seen = np.zeros(self.fold.total, np.uint8)
        self.matrix = m.landmarks.T.astype(np.float32)

    def kernels(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """(kernel with each landmark, whether the text has a letter)."""
        present = np.zeros((len(texts), len(self.m.grams)), np.uint8)
        norm, some = np.ones(len(texts), np.float32), np.zeros(len(texts), bool)
        for i, t in enumerate(texts):
            c = self.fold.letters(t)
            if c is None:
                continue
            codes = self.fold.codes(c)
            self.seen[codes] = 1
            present[i] = self.seen[self.m.grams]
            norm[i], some[i] = np.count_nonzero(self.seen), True
            self.seen[codes] = 0
        shared = present.astype(np.float32) @ self.matrix
        return shared / np.sqrt(norm[:, None] * self.m.norms[None, :]), some

    def predict(self, texts: list[bytes | None]) -> list[dict]:
        out: list[dict] = []
        for at in range(0, len(texts), 128):
            k, some = self.kernels(texts[at : at + 128])
            s = k @ self.m.weights + self.m.bias
            best = s.argmax(1) if len(self.m.langs) else None
            for i, ok in enumerate(some.tolist()):
                known = ok and best is not None
                score = min(1.0, max(0.0, (float(s[i, best[i]]) + 1) / 2)) if known else 0.0
                out.append({"lang_pred": self.m.langs[best[i]] if known else "und", "score": score})
        return out


def alphabet_of(letters: Counter, size: int = ALPHABET) -> str:
    return "".join(c for c, _ in sorted(letters.items(), key=lambda x: (-x[1], x[0]))[:size])


def letters_of(text: bytes | None) -> Counter:
    return Counter(c for c in (text or b"").decode("utf-8").lower() if c.isalpha())


def fit(sets: list[np.ndarray], langs: list[str], alphabet: str, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """From the sorted distinct n-gram codes of texts with letters. Landmarks are the first texts of each language in turn."""
    names = sorted(set(langs))
    if not names:
        return Model([], "", np.zeros(0, np.int64), np.zeros((0, 0), np.uint8), np.zeros(0, np.float32), np.zeros((0, 0), np.float32), np.zeros(0, np.float32))
    by = [[i for i, x in enumerate(langs) if x == n] for n in names]
    picked = [i for k in range(max(map(len, by))) for own in by if k < len(own) for i in own[k : k + 1]][: max(landmarks, len(names))]
    marks = [sets[i] for i in picked]
    grams = np.unique(np.concatenate(marks))
    m = Model(names, alphabet, grams, np.stack([np.isin(grams, s) for s in marks]).astype(np.uint8), np.array([len(s) for s in marks], np.float32), np.zeros((len(marks), len(names)), np.float32), np.zeros(len(names), np.float32))
    matrix = m.landmarks.T.astype(np.float32)
    rows = []
    for s in sets:  # a text at a time: presence rows are as wide as the landmarks' n-grams
        at = np.minimum(np.searchsorted(grams, s), len(grams) - 1)
        rows.append(matrix[at[grams[at] == s]].sum(0) / np.sqrt(len(s) * m.norms))
    own = m.landmarks.astype(np.float32)
    kmm = (own @ own.T).astype(np.float64) / np.sqrt(np.outer(m.norms, m.norms))
    w, v = np.linalg.eigh(kmm)
    root = v[:, w > 1e-8] / np.sqrt(w[w > 1e-8])  # Nyström features: k @ root
    z = np.stack(rows).astype(np.float64) @ root
    y = np.where(np.array(langs)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    z1 = np.hstack([z, np.ones((len(z), 1))])
    solved = np.linalg.solve(z1.T @ z1 + ridge * len(z) * np.diag([*np.ones(z.shape[1]), 0.0]) + 1e-9 * np.eye(z1.shape[1]), z1.T @ y)
    m.weights, m.bias = (root @ solved[:-1]).astype(np.float32), solved[-1].astype(np.float32)
    return m


def train(docs: DataFrame, where: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = SAMPLE_ROWS) -> Model:
    """Fit on about ``rows`` labelled texts among those that ``where`` admits, as many of each language and one at least.

    The languages are counted first; then each keeps the rows whose hashed id and text fall below its rate, so no
    language's rows meet in one task; repeated rows count once. The sample stays in the shared folder: the driver gets counts of letters, and then each text's distinct n-gram codes, which are bounded
    by the alphabet however long the text.
    """
    d = docs.where(where).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    counts = [(r["lang"], r["count"]) for r in d.groupBy("lang").count().collect()]  # the model names them all
    if not counts:
        return fit([], [], "")
    few = max(1, int(0.9 * rows / len(counts))) + SPARE
    rates = d.sparkSession.createDataFrame([(k, min(1.0, few / n)) for k, n in counts], "lang string, rate double")
    rates = F.broadcast(rates) if len(counts) <= 100_000 else rates
    u = F.pmod(F.xxhash64("id", "text", F.lit(17)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    picked = d.join(rates, "lang").where(u < F.col("rate")).select("id", "lang", "text").dropDuplicates()
    sample = materialise(picked, "languages")
    count = lambda: lambda texts: [letters_of(t) for t in texts]
    letters = map_rows(sample, ["text"], "letters", "map<string, bigint>", count, keep=False).select(F.explode("letters").alias("c", "n")).groupBy("c").agg(F.sum("n").alias("n"))
    chars = alphabet_of(Counter({r["c"]: r["n"] for r in letters.orderBy(F.desc("n"), "c").limit(ALPHABET).collect()}))

    def make() -> Callable[[list], list]:
        fold = Folder(chars)

        def f(texts):
            folded = [fold.letters(t) for t in texts]
            return [None if c is None else np.unique(fold.codes(c)).astype("<i4").tobytes() for c in folded]

        return f

    got = map_rows(sample, ["text"], "codes", "binary", make).where("codes is not null").select("id", "lang", "codes").orderBy(F.xxhash64("id", F.lit(17)), "id", "codes").collect()
    return fit([np.frombuffer(r["codes"], "<i4").astype(np.int64) for r in got], [r["lang"] for r in got], chars)


def identify(docs: DataFrame, model: Model, text_col: str = "text", out: str = "language") -> DataFrame:
    """Append struct ``out``: lang_pred, score. Row-wise; only the text is looked at."""

    def make() -> Callable[[list], list]:
        return Scorer(model).predict

    return map_rows(docs, [text_col], out, "struct<lang_pred: string, score: double>", make)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def predict_all(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; learnt from the documents that aren't held out."""
    model = train(docs, ~held_out())
    d = docs.select("doc_id", "text")
    out = free_name(d, "language")
    return identify(d, model, out=out).select("doc_id", held_out().alias("held_out"), F.col(f"{out}.lang_pred").alias("lang_pred"), F.col(f"{out}.score").alias("score"))

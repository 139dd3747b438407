"""Quality rules: text statistics and a learned decision list.

``statistics`` computes plain statistics of whole texts in one row-wise pass. ``learn`` grows and prunes an ordered list
of threshold conjunctions from labelled statistics by sequential covering: each rule for "reject" gains conditions
(best information gain, measured on two thirds of the sample) until it covers no good document, then loses final
conditions while that helps on the other third; it enters the list only if it is precise there, by share and by a cautious
estimate. The rejected documents that a rule covers are done with, whether it entered or not, and the next rule is grown
on the rest until none is left. ``verdict`` turns the list into one ordered CASE expression.

Null text counts as empty text: no words, so the base rules reject it. Repeated rows are judged alike. Labels that are
null or belong to no document are ignored; documents with contradicting labels count as good; documents
that the base rules reject teach nothing. Without labelled
documents of both classes the list is empty and only the base rules decide. An empty table gives an empty table; columns of
any other name are carried along. Whole texts are read, in time in proportion to their length.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import free_name, map_rows

#: Labelled documents that the list is learned from, at most (those with the smallest hashed ids).
SAMPLE_ROWS = 20_000
#: Share of rejected documents among those a rule covers in the pruning third, at least; the same with one more document
#: of each class, which a rule that covers few documents does not reach.
PRECISION, CAUTIOUS = 0.98, 0.9
SYMBOLS = "#*$%&|<>"

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct_words", "n_upper", "n_digits", "n_exclaims", "n_lines")
#: Statistics that rules may test, from the counts (all zero where there is no word).
RATIOS = {
    "symbols_per_word": ("n_symbols", "n_words"),
    "chars_per_word": ("word_chars", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "distinct_share": ("n_distinct_words", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "digit_share": ("n_digits", "word_chars"),
    "exclaims_per_word": ("n_exclaims", "n_words"),
}


def _repeated(words: list[bytes]) -> int:
    """Words in five-word windows that occur twice or more in the text."""
    n = len(words) - 4
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    w = np.fromiter((seen.setdefault(x, len(seen)) for x in words), np.int64, len(words))
    code, size = w[:n], len(seen)
    for k in range(1, 5):  # exact codes of growing windows: ranks stay below the number of positions
        _, code = np.unique(code * size + w[k : n + k], return_inverse=True)
    twice = np.bincount(code)[code] > 1
    cover = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + 5, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_DIGIT = re.compile(r"[0-9]")


def text_statistics(text: bytes | None) -> dict[str, int]:
    data = text or b""
    words, s = data.split(), data.decode("utf-8")
    spaces = sum(map(s.count, " \t\n\v\f\r"))
    lines, seen, dup, full = s.split("\n"), set(), 0, 0
    for line in lines:
        if line.strip(" \t\v\f\r"):
            full += 1
            dup += line in seen
            seen.add(line)
    return {
        "n_words": len(words), "word_chars": len(s) - spaces, "n_symbols": sum(map(s.count, SYMBOLS)), "n_dup_lines": dup,
        "n_repeat_words": _repeated(words), "n_distinct_words": len(set(words)), "n_upper": len(_UPPER.findall(s)),
        "n_digits": len(_DIGIT.findall(s)), "n_exclaims": s.count("!"), "n_lines": full,
    }


def statistics(docs: DataFrame, text_col: str = "text", out: str = "stats") -> DataFrame:
    """Append struct ``out`` with the counts and ratios; row-wise."""
    raw = free_name(docs, "raw_stats")
    kinds = ", ".join(f"{c}: bigint" for c in COUNTS)
    counted = map_rows(docs, [text_col], raw, f"struct<{kinds}>", lambda: lambda texts: [text_statistics(t) for t in texts])
    c = lambda name: F.col(f"{raw}.{name}")
    ratios = [F.coalesce(F.try_divide(c(a).cast("double"), c(b).cast("double")), F.lit(0.0)).alias(k) for k, (a, b) in RATIOS.items()]
    return counted.withColumn(out, F.struct(*(c(x).alias(x) for x in COUNTS), *ratios)).drop(raw)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # > threshold, else <=
    threshold: float


Rule = tuple[Condition, ...]
FEATURES = ("n_words", *RATIOS)


def _covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        v = x[:, FEATURES.index(c.feature)]
        out &= (v > c.threshold) if c.above else (v <= c.threshold)
    return out


def _grow(x: np.ndarray, y: np.ndarray) -> Rule:
    rule: Rule = ()
    while y.any() and not y.all():
        base, best = np.log2(y.mean()), (0.0, None)
        for j, name in enumerate(FEATURES):
            order = np.argsort(x[:, j], kind="stable")
            v, p = x[order, j], np.cumsum(y[order])
            cut = np.flatnonzero(v[1:] > v[:-1])
            if not len(cut):
                continue
            pos, tot = p[cut], cut + 1.0
            for above, a, n in ((False, pos, tot), (True, p[-1] - pos, len(y) - tot)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(a > 0, a * (np.log2(a / n) - base), 0.0)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (float(gain[k]), Condition(name, above, float((v[cut[k]] + v[cut[k] + 1]) / 2)))
        if best[1] is None:
            break
        rule += (best[1],)
        keep = _covers((best[1],), x)
        x, y = x[keep], y[keep]
    return rule


def learn_rules(x: np.ndarray, y: np.ndarray) -> list[Rule]:
    """Rules for y (True: reject); x has a column for each of ``FEATURES``. Every third row is for pruning."""
    prune = np.arange(len(x)) % 3 == 2
    gx, gy, px, py = x[~prune], y[~prune], x[prune], y[prune]
    rules: list[Rule] = []
    while gy.any():
        grown = _grow(gx, gy)
        if not grown:
            break

        def worth(r: Rule) -> float:
            c = _covers(r, px)
            return (2 * py[c].sum() - c.sum()) / max(1, c.sum()) if c.any() else -1.0

        rule = max((grown[:k] for k in range(1, len(grown) + 1)), key=lambda r: (worth(r), _covers(r, px).sum(), -len(r)))
        hit, done = _covers(rule, px), _covers(grown, gx) & gy  # a grown rule covers a rejected document at least
        if hit.any() and py[hit].mean() >= PRECISION and (py[hit].sum() + 1) / (hit.sum() + 2) >= CAUTIOUS:
            rules.append(rule)
            done |= _covers(rule, gx)
            px, py = px[~hit], py[~hit]
        gx, gy = gx[~done], gy[~done]
    return rules


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The decision list from at most ``rows`` labelled documents; statistics are computed for these only."""
    known = labels.where(f"{label_col} is not null and {id_col} is not null").groupBy(F.col(id_col).alias("label_id")).agg(F.max(label_col).alias("label"))
    few = known.orderBy(F.xxhash64("label_id"), "label_id").limit(rows)  # bounded by ``rows``: safe to broadcast
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(few), F.col("id") == F.col("label_id"))
    got = statistics(d, "text", "stats").where(~base_failed("stats")).select("id", "label", *(F.col(f"stats.{f}").cast("double").alias(f) for f in FEATURES)).limit(rows).toPandas()
    got = got.sort_values(["id", *FEATURES]).drop_duplicates("id")
    x, y = got[list(FEATURES)].to_numpy(float), (got["label"] <= 0).to_numpy(bool)
    return learn_rules(x, y) if len(x) else []


def rule_column(rule: Rule, stats: str = "stats") -> Column:
    test = [F.col(f"{stats}.{c.feature}") > c.threshold if c.above else F.col(f"{stats}.{c.feature}") <= c.threshold for c in rule]
    return reduce(lambda a, b: a & b, test)


def verdict(rules: list[Rule], stats: str = "stats") -> Column:
    """Number of the first rule that rejects the document (from 1), 0 if none does: one ordered CASE expression."""
    out = None
    for i, rule in enumerate(rules, 1):
        out = F.when(rule_column(rule, stats), i) if out is None else out.when(rule_column(rule, stats), i)
    return F.lit(0) if out is None else out.otherwise(0)


def base_failed(stats: str = "stats") -> Column:
    n, r = F.col(f"{stats}.n_words"), F.col(f"{stats}.n_repeat_words")
    return (n < 10) | (100 * r > 20 * n)


def judge(docs: DataFrame, rules: list[Rule], text_col: str = "text", out: str = "quality_report") -> DataFrame:
    """Append struct ``out``: counts and ratios, base_failed, rule (0: none), kept."""
    stats = free_name(docs, "stats")
    d = statistics(docs, text_col, stats)
    fails = base_failed(stats)
    rule = F.when(fails, 0).otherwise(verdict(rules, stats))
    return d.withColumn(out, F.struct(F.col(f"{stats}.*"), fails.alias("base_failed"), rule.alias("rule"), (~fails & (rule == 0)).alias("kept"))).drop(stats)

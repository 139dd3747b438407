"""Benchmark decontamination by pigeonhole edit matching.

A document is contaminated by a test item if some passage of it is within the item's error budget of edits (insert,
delete, substitute one character) of the whole item. Texts are compared in lower case with runs of white space as one
space. An item with budget k is split into k + 1 pieces of about equal length; k edits can't touch all of them, so a
match contains one piece unchanged, at most k characters from its place. One Aho-Corasick pass over the text finds all
pieces of all items; each hit opens a window, windows that overlap are merged, and Myers' bit-parallel algorithm finds
the least distance of the item to any passage of the window. Nothing that is within the budget can be missed.

An edit touches three of an item's trigrams at most, so a passage within k edits has all but 3 k of them. Two filters
follow from this, and neither can lose a match: items are dropped for a document by one vectorised comparison of bitmaps of
trigrams, however many items share a piece, and windows by the trigrams themselves. Only what is left is verified.

The items are the stated query set: they are taken in blocks of ``BLOCK_CHARS`` characters, broadcast one by one, so what
a task holds stays bounded, and each block runs against all documents. Items under ``SHORT`` characters have no budget
and match exactly, where neither neighbour is a letter or digit. Null or blank items match nothing; null or blank documents
match nothing. Equal items are matched each under its own id; repeated documents are judged alike. Long texts cost in
proportion to their length. Without documents or items there are no matches; columns of any other name are carried along.
"""

from __future__ import annotations

import uuid
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import claim, free_name, map_rows

#: Edits allowed as a share of an item's characters, the fewest characters of a piece, characters under which an item must
#: stand between word boundaries, characters of a block of items.
ERROR_RATE, PIECE, SHORT, BLOCK_CHARS = 0.05, 10, 24, 8_000_000
#: Bits of a bitmap of trigrams.
MAP_BITS = 4_096


def normalise(text: bytes | None) -> str:
    return b" ".join((text or b"").split()).decode("utf-8").lower()


def budget(length: int, rate: float = ERROR_RATE) -> int:
    """Edits allowed; pieces stay at least ``PIECE`` characters long, and short items allow none."""
    return 0 if length < SHORT else max(0, min(int(length * rate), length // PIECE - 1))


def trigrams(text: str) -> set[str]:
    return {text[i : i + 3] for i in range(len(text) - 2)}


def bitmap(grams: set[str]) -> np.ndarray:
    """Bits of a set of trigrams; a missing bit tells that at least one of its trigrams is missing."""
    bits = np.zeros(MAP_BITS, bool)
    bits[[zlib.crc32(g.encode()) % MAP_BITS for g in grams]] = True
    return np.packbits(bits).view(np.uint64)


def myers(pattern: str, masks: dict[str, int], text: str) -> tuple[int, int]:
    """(least edit distance of the whole pattern to any passage of text, first end of such a passage)."""
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    get = masks.get
    for at, c in enumerate(text, 1):
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best, end = score, at
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
    return best, end


class Matcher:
    """All items of a block, ready to scan texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float = ERROR_RATE):
        import ahocorasick

        self.items, places, maps = [], defaultdict(list), []
        for item_id, text in items:
            if not text:
                continue
            k, n = budget(len(text), rate), len(self.items)
            masks: dict[str, int] = defaultdict(int)
            for i, c in enumerate(text):
                masks[c] |= 1 << i
            grams = trigrams(text)
            maps.append(bitmap(grams))
            self.items.append((item_id, text, k, dict(masks), grams))
            cuts = [i * len(text) // (k + 1) for i in range(k + 2)]
            for a, b in zip(cuts, cuts[1:]):
                places[text[a:b]].append((n, a))
        self.auto = ahocorasick.Automaton()
        for piece, where in places.items():
            self.auto.add_word(piece, (len(piece), np.array(where, np.int64).reshape(-1, 2)))
        if places:
            self.auto.make_automaton()
        self.empty = not places
        self.maps = np.stack(maps) if maps else np.zeros((0, MAP_BITS // 64), np.uint64)
        self.spare = 3 * np.array([x[2] for x in self.items], np.int64)

    def _alike(self, names: np.ndarray, s: str) -> np.ndarray:
        """Items of ``names`` that lack few enough of their trigrams in a text."""
        lacking = np.bitwise_count(self.maps[names] & ~bitmap(trigrams(s))).sum(1)
        return names[lacking <= self.spare[names]]

    def scan(self, text: bytes | None) -> list[dict]:
        """Items found: item_id, distance (the least), end (of the first such passage in the normalised text)."""
        s = normalise(text)
        if self.empty or not s:
            return []
        hits = [(np.int64(last - length + 1), where) for last, (length, where) in self.auto.iter(s)]
        if not hits:
            return []
        names = np.concatenate([w[:, 0] for _, w in hits])
        starts = np.concatenate([at - w[:, 1] for at, w in hits])
        out = []
        for n in self._alike(np.unique(names), s).tolist():
            item_id, item, k, masks, grams = self.items[n]
            best = (k + 1, 0)
            exact = self._exact(s, item)
            if exact >= 0:
                best = (0, exact + len(item))
            elif k:
                spans: list[list[int]] = []
                for d in np.unique(starts[names == n]).tolist():
                    lo, hi = max(0, d - k), min(len(s), d + len(item) + k)
                    if spans and lo <= spans[-1][1]:
                        spans[-1][1] = max(hi, spans[-1][1])
                    else:
                        spans.append([lo, hi])
                for lo, hi in spans:
                    window = s[lo:hi]
                    if len(grams - trigrams(window)) <= 3 * k:
                        distance, end = myers(item, masks, window)
                        best = min(best, (distance, lo + end))
            if best[0] <= k:
                out.append({"item_id": item_id, "distance": best[0], "end": best[1]})
        return out

    @staticmethod
    def _exact(s: str, item: str) -> int:
        """Place of the item in a text, -1 without one; a short one counts only between word boundaries."""
        at = s.find(item)
        while at >= 0 and len(item) < SHORT:
            before, after = s[at - 1 : at] if at else "", s[at + len(item) : at + len(item) + 1]
            if not ((before.isalnum() and item[0].isalnum()) or (after.isalnum() and item[-1].isalnum())):
                break
            at = s.find(item, at + 1)
        return at


#: The worker's matcher of the block that it scanned last.
_MATCHERS: dict[str, Matcher] = {}


def matcher(name: str, block, rate: float) -> Matcher:
    """Made once a worker and block, whatever tasks it serves."""
    claim("decontaminate", _MATCHERS.clear)
    if name not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[name] = Matcher(block.value, rate)
    return _MATCHERS[name]


def item_blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of about ``block_chars`` characters; the driver holds one at a time, as a task does."""
    block: list[tuple[int, str]] = []
    size = 0
    rows = items.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where("t is not null")
    for r in rows.toLocalIterator():
        text = normalise(r.t.encode())
        if block and size + len(text) > block_chars:
            yield block
            block, size = [], 0
        block.append((r.i, text))
        size += len(text)
    if block:
        yield block


def find(docs: DataFrame, items: DataFrame, text_col: str = "text", out: str = "leaks", rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Append array ``out`` of structs item_id, distance, end: the items found in each document. Row-wise."""
    kind = "array<struct<item_id: bigint, distance: int, end: bigint>>"
    found = []
    for block in item_blocks(items, block_chars=block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def make(shared=shared, key=uuid.uuid4().hex) -> Callable[[list], list]:
            m = matcher(key, shared, rate)
            return lambda texts: [m.scan(t) for t in texts]

        name = free_name(docs, "leaks")
        docs = map_rows(docs, [text_col], name, kind, make, owner="decontaminate")
        found.append(name)
    none = F.array().cast(kind)
    return docs.withColumn(out, F.concat(none, *(F.col(c) for c in found))).drop(*[c for c in found if c != out])


def matches(docs: DataFrame, items: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """doc_id, item_id, distance, match_end: a row for each contaminated document and item."""
    d = docs.select("doc_id", "text")
    return find(d, items, out="found", rate=rate).select("doc_id", F.inline("found").alias("item_id", "distance", "match_end"))


def clean(docs: DataFrame, items: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """The documents in which no item was found, with their own columns."""
    out = free_name(docs, "found")
    return find(docs, items, out=out, rate=rate).where(F.size(out) == 0).drop(out)

"""BPE encoding and decoding with tree concatenation for long unsplit text.

The tokenizers library does the merges. Text is cut where its encoding is known to be independent:

* word tokenizer (white space dropped): at ASCII white space;
* byte-level tokenizer: before a space that follows a character other than white space and precedes one.

Pieces between the cuts repeat, so their ids are cached. A *long* piece (more than ``LONG`` symbols without a
place to cut) is encoded as a tree of halves: ranges of leaves, and later ranges of joins, go to ``THREADS`` threads (the
library works outside Python's lock), then neighbours are joined level by level.
At each join the last and first ``k`` tokens are encoded again as one window; where the window's outer tokens
equal the old ones, both sides agree and the window replaces them, else ``k`` doubles. Adjacent tokens of a BPE
encoding constrain each other only in pairs, so equal outer tokens prove that the spliced encoding is exact.

Null text is empty text: no ids, empty decoded text. An empty table gives an empty table; columns of any other name are
carried along. Strings of special tokens in a text become special tokens,
as in the library (``special=True``), or stay ordinary text (``special=False``).
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import claim, free_name, map_rows

#: Symbols (byte-level characters) from which a piece counts as long, symbols in a leaf, tokens in the first window.
LONG, LEAF, WINDOW = 512, 256, 4
#: Threads of a worker for a long piece, parts from which they pay.
THREADS, THREAD_PARTS = 4, 64
#: Entries of a piece cache. A full cache takes no more, so frequent pieces, which come first, stay; it is emptied
#: when it no longer knows half of the pieces.
CACHE = 300_000


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Text whose pieces the plain patterns below cut as the tokenizers' own do: printable ASCII, white space, Latin-1 letters.
SAFE = re.compile("[\t-\r -~À-ÖØ-öø-ÿ]*")
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_TAILS = "'s|'t|'re|'ve|'m|'ll|'d"
WORD_PIECES = re.compile(rf"{_TAILS}|[{_LETTERS}]+|[0-9]|[^\s{_LETTERS}0-9]+")
BYTE_PIECES = re.compile(rf"{_TAILS}| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+")


def byte_symbols() -> dict[int, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for U+0100 onwards in byte order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {b: b if b in plain else 256 + rest.index(b) for b in range(256)}


class TreeEncoder:
    """Ids of one long piece by tree concatenation. ``inner`` encodes text before the piece's end, ``last`` text with it."""

    def __init__(self, spec: dict, leaf: int = LEAF, window: int = WINDOW):
        from tokenizers import Tokenizer

        def bare(suffix):
            model = spec["model"] | {"end_of_word_suffix": suffix}
            return Tokenizer.from_str(json.dumps({"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "pre_tokenizer": None, "post_processor": None, "decoder": None, "model": model}))

        suffix = spec["model"].get("end_of_word_suffix")
        self.last = bare(suffix)
        self.inner = bare(None) if suffix else self.last
        self.leaf, self.window, self.suffix = leaf, window, suffix or ""
        self.text_of = {i: t for t, i in spec["model"]["vocab"].items()}

    def _batch(self, parts: list[tuple[str, bool]]) -> list[list[int]]:
        """Ids of each (text, whether the piece ends with it)."""
        out: list[list[int]] = [[] for _ in parts]
        for end in (False, True):
            where = [i for i, p in enumerate(parts) if p[1] == end]
            coder = self.last if end else self.inner
            ids = lambda own, coder=coder: [e.ids for e in coder.encode_batch([parts[i][0] for i in own], add_special_tokens=False)]
            size = max(THREAD_PARTS, -(-len(where) // THREADS))
            ranges = [where[k : k + size] for k in range(0, len(where), size)]
            if len(ranges) > 1:
                with ThreadPoolExecutor(THREADS) as pool:
                    got = [x for r in pool.map(ids, ranges) for x in r]
            else:
                got = ids(where)
            for i, x in zip(where, got):
                out[i] = x
        return out

    def _text(self, ids: list[int], end: bool) -> str:
        s = "".join(self.text_of[i] for i in ids)
        return s.removesuffix(self.suffix) if end and self.suffix else s

    def encode(self, piece: str) -> list[int]:
        if not piece:
            return []
        cuts = [piece[i : i + self.leaf] for i in range(0, len(piece), self.leaf)]
        nodes = self._batch([(p, i == len(cuts) - 1) for i, p in enumerate(cuts)])
        while len(nodes) > 1:
            pairs = [(nodes[i], nodes[i + 1]) for i in range(0, len(nodes) - 1, 2)]
            rest = nodes[len(pairs) * 2 :]
            joined: list[list[int] | None] = [None] * len(pairs)
            k = self.window
            while open_ := [i for i, x in enumerate(joined) if x is None]:
                asked = []
                for i in open_:
                    a, b = pairs[i]
                    end = i == len(pairs) - 1 and not rest and k >= len(b)
                    asked.append((self._text(a[-k:], False) + self._text(b[:k], end), end))
                for i, got in zip(open_, self._batch(asked)):
                    a, b = pairs[i]
                    if (k >= len(a) or got[0] == a[-k]) and (k >= len(b) or got[-1] == b[k - 1]):
                        joined[i] = a[:-k] + got + b[k:]
                k *= 2
            nodes = [*joined, *rest]
        return nodes[0]


class PieceCoder:
    """Encodes and decodes whole texts; made once in a task."""

    def __init__(self, path: str, special: bool = True, cache: int = CACHE, long: int = LONG):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            text = f.read()
        spec = json.loads(text)
        self.tok = Tokenizer.from_str(text)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.tok.encode_special_tokens = not special
        self.pre, self.norm = self.tok.pre_tokenizer, self.tok.normalizer
        self.model = self.tok.model
        self._text, self._tree = text, None
        self.size, self.long = cache, long
        self.missed = self.asked = 0  # since the cache is full
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]} if special else {}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words = spec["normalizer"] is not None  # white space is dropped; else it is part of the pieces
        self.name = {i: t for t, i in spec["model"]["vocab"].items()} | {i: t for t, i in self.special.items()}
        self.cache: dict[str, bytes] = {}
        self.shown: dict[bytes, str] = {}
        self.symbols = byte_symbols()
        self.id_type = np.dtype("<u4")

    @property
    def tree(self) -> TreeEncoder:
        """Made when the first long piece comes; most corpora have few or none."""
        if self._tree is None:
            self._tree = TreeEncoder(json.loads(self._text))
        return self._tree

    def _piece_ids(self, piece: str) -> list[int]:
        return self.tree.encode(piece) if len(piece) > self.long else [t.id for t in self.model.tokenize(piece)]

    def _part_ids(self, part: str) -> list[int]:
        """Ids of text without special tokens, by the library's own normaliser and splitter."""
        if self.norm is not None:
            part = self.norm.normalize_str(part)
        out: list[int] = []
        for piece, _ in self.pre.pre_tokenize_str(part):
            out += self._piece_ids(piece)
        return out

    def _chunk_ids(self, chunk: str) -> list[int]:
        out: list[int] = []
        for part in self.split_special.split(chunk) if self.special else [chunk]:
            out += [self.special[part]] if part in self.special else self._part_ids(part) if part else []
        return out

    def _chunks(self, text: str) -> list[str]:
        """Cut where the encoding is independent."""
        if self.words:
            return re.split("[\t-\r ]+", text)
        return re.split(r"(?<=\S)(?= \S)", text)

    def encode_parts(self, text: bytes | None) -> list[bytes]:
        """Ids of a text as little-endian 32-bit integers, in parts that repeat from text to text."""
        if not text:
            return []
        s = text.decode("utf-8")
        if self.missed * 2 > self.asked > self.size:
            self.cache.clear()
            self.shown.clear()
            self.missed = self.asked = 0
        if SAFE.fullmatch(s) and not any(m in s for m in self.special):
            if self.words:
                parts, ids_of = WORD_PIECES.findall(s.lower()), self._safe_ids
            else:
                parts, ids_of = BYTE_PIECES.findall(s), self._safe_ids
        else:
            parts, ids_of = ["\0" + c for c in self._chunks(s) if c], lambda c: self._chunk_ids(c[1:])  # keys apart from the pieces'
        cache = self.cache
        if len(cache) >= self.size:
            self.asked += len(parts)
        try:
            return [cache[p] for p in parts]
        except KeyError:
            pass
        out = []
        for p in parts:
            ids = cache.get(p)
            if ids is None:
                ids = array("I", ids_of(p)).tobytes()
                if len(cache) >= self.size:
                    self.missed += 1
                elif len(p) <= 64:
                    cache[p] = ids
            out.append(ids)
        return out

    def _safe_ids(self, piece: str) -> list[int]:
        return self._piece_ids(piece.encode().decode("latin-1").translate(self.symbols))

    def encode(self, text: bytes | None) -> bytes:
        return b"".join(self.encode_parts(text))

    def decode(self, ids: bytes) -> str:
        """As the library's decode of a tokenizer without a decoder: token strings joined by a space."""
        name = self.name
        return " ".join([name[i] for i in np.frombuffer(ids, self.id_type).tolist()])

    def decode_parts(self, ids: list[bytes]) -> str:
        """``decode`` of ids given in parts, which repeat."""
        shown, out = self.shown, []
        for x in ids:
            s = shown.get(x)
            if s is None:
                s = self.decode(x)
                if len(x) <= 256 and len(shown) < self.size // 2:
                    shown[x] = s
            if s:
                out.append(s)
        return " ".join(out)


_CODERS: dict[tuple, PieceCoder] = {}


def coder(path: str, special: bool = True) -> PieceCoder:
    """The worker's coder, kept from task to task."""
    claim("bpe", _CODERS.clear)
    if (path, special) not in _CODERS:
        _CODERS.clear()
        _CODERS[path, special] = PieceCoder(path, special)
    return _CODERS[path, special]


def encode_decode(docs: DataFrame, path: str, text_col: str = "text", out: str = "bpe", ids: bool = True, decoded: bool = True) -> DataFrame:
    """Append struct ``out``: n_tokens, ids_sha256, decoded_sha256 and, if wanted, ids and the decoded text.

    Row-wise: no shuffle, repeated rows and rows with null ids stay as they are. Null or empty text has no ids, and
    both digests are those of the empty string.
    """
    kinds = "n_tokens: bigint, ids_sha256: string, decoded_sha256: string" + (", ids: array<bigint>" if ids else "") + (", decoded: string" if decoded else "")

    def make():
        c = coder(path)

        def f(texts):
            rows = []
            for t in texts:
                parts = c.encode_parts(t)
                packed, shown = b"".join(parts), c.decode_parts(parts)
                row = {"n_tokens": len(packed) // 4, "ids_sha256": hashlib.sha256(packed).hexdigest(), "decoded_sha256": hashlib.sha256(shown.encode()).hexdigest()}
                rows.append(row | ({"ids": np.frombuffer(packed, "<u4").tolist()} if ids else {}) | ({"decoded": shown} if decoded else {}))
            return rows

        return f

    return map_rows(docs, [text_col], out, f"struct<{kinds}>", make, owner="bpe")


def encoded_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row."""
    d = docs.select(id_col, text_col)
    out = free_name(d, "bpe")
    return encode_decode(d, path, text_col, out, ids=False, decoded=False).select(
        F.col(id_col).alias("doc_id"), *(F.col(f"{out}.{c}").alias(c) for c in ("n_tokens", "ids_sha256", "decoded_sha256"))
    )

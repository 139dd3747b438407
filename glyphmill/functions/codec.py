"""Text codecs: the six-bit alphabet as order-preserving *token text*, and the seven-bit one.

Token t of the six-bit code is written as the t-th character of ``ALPHABET``. Its characters ascend, so sorting token text
sorts token sequences, and each is one byte, so edit distances on token text are distances on tokens.
"""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

ALPHABET = "-" + string.digits + string.ascii_uppercase + "_" + string.ascii_lowercase
NULL, SEPARATOR, SENTENCE_END, UNKNOWN = ALPHABET[0], ALPHABET[27], ALPHABET[62], ALPHABET[63]

#: The characters of tokens 28 to 48, in token order, and the separator's spellings.
ACCENTED = "éèëïöüáàóòúçêâîôûñßæœ"
SEPARATORS = " -_,"
#: What the code takes for white space.
WHITESPACE = r"[\t\n\x0B\f\r\x1C-\x1F \u1680\u2000-\u2006\u2008-\u200A\u2028\u2029\u205F\u3000]"

_LOWER = string.ascii_lowercase + ACCENTED
_TOKENS = [*range(1, 27), *range(28, 28 + len(ACCENTED))]
_PAIRS = [(c, t) for c, t in zip(_LOWER, _TOKENS)] + [(c.upper(), t) for c, t in zip(_LOWER, _TOKENS) if len(c.upper()) == 1 and c != "ß"]
SOURCE = "".join(c for c, _ in _PAIRS) + SEPARATORS + "."
TARGET = "".join(ALPHABET[t] for _, t in _PAIRS) + SEPARATOR * len(SEPARATORS) + SENTENCE_END
#: Characters that have a token, as the inside of a regular expression's class.
KNOWN_CLASS = "".join("\\" + c if c in "-.^]" else c for c in SOURCE)
DECODED = _LOWER + " .?"
DECODE_FROM = "".join(ALPHABET[t] for t in _TOKENS) + SEPARATOR + SENTENCE_END + UNKNOWN


def collapse_whitespace(text: Column) -> Column:
    """Runs of white space become one space."""
    return F.regexp_replace(text, WHITESPACE + "+", " ")


def drop_unknown(text: Column) -> Column:
    """Remove characters without a token; their neighbours close up. NUL counts as a separator."""
    return F.regexp_replace(F.translate(text, "\0", " "), f"[^{KNOWN_CLASS}]", "")


def encode(text: Column) -> Column:
    """Token text of characters that all have a token."""
    return F.translate(text, SOURCE, TARGET)


def encode_all(text: Column) -> Column:
    """Token text in which characters without a token are UNKNOWN."""
    marked = F.regexp_replace(F.translate(text, "\0", " "), f"[^{KNOWN_CLASS}]", "\u0001")
    return F.translate(marked, SOURCE + "\u0001", TARGET + UNKNOWN)


def decode(token_text: Column) -> Column:
    return F.translate(token_text, DECODE_FROM, DECODED)


def stream(text: Column) -> Column:
    """A document as the learners see it: framed by spaces, white space collapsed, unknown characters dropped, encoded."""
    return encode(drop_unknown(collapse_whitespace(F.concat(F.lit(" "), F.coalesce(text, F.lit("")), F.lit(" ")))))


def seven_bit(text: Column) -> Column:
    """Printable ASCII kept, white space as a space, everything else as DEL (the unknown token)."""
    return F.regexp_replace(F.regexp_replace(text, WHITESPACE, " "), "[^ -~]", "\x7f")


#: Tokens of the seven-bit code: 1 to 95 are printable ASCII, 0 is none, 127 what has no token.
SEVEN_NULL, SEVEN_LAST, SEVEN_UNKNOWN = 0, 95, 127


def seven_bit_tokens(text: Column) -> Column:
    """Tokens of a text, one a character; empty for an empty text."""
    chars = F.filter(F.split(seven_bit(text), ""), lambda c: c != "")
    return F.transform(chars, lambda c: F.when(c == "\x7f", F.lit(SEVEN_UNKNOWN)).otherwise(F.ascii(c) - 31))


def seven_bit_text(tokens: Column) -> Column:
    """Characters of tokens, ``?`` for unknown ones; any other number is an error."""
    printable = "".join(map(chr, range(32, 127)))
    bad = F.raise_error(F.lit("not a token of the seven-bit code")).cast("string")
    one = lambda t: F.when(is_ascii(t), F.substring(F.lit(printable), t, F.lit(1))).when(is_unknown(t), F.lit("?")).otherwise(bad)
    return F.array_join(F.transform(tokens, one), "")


def is_ascii(token: Column) -> Column:
    return token.between(1, SEVEN_LAST)


def is_unknown(token: Column) -> Column:
    return token == SEVEN_UNKNOWN


def is_null(token: Column) -> Column:
    return token == SEVEN_NULL


def validated(token_text: Column) -> Column:
    """Token text of a word; an error where it holds anything but letters' tokens (1 to 26, 28 to 48)."""
    bad = F.raise_error(F.concat(F.lit("not a word of letters: "), token_text)).cast("string")
    return F.when(F.regexp_like(token_text, F.lit(f"^[{ALPHABET[1:27]}{ALPHABET[28:49]}]+$")), token_text).otherwise(bad)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def packed(token_text: Column) -> Column:
    """Tokens, six bits each, the last one lowest: a bigint for up to ten tokens."""
    digit = lambda c: (F.instr(F.lit(ALPHABET), c) - 1).cast("bigint")
    chars = F.filter(F.split(token_text, ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0).cast("bigint"), lambda a, c: F.shiftleft(a, 6) + digit(c))


def unpacked(number: Column) -> Column:
    """Token text of a packed number."""
    at = lambda k: F.shiftright(number, k * 6).bitwiseAND(F.lit(63))
    one = lambda k: F.when(F.shiftright(number, k * 6) > 0, F.substring(F.lit(ALPHABET), at(k).cast("int") + 1, F.lit(1))).otherwise(F.lit(""))
    return F.concat(*(one(k) for k in range(9, -1, -1)))


def pack_rows(value: int) -> str:
    """Token text of a packed number, on the driver."""
    out = ""
    while value:
        out = ALPHABET[value & 63] + out
        value >>= 6
    return out


def pack_value(token_text: str) -> int:
    out = 0
    for c in token_text:
        out = out << 6 | ALPHABET.index(c)
    return out

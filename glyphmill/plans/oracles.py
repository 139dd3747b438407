"""DuckDB SQL for the queries of the catalogue, written independently of the Spark plans, from shared pieces of WITH."""

from __future__ import annotations

# Fixed values, written out on their own: token t is the t-th character; 1 to 26 are letters, 27 the separator, 28 to 48
# accented letters, 62 the end of a sentence, 63 unknown.
ALPHABET = "-0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz"
SEPARATOR, SENTENCE_END, UNKNOWN = "Q", "y", "z"
_PLAIN = "abcdefghijklmnopqrstuvwxyz" + "éèëïöüáàóòúçêâîôûñßæœ"
_OWN = "0123456789ABCDEFGHIJKLMNOP" + "RSTUVWXYZ_abcdefghijk"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + "ÉÈËÏÖÜÁÀÓÒÚÇÊÂÎÔÛÑÆŒ"
_OF_CAPITALS = "0123456789ABCDEFGHIJKLMNOP" + "RSTUVWXYZ_abcdefghjk"
SOURCE, TARGET = _PLAIN + _CAPITALS + " -_,.", _OWN + _OF_CAPITALS + "QQQQy"
_K = _PLAIN + _CAPITALS + " _,.\\-"
WS = "[\\t\\n\\x0B\\f\\r\\x1C-\\x1F \\x{1680}\\x{2000}-\\x{2006}\\x{2008}-\\x{200A}\\x{2028}\\x{2029}\\x{205F}\\x{3000}]"


def stream(text: str) -> str:
    framed = f"regexp_replace(' ' || coalesce({text}, '') || ' ', '{WS}+', ' ', 'g')"
    return f"translate(regexp_replace({framed}, '[^{_K}]', '', 'g'), '{SOURCE}', '{TARGET}')"


def encode_all(text: str) -> str:
    return f"translate(regexp_replace({text}, '[^{_K}]', chr(1), 'g'), '{SOURCE}' || chr(1), '{TARGET}{UNKNOWN}')"


def decode(tt: str) -> str:
    return f"translate({tt}, '{_OWN}Qyz', '{_PLAIN} .?')"


_LETTERS = [c for c in ALPHABET[1:62] if c != SEPARATOR]
_RUN4 = "|".join(f"{c}{{4}}" for c in _LETTERS)
_RUN3 = "|".join(f"{c}{{3}}" for c in _LETTERS)


def accepted(w: str) -> str:
    return f"NOT (regexp_matches({w}, '{_RUN4}') OR (regexp_matches({w}, '{_RUN3}') AND (length({w}) <= 5 OR len(list_distinct(string_split({w}, ''))) <= 3)))"


STREAMS = f"s AS MATERIALIZED (SELECT doc_id, lang, {stream('text')} AS tt FROM documents)"
WORDS = "w AS (SELECT doc_id, lang, tt FROM (SELECT doc_id, lang, unnest(string_split_regex(tt, '[Qy-]+')) AS tt FROM s) WHERE tt <> '')"
COUNTS = f"wc AS MATERIALIZED (SELECT tt, {decode('tt')} AS word, count(*)::BIGINT AS cnt FROM w GROUP BY tt HAVING {accepted('tt')})"
DICT = "d AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY tt COLLATE \"C\") - 1)::BIGINT AS idx, tt, word, length(tt)::INT AS length FROM wc)".replace(' COLLATE "C"', "")


def raw_words(table: str, text: str = "text") -> str:
    """Distinct lower-cased words of a table, as the queries that ask the dictionary."""
    return f"q AS MATERIALIZED (SELECT query, {encode_all('query')} AS q FROM (SELECT DISTINCT unnest(regexp_extract_all({text}, '[\\p{{L}}''-]+')) AS query FROM {table}))"


# Pieces of 64 places with 8 characters of overlap: a substring far into a long text costs its offset.
GRAMS = """gp AS (SELECT substr(tt, 64 * k + 1, 72) AS piece FROM (SELECT tt, unnest(range(0, (length(tt) + 63) // 64)) AS k FROM s)),
g AS MATERIALIZED (SELECT n::INT AS len, gram, count(*)::BIGINT AS cnt FROM
 (SELECT n, substr(piece, i, n) AS gram FROM (SELECT piece, n, unnest(range(1, least(64, length(piece) - n + 1) + 1)) AS i FROM gp, (SELECT unnest(range({a}, {b})) AS n))) GROUP BY ALL)"""
WEIGHT = "floor(ln(1 + cnt) * pow(len, 0.1) + 0.5)::BIGINT"


def vocabulary(a: int = 2, source: str = "g") -> str:
    """Pieces up to ``v`` (token, seq) and ``pat``."""
    presets = ", ".join(f"({t}, '{ALPHABET[t]}')" for t in range(1, 49)) + f", (49, '{SENTENCE_END}')"
    return f"""{GRAMS.format(a=a, b=10)},
 cand AS MATERIALIZED (SELECT gram, len, row_number() OVER (ORDER BY {WEIGHT} DESC, cnt DESC, len, gram) AS rk FROM {source} WHERE len >= 2 QUALIFY rk <= 16384),
 sel AS (SELECT gram, rk FROM cand c WHERE NOT EXISTS (SELECT 1 FROM cand x WHERE x.rk < c.rk AND x.len > c.len AND contains(x.gram, c.gram)) ORDER BY rk LIMIT 205),
 v AS MATERIALIZED (SELECT token::INT AS token, seq FROM (VALUES {presets}) p(token, seq) UNION ALL SELECT (49 + row_number() OVER (ORDER BY rk))::INT, gram FROM sel),
 pat AS MATERIALIZED (SELECT string_agg(seq, '|' ORDER BY length(seq) DESC, seq) AS p FROM v)"""


#: Tokens of the documents as the learner sees them: (doc_id, pos, tok).
TOKENS = """tk AS MATERIALIZED (SELECT doc_id, pos, token AS tok FROM
 (SELECT doc_id, unnest(pieces) AS seq, generate_subscripts(pieces, 1) - 1 AS pos FROM
  (SELECT doc_id, regexp_extract_all(regexp_replace(tt, 'Q+', 'Q', 'g'), (SELECT p FROM pat)) AS pieces FROM s)) JOIN v USING (seq))"""
_LAGS = ", ".join(f"coalesce(lag(tok, {k}) OVER o, 0)::BIGINT AS p{k}" for k in range(1, 9))
HISTORY = f"h AS MATERIALIZED (SELECT doc_id, pos, tok, {_LAGS} FROM tk WINDOW o AS (PARTITION BY doc_id ORDER BY pos))"


def key(strategy: str, kept=range(1, 9), p: str = "p") -> str:
    """Key of a context of which only the tokens in ``kept`` are there."""
    c = {k: f"{p}{k}" if k in kept else "0" for k in range(1, 9)}
    if strategy == "linear":
        b = (c[4], c[3], c[2], c[1])
    elif strategy == "skipping":
        b = (c[7], c[4], c[2], c[1])
    else:
        near = f"({c[2]} = 0 OR {c[3]} = 0)"
        far = f"({near} OR {c[4]} = 0 OR {c[5]} = 0 OR {c[7]} = 0)"
        b = (f"CASE WHEN {far} THEN 0 ELSE xor(({c[7]} & 7) * 32, {c[8]}) END", f"CASE WHEN {near} THEN 0 ELSE xor(({c[3]} & 7) * 32, {c[4]}) END", c[2], c[1])
    return f"({b[0]})::BIGINT * 16777216 + ({b[1]})::BIGINT * 65536 + ({b[2]})::BIGINT * 256 + ({b[3]})::BIGINT"


LEVELS = {
    "linear": [((4, 3, 2, 1), 1), ((3, 2, 1), 1), ((2, 1), 1), ((1,), 1)],
    "skipping": [((7, 4, 2, 1), 1), ((4, 2, 1), 1), ((2, 1), 1), ((1,), 1)],
    "xor": [((1,), 1), ((2, 1), 1), ((3, 2, 1), 1), ((4, 3, 2, 1), 1), ((6, 4, 3, 2, 1), 1), ((7, 6, 4, 3, 2, 1), 1), (range(1, 9), 1)],
}


def counts(strategy: str, source: str = "h", least: int = 1) -> str:
    rows = " UNION ALL ".join(f"SELECT {key(strategy, kept)} AS ctx, tok, doc_id, pos, {w} AS w FROM {source}" for kept, w in LEVELS[strategy])
    more = f", c AS MATERIALIZED (SELECT * FROM c0 QUALIFY sum(cnt) OVER (PARTITION BY ctx) >= {least})" if least > 1 else ", c AS (SELECT * FROM c0)"
    return f"c0 AS MATERIALIZED (SELECT ctx, tok, sum(w)::BIGINT AS cnt, min(doc_id * 4294967296 + pos) AS seen FROM ({rows}) GROUP BY ctx, tok){more}"


MODEL = """m AS MATERIALIZED (SELECT ctx, max(tok) FILTER (rk = 1)::INT AS first, max(tok) FILTER (rk = 2)::INT AS second FROM
 (SELECT ctx, tok, row_number() OVER (PARTITION BY ctx ORDER BY cnt DESC, seen) AS rk FROM c) WHERE rk <= 2 GROUP BY ctx)"""


def prompts(table: str, key_cols: str, text: str = "text") -> str:
    """Contexts of raw texts: (keys, p1..p8)."""
    at = ", ".join(f"coalesce(toks[len(toks) - {k - 1}], 0)::BIGINT AS p{k}" for k in range(1, 9))
    return f"""pieces AS (SELECT {key_cols}, regexp_extract_all({encode_all(f"coalesce({text}, '')")}, (SELECT p FROM pat)) AS ps FROM {table}),
 vm AS (SELECT map_from_entries(list((seq, token))) AS mp FROM v),
 pr AS MATERIALIZED (SELECT {key_cols}, {at} FROM (SELECT {key_cols}, list_transform(ps, lambda x: mp[x]) AS toks FROM pieces, vm))"""


_PS = ", ".join(f"p{k}" for k in range(1, 9))


def _levels(source: str, keys: str) -> str:
    """Rows of contexts, each at the eight levels of back-off, with the key of what is left."""
    kept = ", ".join(f"CASE WHEN {k} <= 8 - level THEN p{k} ELSE 0 END AS c{k}" for k in range(1, 9))
    return f"(SELECT {keys}, level, {_PS}, {key('xor', p='c')} AS ctx FROM (SELECT {keys}, level, {_PS}, {kept} FROM (SELECT *, unnest(range(8)) AS level FROM {source})))"


_SHIFTED = "tok::BIGINT AS p1, " + ", ".join(f"p{k - 1} AS p{k}" for k in range(2, 9))


def generation(steps: int) -> str:
    """gen (item_id, step, p1..p8, txt) by recursion from pr; needs WITH RECURSIVE."""
    keys = "item_id, step, txt"
    hit = f"SELECT {keys}, {_PS}, arg_min(m.first, level) AS tok FROM {_levels(f'(SELECT * FROM gen WHERE step < {steps})', keys)} b JOIN m USING (ctx) GROUP BY ALL"
    return f"""gen AS (SELECT item_id, 0 AS step, '' AS txt, {_PS} FROM pr
 UNION ALL SELECT item_id, step + 1, txt || {decode('v.seq')}, {_SHIFTED} FROM ({hit}) JOIN v ON v.token = tok)"""


def branches(most: int, chars: int) -> tuple[list[str], str]:
    """(pieces, last SELECT) of the breadth-first search from pr, level by level."""
    parts = [f"lv0 AS MATERIALIZED (SELECT item_id, 0::BIGINT AS ord, {_PS}, '' AS txt, 0::BIGINT AS before FROM pr)"]
    for n in range(chars + 1):
        keys = "item_id, ord, txt, before"
        parts += [
            f"ht{n} AS MATERIALIZED (SELECT {keys}, {_PS}, first, CASE WHEN second <> first THEN second END AS second FROM {_levels(f'lv{n}', keys)} LEFT JOIN m USING (ctx) QUALIFY row_number() OVER (PARTITION BY item_id, ord ORDER BY first IS NULL, level) = 1)",
            f"ch{n} AS (SELECT *, 1 + (second IS NOT NULL)::INT AS n, 0 AS child, first AS tok FROM ht{n} UNION ALL SELECT *, 2, 1, second FROM ht{n} WHERE second IS NOT NULL)",
            f"gr{n} AS (SELECT *, CASE WHEN tok IS NULL THEN txt <> '' ELSE length(new) >= {chars} END AS ends FROM (SELECT ch{n}.*, txt || coalesce({decode('v.seq')}, '') AS new FROM ch{n} LEFT JOIN v ON v.token = tok))",
            f"ev{n} AS (SELECT *, before + sum(ends::BIGINT) OVER o AS total, row_number() OVER o AS place FROM gr{n} WINDOW o AS (PARTITION BY item_id ORDER BY ord, child))",
            f"en{n} AS MATERIALIZED (SELECT *, min(place) FILTER (tok IS NOT NULL AND total >= {most} AND (ends OR child = n - 1)) OVER (PARTITION BY item_id) AS stop FROM ev{n} QUALIFY stop IS NULL OR place <= stop)",
            f"ls{n} AS (SELECT item_id, max(total) AS after, bool_or(stop IS NOT NULL) AS over FROM en{n} GROUP BY item_id)",
            f"lv{n + 1} AS MATERIALIZED (SELECT item_id, place AS ord, {_SHIFTED}, left(new, {chars}) AS txt, after::BIGINT AS before FROM en{n} JOIN ls{n} USING (item_id) WHERE NOT ends AND tok IS NOT NULL AND NOT over AND after < {most})",
        ]
    return parts, " UNION ALL ".join(f"SELECT item_id, (total - 1)::BIGINT AS n, left(new, {chars}) AS branch FROM en{n} WHERE ends" for n in range(chars + 1))


def select(*pieces: str, recursive: bool = False) -> str:
    *ctes, last = pieces
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(ctes) + "\n" + last

"""DuckDB SQL for the training-data queries that SQL can express, over whole tables."""

from __future__ import annotations

import string

from glyphmill.llm import licenses
from glyphmill.llm.common import WORD_PATTERN

#: Rows of documents with a number of their own, and their words in order.
_WORDS = """d AS (SELECT row_number() OVER () AS r, doc_id, {text} AS text FROM documents),
w AS MATERIALIZED (SELECT r, doc_id, word, k FROM (SELECT r, doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS k FROM (SELECT r, doc_id, regexp_extract_all(text, '{pattern}') AS ws FROM d)))"""


def _window(n: int) -> str:
    """n words from here, joined by a space, which no word has; null where the text ends before."""
    return " || ' ' || ".join(["word", *(f"lead(word, {i}) OVER o" for i in range(1, n))])


def substring_dedup(window: int = 13) -> str:
    return f"""WITH {_WORDS.format(text="coalesce(text, '')", pattern=WORD_PATTERN)},
g AS MATERIALIZED (SELECT r, doc_id, k, g FROM (SELECT r, doc_id, k, {_window(window)} AS g FROM w WINDOW o AS (PARTITION BY r ORDER BY k)) WHERE g IS NOT NULL),
f AS (SELECT g, min(doc_id) AS least FROM g GROUP BY g),
gone AS (SELECT DISTINCT r, unnest(range(k, k + {window})) AS k FROM g JOIN f USING (g) WHERE least < doc_id),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY k) AS text, count(*) AS n FROM w ANTI JOIN gone USING (r, k) GROUP BY r),
n AS (SELECT r, count(*) AS n FROM w GROUP BY r)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_words, (coalesce(n.n, 0) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN n USING (r) LEFT JOIN kept USING (r)"""


def near_duplicates(n: int = 3, percent: int = 85) -> str:
    lower = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    return f"""WITH RECURSIVE {_WORDS.format(text=lower, pattern=WORD_PATTERN)},
s AS MATERIALIZED (SELECT DISTINCT r, g FROM (SELECT r, {_window(n)} AS g FROM w WINDOW o AS (PARTITION BY r ORDER BY k)) WHERE g IS NOT NULL
 UNION SELECT r, string_agg(word, ' ' ORDER BY k) AS g FROM w GROUP BY r HAVING count(*) < {n}),
n AS MATERIALIZED (SELECT r, count(*) AS n FROM s GROUP BY r),
e AS MATERIALIZED (SELECT a.r AS a, b.r AS b FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r JOIN n x ON x.r = a.r JOIN n y ON y.r = b.r GROUP BY a.r, b.r, x.n, y.n HAVING 100 * count(*) >= {percent} * (x.n + y.n - count(*))),
reach(a, b) AS (SELECT r, r FROM d UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(o.doc_id) AS component_id, d.doc_id = min(o.doc_id) AS kept
FROM d JOIN reach ON reach.a = d.r JOIN d o ON o.r = reach.b LEFT JOIN n ON n.r = d.r GROUP BY d.r, d.doc_id, n.n"""


def license_scan() -> str:
    return licenses.matches_sql()

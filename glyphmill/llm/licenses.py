"""License scan: MinHash retrieval over overlapping text windows, then exact shingle containment. DataFrame functions only.

Texts are cut into lower-case words of letters and digits; a shingle is five words, as a 64-bit fingerprint. A window is
``WINDOW`` shingles (twelve words) and starts at every ``STEP``-th word of a document, but at every word of a template.
Its MinHash signature has ``BANDS`` bands of ``ROWS`` rows; a row is the shingle nearest to a seed in the xor metric, which
is the least one under a random permutation. Windows that agree on a band are a hit, with a chance of
1 - (1 - J**ROWS)**BANDS at Jaccard similarity J: 0.998 at 0.8, 0.78 at 0.5, 0.06 at 0.1.

A document that holds ``CONTAINMENT`` of a template of at least ``SHORT`` shingles, changed by single words, keeps a run of
eleven shingles unbroken; one of its windows lies in that run, equals a template's window (J = 1), and so is a hit for
certain. Templates of fewer distinct shingles have windows of one shingle each, at every word, whose MinHash is the shingle
itself: certain as well. Where shingles occur scattered, none next to its neighbours, a long template isn't retrieved.

Retrieval looks band keys up in a Bloom filter, a literal whose size follows from the number of template keys and not
from the documents; documents with a hit, few, are written to the shared folder, their hits are joined to the table of
template keys, and pairs of document and template are verified: a match holds at least ``CONTAINMENT`` of the template's
distinct shingles. Tables of templates are broadcast if their counted rows are at most ``BROADCAST_ROWS``, else joined by
shuffle. There is no limit on templates: more keys only make the filter less selective beyond ``MOST_BITS``.

Null or blank texts and texts under five words match nothing; templates under five words are refused. Repeated rows and
null ids are judged row by row. Very long texts cost in proportion to their length. An empty table has no matches, and
columns of any other name are ignored.
"""

from __future__ import annotations

import json
import math
import os
import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm.common import let, materialise

SHINGLE, CONTAINMENT = 5, 0.8
#: Shingles of a window, words between two windows of a document, bands and rows of a signature.
WINDOW, STEP, BANDS, ROWS = 8, 4, 6, 2
#: Distinct shingles under which a template's windows are single shingles.
SHORT = 26
#: Bits of the Bloom filter a key, bits at most, probes.
BITS_A_KEY, MOST_BITS, PROBES = 48, 1 << 24, 3
BROADCAST_ROWS = 1_000_000
#: Full texts, a file each.
FOLDER = os.path.join(os.path.dirname(os.path.abspath(__file__)), "license_texts")

#: Notices and opening paragraphs of common licenses, as their authors publish them.
NOTICES = {
    "apache-2.0-short": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "bsd-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "cc-by-4.0-short": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0-long": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc-4.0-short": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0-short": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mit-short": "Released under the MIT License.",
    "mit-permission": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
}


def license_texts(folder: str = FOLDER) -> dict[str, str]:
    """The notices and the full texts of a folder's .txt files, by name."""
    out = dict(NOTICES)
    for name in sorted(os.listdir(folder)):
        if name.endswith(".txt"):
            with open(os.path.join(folder, name), encoding="utf-8") as f:
                out[name.removesuffix(".txt")] = f.read()
    return out


def words_of(text: str) -> list[str]:
    """The words of a template, as ``word_hashes`` cuts a text."""
    return [w for w in re.split("[^a-z0-9]+", text.lower()) if w]


def word_hashes(text: Column) -> Column:
    """Fingerprints of a text's words."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def shingle_column(text: Column) -> Column:
    """64-bit fingerprints of all runs of five words; empty under five words."""

    def runs(h: Column) -> Column:
        made = F.transform(F.sequence(F.lit(0), F.size(h) - SHINGLE), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(SHINGLE))))
        return F.when(F.size(h) >= SHINGLE, made).otherwise(F.array().cast("array<bigint>"))

    return let(word_hashes(text), runs)


def _seed(k: int) -> int:
    """Spread over the range, so that different rows ask different parts of it."""
    return (k * 0x9E3779B97F4A7C15 + (1 << 63)) % (1 << 64) - (1 << 63)


def window_keys(s: Column, start: Column) -> list[Column]:
    """Band keys of the window that begins at shingle ``start`` (from 0) of an array of shingles."""

    def bands(w: Column) -> Column:
        row = lambda k: F.array_min(F.transform(w, lambda x: x.bitwiseXOR(F.lit(_seed(k)))))
        return F.array(*(F.xxhash64(F.lit(b), *(row(b * ROWS + r) for r in range(ROWS))) for b in range(BANDS)))

    return let(F.slice(s, start + 1, F.lit(WINDOW)), bands)


def _starts(n: Column, step: int) -> Column:
    """First shingles of windows over n shingles; the last window ends with the text."""
    last = F.greatest(n - WINDOW, F.lit(0))
    return F.when(n > 0, F.array_union(F.sequence(F.lit(0), last, F.lit(step)), F.array(last))).otherwise(F.array().cast("array<int>"))


def _all_windows(s: Column, step: int) -> Column:
    return F.flatten(F.transform(_starts(F.size(s), step), lambda i: window_keys(s, i)))


class Templates:
    """Tables (template, key) and (template, shingles, n), and the Bloom filter of the keys."""

    def __init__(self, spark: SparkSession, templates: Mapping[str, str]):
        short = [k for k, t in templates.items() if len(words_of(t)) < SHINGLE]
        if short:
            raise ValueError(f"templates under {SHINGLE} words: {short}")
        d = spark.createDataFrame([(k, t) for k, t in templates.items()], "template string, text string")
        runs = d.select("template", shingle_column(F.col("text")).alias("s"))
        own = runs.select("template", F.array_distinct("s").alias("shingles"), "s").withColumn("n", F.size("shingles"))
        keys = F.when(F.col("n") < SHORT, F.col("shingles")).otherwise(_all_windows(F.col("s"), 1))
        rows = own.select("template", "shingles", "n", F.array_distinct(keys).alias("keys")).collect()  # the driver gave the templates
        self.sets = spark.createDataFrame([(r["template"], r["shingles"], r["n"]) for r in rows], "template string, shingles array<bigint>, n int")
        pairs = [(r["template"], k) for r in rows for k in r["keys"]]
        self.keys = spark.createDataFrame(pairs, "template string, key bigint")
        self.small = len(pairs) <= BROADCAST_ROWS and sum(r["n"] for r in rows) <= BROADCAST_ROWS
        self.bits = min(MOST_BITS, 1 << max(10, math.ceil(math.log2(BITS_A_KEY * max(1, len(pairs))))))
        field = [0] * (self.bits // 64)
        for _, k in pairs:
            for p in range(PROBES):
                at = (k >> (p * 20)) & (self.bits - 1)
                field[at >> 6] |= 1 << (at & 63)
        # Folded into one literal before the query runs.
        self.filter = F.from_json(F.lit(json.dumps([v - (1 << 64) if v >> 63 else v for v in field])), "array<bigint>")

    def near(self, key: Column) -> Column:
        """False only for keys that no template has."""
        out = None
        for p in range(PROBES):
            at = F.shiftright(key, p * 20).bitwiseAND(F.lit(self.bits - 1))
            bit = F.getbit(F.get(self.filter, F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63)).cast("int")) == 1
            out = bit if out is None else out & bit
        return out

    def broadcast(self, table: DataFrame) -> DataFrame:
        return F.broadcast(table) if self.small else table


def matches(docs: DataFrame, templates: Mapping[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, template, containment: a row for each document and template found in it."""
    templates = license_texts() if templates is None else templates
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if not templates:
        return d.where("false").select("doc_id", F.lit("").alias("template"), F.lit(0.0).alias("containment"))
    t = Templates(d.sparkSession, templates)

    def hits(s: Column) -> Column:
        windows = F.transform(_starts(F.size(s), STEP), lambda i: F.filter(window_keys(s, i), t.near))
        return F.struct(s.alias("s"), F.array_distinct(F.concat(F.filter(s, t.near), F.flatten(windows))).alias("keys"))

    scanned = d.select(F.monotonically_increasing_id().alias("row"), "doc_id", let(shingle_column(F.col("text")), hits).alias("h"))
    some = materialise(scanned.select("row", "doc_id", "h.s", "h.keys").where(F.size("keys") > 0), "license-hits")
    pairs = some.select("row", F.explode("keys").alias("key")).join(t.broadcast(t.keys), "key").select("row", "template").distinct()
    held = F.size(F.array_intersect("s", "shingles")) / F.col("n")
    found = pairs.join(some.select("row", "doc_id", "s"), "row").join(t.broadcast(t.sets), "template").select("doc_id", "template", held.alias("containment"))
    return found.where(F.col("containment") >= CONTAINMENT)


def matches_sql(templates: Mapping[str, str] | None = None) -> str:
    """The same rows in DuckDB's SQL by comparing all shingles, without retrieval."""
    templates = license_texts() if templates is None else templates
    quoted = ", ".join("('{}', '{}')".format(k, t.replace("'", "''")) for k, t in templates.items())
    cut = "list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda w: w <> '')"
    grams = "list_transform(range(1, greatest(len(w) - 3, 1)), lambda i: array_to_string(w[i:i+4], ' '))"
    return f"""
    WITH t(name, body) AS (VALUES {quoted}),
    ts AS (SELECT DISTINCT name, unnest({grams}) AS g FROM (SELECT name, {cut.format('body')} AS w FROM t)),
    d AS (SELECT row_number() OVER () AS r, doc_id, {cut.format("coalesce(text, '')")} AS w FROM documents),
    ds AS (SELECT DISTINCT r, doc_id, g FROM (SELECT r, doc_id, unnest({grams}) AS g FROM d) WHERE g IN (SELECT g FROM ts)),
    n AS (SELECT name, count(*) AS n FROM ts GROUP BY name)
    SELECT doc_id, name AS template, count(*)::DOUBLE / any_value(n) AS containment
    FROM ds JOIN ts USING (g) JOIN n USING (name) GROUP BY r, doc_id, name
    HAVING count(*)::DOUBLE / any_value(n) >= {CONTAINMENT}
    """

"""Markup filter, link discovery and text scanners of the corpus reader."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_markup(text: Column, strict_end: bool = False) -> Column:
    """Text of ``<doc …>`` elements without tags.

    What stands before the first document tag goes; a document tag becomes a space, any other tag nothing. An unclosed
    ``<`` swallows the rest. The end tag is just another tag, so text after it stays; with ``strict_end`` it ends
    the document as its writer meant.
    """
    parts = F.regexp_extract_all(F.regexp_replace(text, "<[^>]*$", ""), F.lit("<[^>]*>|[^<]+"), 0)
    is_doc = lambda p: F.lower(F.trim(F.concat(F.lit("<"), F.ltrim(F.substring(p, 2, 1_000_000))))).startswith("<doc ") & F.startswith(p, F.lit("<"))
    if strict_end:
        state = F.aggregate(
            parts,
            F.struct(F.lit(False).alias("on"), F.lit("").alias("s")),
            lambda a, p: F.when(is_doc(p), F.struct(F.lit(True).alias("on"), F.concat(a["s"], F.lit(" ")).alias("s")))
            .when(F.lower(p) == "</doc>", F.struct(F.lit(False).alias("on"), F.concat(a["s"], F.lit(" ")).alias("s")))
            .when(a["on"] & ~F.startswith(p, F.lit("<")), F.struct(a["on"].alias("on"), F.concat(a["s"], p).alias("s")))
            .otherwise(F.struct(a["on"].alias("on"), a["s"].alias("s"))),
            lambda a: a["s"],
        )
        return state
    kinds = F.transform(parts, lambda p: F.when(is_doc(p), F.lit(" ")).when(F.startswith(p, F.lit("<")), F.lit("")).otherwise(p))
    first = F.array_position(F.transform(parts, is_doc), True)
    return F.when(first > 0, F.array_join(F.slice(kinds, first.cast("int"), F.greatest(F.size(parts), F.lit(1))), "")).otherwise(F.lit(""))


def dump_dates(html: Column) -> Column:
    """Dates of an index page's links, as yyyyMMdd strings."""
    return F.regexp_extract_all(html, F.lit('href="(\\d{8})/"'), 1)


def article_dump(html: Column) -> Column:
    """File name of the first link to an articles dump; null without one."""
    link = F.regexp_extract(html, 'href="([^"]*pages-articles-multistream\\.xml\\.bz2)"', 1)
    return F.when(link != "", F.element_at(F.split(link, "/"), -1))


def input_words(text: Column) -> Column:
    """Array of (word, start, end) of maximal runs of letters, apostrophes and hyphens; offsets are half-open."""
    words = F.regexp_extract_all(text, F.lit(r"[\p{L}'-]+"), 0)
    gaps = F.split(text, r"[\p{L}'-]+", -1)
    return F.aggregate(
        F.arrays_zip(F.slice(gaps, F.lit(1), F.size(words)).alias("g"), words.alias("w")),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<word:string,start:int,end:int>>").alias("out")),
        lambda a, x: F.struct(
            (a["at"] + F.length(x["g"]) + F.length(x["w"])).alias("at"),
            F.concat(a["out"], F.array(F.struct(x["w"].alias("word"), (a["at"] + F.length(x["g"])).alias("start"), (a["at"] + F.length(x["g"]) + F.length(x["w"])).alias("end")))).alias("out"),
        ),
        lambda a: a["out"],
    )

"""Whole page elements, whatever is nested in them, as Column expressions.

A page is cut into tags and the texts between them; one pass over the tags counts how deep an element of the
same name lies, and it ends where that depth returns to none. Every text between two tags is a text node.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from nestfold.functions.text import once

# A comment, a script or style with what it holds, or a tag, whose quoted attributes may hold ">".
# The "<" stands before all alternatives, so that text between tags is passed over quickly.
TAG = (
    r"(?s)<(?:!--.*?-->|(?i:script)\b[^>]*>.*?</(?i:script)\s*>|(?i:style)\b[^>]*>.*?</(?i:style)\s*>"
    r"""|/?[a-zA-Z](?:[^>"']++|"[^"]*+"|'[^']*+')*+>|/?[a-zA-Z][^>]*+>|![^>]*+>)"""
)
_NAME = r"^</?([a-zA-Z][a-zA-Z0-9:-]*)"
# Elements that hold nothing, and those that end an open paragraph (fixed values of HTML).
VOID = "area base br col embed hr img input link meta param source track wbr".split()
ENDS_PARAGRAPH = (
    "address article aside blockquote body dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table td th tr ul"
).split()
_STATE = "struct<i:int,name:string,depth:int,start:int,spans:array<struct<a:int,b:int>>>"


def _spans(tags: Column, wanted: Callable[[Column], Column]) -> Column:
    """Pairs (number of the opening tag, number of the tag that ends it) of the outermost wanted elements."""

    # What each tag says by itself is told once a tag, and the depth after it once a step.
    def told(t: Column) -> Column:
        named = F.struct(F.lower(F.regexp_extract(t, _NAME, 1)).alias("name"), t.startswith("</").alias("closes"), t.alias("tag"))
        return once(named, lambda x: F.struct(x["name"].alias("name"), x["closes"].alias("closes"), holds(x).alias("holds"), (holds(x) & wanted(x["tag"])).alias("wanted")))

    def holds(x: Column) -> Column:
        return ~x["closes"] & ~x["tag"].endswith("/>") & ~x["name"].isin("", "script", "style", *VOID)

    def step(s: Column, x: Column) -> Column:
        inside = s["depth"] > 0
        ends = (s["name"] == "p") & x["name"].isin(ENDS_PARAGRAPH)
        by = F.when(x["name"] != s["name"], 0).when(x["closes"], -1).when(x["holds"], 1).otherwise(0)
        depth = F.when(~inside, 0).when(ends, 0).otherwise(s["depth"] + by)
        return once(depth, lambda d: moved(s, x, d))

    def moved(s: Column, x: Column, depth: Column) -> Column:
        done = (s["depth"] > 0) & (depth == 0)
        begins = (depth == 0) & x["wanted"]
        span = F.struct(s["start"].alias("a"), s["i"].alias("b"))
        return F.struct(
            (s["i"] + 1).alias("i"),
            F.when(begins, x["name"]).otherwise(s["name"]).alias("name"),
            F.when(begins, 1).otherwise(depth).alias("depth"),
            F.when(begins, s["i"]).otherwise(s["start"]).alias("start"),
            F.when(done, F.array_append(s["spans"], span)).otherwise(s["spans"]).alias("spans"),
        ).cast(_STATE)

    def finish(s: Column) -> Column:
        # What is never closed runs to the end of the page.
        return F.when(s["depth"] > 0, F.array_append(s["spans"], F.struct(s["start"].alias("a"), s["i"].alias("b")))).otherwise(s["spans"])

    none = F.array().cast("array<struct<a:int,b:int>>")
    init = F.struct(F.lit(0).alias("i"), F.lit("").alias("name"), F.lit(0).alias("depth"), F.lit(-1).alias("start"), none.alias("spans")).cast(_STATE)
    return F.aggregate(F.transform(tags, told), init, step, finish)


def elements(html: Column, wanted: Callable[[Column], Column]) -> Column:
    """Array of (``tag``, ``inner``, ``texts``) for the outermost elements whose opening tag is ``wanted``, in order.

    ``inner`` is their markup and ``texts`` their text nodes, those of nested elements included; comments,
    scripts and styles are none. Names are told in any case. Elements without an end run to the end of
    the page, paragraphs to the next block. A null page has no elements.
    """

    def read(page: Column) -> Column:
        def one(span: Column) -> Column:
            n = span["b"] - span["a"]
            gaps, tags = F.slice(page["gaps"], span["a"] + 2, n), F.slice(page["tags"], span["a"] + 2, n - 1)
            markup = F.zip_with(gaps, tags, lambda g, t: F.concat(g, F.coalesce(t, F.lit(""))))
            return F.struct(F.get(page["tags"], span["a"]).alias("tag"), F.array_join(markup, "").alias("inner"), F.filter(gaps, lambda g: g != "").alias("texts"))

        return F.transform(_spans(page["tags"], wanted), one)

    def cut(page: Column) -> Column:
        return F.struct(F.regexp_extract_all(page, F.lit(TAG), F.lit(0)).alias("tags"), F.split(page, TAG, -1).alias("gaps"))

    # A page that is itself made by reading another is made once.
    return F.coalesce(once(html, lambda page: once(cut(page), read)), F.array().cast("array<struct<tag:string,inner:string,texts:array<string>>>"))


def matching(pattern: str) -> Callable[[Column], Column]:
    """Opening tags that match a pattern, such as ``html.of_class`` and ``html.tag_of`` make."""
    return lambda tag: tag.rlike(f"^(?i:{pattern})")


def all_texts(found: Column) -> Column:
    """The text nodes of all elements found, joined with a space each."""
    return F.array_join(F.flatten(F.transform(found, lambda e: e["texts"])), " ")

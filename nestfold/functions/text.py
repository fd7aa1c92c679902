"""Text normalisation, markup and hashing as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from nestfold.functions.space import SPACE, full_strip
from nestfold.functions.vocab import literal_map

# The word class, written out so that it means the same for every script: letters, digits and
# other numerals (so "m²" stays a word), underscore.
WORD = r"\p{L}\p{N}_"

# Named character references of HTML, from the standard library's table.
ENTITIES = {**{name: chr(code) for name, code in name2codepoint.items()}, "apos": "'"}
_REFERENCE = r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);"


def squeeze(c: Column) -> Column:
    """Collapse runs of whitespace to one space and strip the ends."""
    return F.trim(F.regexp_replace(c, f"(?U)[{SPACE}]+", " "))


def normalize_title(c: Column) -> Column:
    """Lower case, punctuation to spaces, single spaces, no blanks at the ends."""
    words = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), f"(?U)[^{WORD}{SPACE}]", " ")
    return squeeze(words)


def content_hash(c: Column) -> Column:
    """Stable hash of a text that ignores outer whitespace; null counts as empty."""
    return F.sha1(full_strip(F.coalesce(c, F.lit(""))))


def _resolve_reference(ref: Column) -> Column:
    return once(F.substr(ref, F.lit(2), F.length(ref) - 2), lambda body: _resolve_body(ref, body))


def _resolve_body(ref: Column, body: Column) -> Column:
    is_hex = body.rlike("^#[xX]")
    is_num = body.startswith("#")
    digits = F.regexp_replace(body, "^#[xX]?0*", "")
    code = F.when(is_hex & (F.length(digits) <= 8), F.conv(digits, 16, 10)).when(~is_hex & is_num, digits)
    code = code.try_cast("bigint")
    valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    char = F.decode(F.unhex(F.lpad(F.hex(F.when(valid, code)), 8, "0")), "UTF-32")
    return F.coalesce(F.when(is_num, char).otherwise(F.try_element_at(literal_map(ENTITIES), body)), ref)


def once(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use(c)`` with ``c`` evaluated a single time however often ``use`` refers to it.

    Long text chains inside ``when`` or higher-order functions are otherwise worked out
    again at every mention.
    """
    return F.get(F.transform(F.array(c), lambda x: use(x)), F.lit(0))


def _unescape_one(c: Column) -> Column:
    gaps = F.split(c, _REFERENCE, -1)
    refs = F.transform(F.regexp_extract_all(c, F.lit(_REFERENCE), F.lit(0)), _resolve_reference)
    joined = F.array_join(
        F.zip_with(gaps, refs, lambda g, r: F.concat(g, F.coalesce(r, F.lit("")))), ""
    )
    return F.when(c.contains("&"), joined).otherwise(c)


def unescape(c: Column) -> Column:
    """Resolve numeric and named references, each exactly once; unknown names stay."""
    return once(c, _unescape_one)


def strip_markup(c: Column) -> Column:
    """Markup to text: line breaks kept, tags dropped, references resolved, ends stripped."""
    broken = F.regexp_replace(c, r"(?i)<br\s*/?>", "\n")
    return full_strip(unescape(F.regexp_replace(broken, "<[^>]+>", "")))


def clean_inline(c: Column) -> Column:
    """Markup to one line of text: tags become spaces, whitespace is collapsed."""
    return squeeze(F.regexp_replace(c, "<[^>]+>", " "))


def has_hashtag(text: Column, tag: str) -> Column:
    """True when ``tag`` stands in ``text`` as a whole tag, in any case and script."""
    pattern = f"(?iu){_quote(tag)}(?![{WORD}])"
    return F.coalesce(text.rlike(pattern), F.lit(False))


def _quote(literal: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", literal)

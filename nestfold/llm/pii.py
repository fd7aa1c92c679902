"""Personal data in DataFrame functions alone: patterns propose spans, checksums confirm them, and words
nearby move their score.

The patterns take every run of characters once (possessive, and started only where a run starts), so long
texts cost one pass for each kind and no recursion.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEAR = 40  # characters before and after a span whose words count
_CHUNK = 64


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, the value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def sums_before(values: Column) -> Column:
    """For each place of a non-empty array the sum of all values before it, in chunks: no square of its length."""
    total = lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda a, b: a + b)
    places = lambda n: F.sequence(F.lit(0), n - 1)

    def chunked(chunks: Column) -> Column:
        def based(bases: Column) -> Column:
            one = lambda c: let(
                chunks[c], lambda part: F.transform(places(F.size(part)), lambda k: bases[c] + total(F.slice(part, F.lit(1), k)))
            )
            return F.flatten(F.transform(places(F.size(chunks)), one))

        sums = F.transform(chunks, total)
        return let(let(sums, lambda s: F.transform(places(F.size(s)), lambda c: total(F.slice(s, F.lit(1), c)))), based)

    cuts = F.sequence(F.lit(1), F.size(values), F.lit(_CHUNK))
    return let(F.transform(cuts, lambda at: F.slice(values, at, F.lit(_CHUNK))), chunked)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]+", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    return F.call_function("luhn_check", number)


def small_parts(text: Column) -> Column:
    """All numbers between the dots are at most 255."""
    bare = lambda p: F.regexp_replace(p, "^0+", "")
    return F.forall(F.split(text, r"\."), lambda p: (F.length(bare(p)) <= 3) & (F.coalesce(bare(p).try_cast("int"), F.lit(0)) <= 255))


def mod97(text: Column) -> Column:
    """The check number of an account number: its first four characters behind, letters as 10 to 35."""
    bare = F.regexp_replace(text, " ", "")
    turned = F.concat(F.substring(bare, 5, 100), F.substring(bare, 1, 4))

    def step(acc: Column, c: Column) -> Column:
        return F.when(c <= "9", (acc * 10 + F.ascii(c) - 48) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)

    letters = F.transform(F.sequence(F.lit(1), F.length(turned)), lambda k: F.substring(turned, k, F.lit(1)))
    return F.aggregate(letters, F.lit(0), step) == 1


@dataclass(frozen=True)
class Kind:
    """``certain``: its score by itself; ``words``: what nearby raises it; ``base``: kept whatever the score."""

    name: str
    pattern: str
    valid: Callable[[Column], Column]
    certain: float
    words: str
    gate: str | None = None
    base: bool = True


KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda m: F.lit(True), 0.8, "mail|contact|write|reply|address", "@"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", small_parts, 0.5, "ip|host|server|address|client|login|addr"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", lambda m: F.length(digits(m)).between(16, 19) & luhn(digits(m)), 0.7, "card|visa|mastercard|credit|debit|payment|pay|cvv|expires"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: F.length(digits(m)).between(8, 15), 0.6, "phone|call|tel|mobile|cell|fax|whatsapp|contact", "+"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", mod97, 0.8, "iban|account|bank|transfer|konto|cuenta|compte", base=False),
    Kind("amex", r"(?<![0-9])3[47][0-9]{2}[\x20-]?[0-9]{6}[\x20-]?[0-9]{5}(?![0-9])", lambda m: luhn(digits(m)), 0.4, "card|amex|credit|payment|pay|expires", base=False),
)
AGAINST = "example|sample|test|dummy|version|isbn|order|invoice|serial"
LEAST_SCORE = 0.5  # of a span that isn't a base one


def _of_kind(text: Column, kind: Kind) -> Column:
    """The valid spans of one kind in order of their start."""

    def placed(found: Column, gaps: Column, before: Column) -> Column:
        def one(k: Column) -> Column:
            start = before[k] + F.length(gaps[k])
            around = F.lower(F.concat_ws(" ", F.right(gaps[k], F.lit(NEAR)), F.left(gaps[k + 1], F.lit(NEAR))))
            score = (
                F.lit(kind.certain)
                + F.when(around.rlike(rf"\b(?:{kind.words})"), 0.2).otherwise(0.0)
                - F.when(around.rlike(rf"\b(?:{AGAINST})\b"), 0.2).otherwise(0.0)
            )
            return F.struct(
                F.lit(kind.name).alias("kind"), start.alias("start"), (start + F.length(found[k])).alias("end"), found[k].alias("text"), F.round(score, 2).alias("score")
            )

        good = F.filter(F.sequence(F.lit(0), F.size(found) - 1), lambda k: kind.valid(found[k]))
        out = F.transform(good, one)
        return out if kind.base else F.filter(out, lambda s: s["score"] >= LEAST_SCORE)

    def measured(found: Column, gaps: Column) -> Column:
        lengths = F.transform(found, lambda m, k: (F.length(m) + F.length(gaps[k])).cast("long"))
        return let(sums_before(lengths), lambda before: placed(found, gaps, before))

    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,text:string,score:double>>")
    some = lambda found: F.when(
        F.exists(found, kind.valid), let(F.split(text, kind.pattern, -1), lambda gaps: measured(found, gaps))
    ).otherwise(none)
    spans = let(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)), some)
    return F.when(F.contains(text, F.lit(kind.gate)), spans).otherwise(none) if kind.gate else spans


def find_personal_data(docs: DataFrame, text_col: str = "text", name: str = "pii", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """``docs`` with ``pii``: an array of (kind, start, end, text, score), by kind as listed, then start.

    Matches of a kind are leftmost and don't overlap; one that fails its check is dropped and not tried
    again. Starts and ends count code points, the end exclusive. Base kinds are kept at any score,
    the others from LEAST_SCORE on. Words count as far as the neighbouring match of the same kind.

    A null text is empty and holds nothing. Everything is worked out inside a row: repeated rows
    get equal results, other columns are carried along, and one called ``name`` is replaced.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.withColumn(name, let(text, lambda t: F.concat(*(_of_kind(t, k) for k in kinds))))


def written(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

"""Quality rules in DataFrame functions alone, with adaptive thresholds from mergeable quantile sketches.

Counts are made inside each row. Their ratios go into one quantile sketch for each language and source: counts in
buckets whose bounds grow by GAMMA, with the least and largest value of each. Sketches merge by adding, into those of a
language and of all, which the quantiles of small groups are blended with by their rows. Nothing is drawn by chance, so that
reruns agree. The fences drawn from the quantiles are joined back to the counts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nestfold.llm.mixing import WORD
from nestfold.llm.pii import let
from nestfold.session import cut

WINDOW = 5
GAMMA = 1.002  # of a sketch's buckets: a quantile is off by a five-hundredth of itself at most, and exact in a bucket of one value
_NOTHING = -(1 << 30)  # the bucket of zero

# Ratio -> (what it is, how far beyond the quartiles in quartile ranges, the quantile that passes in any case, whether
# small values are odd as well). Most texts repeat nothing and good ones a little, so that quartiles say nothing there
# and only the last hundredth of a group is odd; any symbol is odd where three quarters of the texts have none.
# Symbols are no part of a word's length, so that they are told once, as symbols.
RATIOS: dict[str, tuple[str, float, float, bool]] = {
    "word_length": ("(word_chars - n_symbols) / n_words", 3.0, 0.9, True),
    "symbol_share": ("n_symbols / word_chars", 3.0, 0.75, False),
    "dup_line_share": ("n_dup_lines / greatest(n_lines, 1)", 3.0, 0.99, False),
    "repeat_share": ("n_repeat_words / n_words", 3.0, 0.99, False),
}


def repeated_words(words: Column) -> Column:
    """Words in WINDOW-word windows found twice or more, the first included; a word counts once."""
    longs = lambda n: F.lit(n).cast("long")

    def covered(at: Column) -> Column:
        gaps = F.sequence(F.lit(1), F.size(at) - 1)
        return F.aggregate(gaps, longs(WINDOW), lambda acc, k: acc + F.least(F.lit(WINDOW), at[k] - at[k - 1]))

    def placed(pairs: Column) -> Column:
        same = lambda k, other: F.coalesce(F.get(pairs, k)["h"] == F.get(pairs, other)["h"], F.lit(False))
        twice = F.filter(F.sequence(F.lit(0), F.size(pairs) - 1), lambda k: same(k, k - 1) | same(k, k + 1))
        return let(F.sort_array(F.transform(twice, lambda k: F.get(pairs, k)["at"])), covered)

    def windows(h: Column) -> Column:
        one = lambda k: F.xxhash64(*(h[k + j] for j in range(WINDOW)))
        return F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), one)

    def counted(w: Column) -> Column:
        pairs = F.sort_array(F.transform(w, lambda x, k: F.struct(x.alias("h"), k.alias("at"))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), longs(0)).otherwise(let(pairs, placed))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < WINDOW, longs(0)).otherwise(let(hashed, lambda h: let(windows(h), counted)))


def signals(text: Column) -> Column:
    """A struct of the counts of a text; a null one has none."""

    def of_words(words: Column) -> list[Column]:
        chars = F.aggregate(words, F.lit(0).cast("long"), lambda acc, w: acc + F.length(w))
        return [F.size(words).cast("long").alias("n_words"), chars.alias("word_chars"), repeated_words(words).alias("n_repeat_words")]

    def of_lines(lines: Column) -> list[Column]:
        return [F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines")]

    text = F.coalesce(text.cast("string"), F.lit(""))
    symbols = F.length(F.regexp_replace(text, r"[^#*$%&|<>]++", "")).cast("long").alias("n_symbols")
    words = let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.struct(*of_words(w)))
    lines = let(F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD)), lambda x: F.struct(*of_lines(x)))
    return F.struct(words.alias("words"), lines.alias("lines"), symbols)


def count_signals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``(id, lang, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words)`` of each row."""
    counted = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), signals(F.col(text_col)).alias("s"))
    return counted.select("id", "lang", "source", "s.words.n_words", "s.words.word_chars", "s.n_symbols", "s.lines.n_lines", "s.lines.n_dup_lines", "s.words.n_repeat_words")


def thresholds(counted: DataFrame, least_rows: int = 100) -> DataFrame:
    """``(lang, source, fences)``: for each ratio the least and the largest value that passes, rounded outward to hundredths.

    They are drawn from the quantiles alone, without a least distance. Quantiles of a group of n texts, fewer
    than ``least_rows``, count n / ``least_rows`` and those of its language the rest; a language of
    fewer is blended so with all texts.
    """
    values = F.array(*(F.struct(F.lit(name).alias("ratio"), F.expr(f"cast({what} as double)").alias("value")) for name, (what, *_) in RATIOS.items()))
    ratios = counted.select("lang", "source", F.inline(values)).filter("value is not null")
    bucket = F.when(F.col("value") <= 0, F.lit(_NOTHING)).otherwise(F.floor(F.ln("value") / math.log(GAMMA)).cast("int"))
    ratios = ratios.groupBy("lang", "source", "ratio", bucket.alias("bucket"))
    sketched = cut(ratios.agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")))

    def merge(keys: list[str]) -> DataFrame:
        return sketched.groupBy(*keys, "ratio", "bucket").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))

    def quantiles(merged: DataFrame, keys: list[str], name: str) -> DataFrame:
        """``n_<name>`` and a struct ``name``: for each ratio the least passing, lower, upper and largest passing quantile."""
        of_ratio = Window.partitionBy(*keys, "ratio")
        merged = merged.withColumn("upto", F.sum("n").over(of_ratio.orderBy("bucket"))).withColumn("total", F.sum("n").over(of_ratio))
        wanted = F.create_map(*(F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for r, (_, _, tail, _) in RATIOS.items() for x in (r, (1 - tail, 0.25, 0.75, tail))))

        def at(k: int) -> Column:
            rank = F.greatest(F.lit(1), F.ceil(F.get(F.element_at(wanted, F.col("ratio")), F.lit(k)) * F.col("total")))
            before = F.col("upto") - F.col("n")
            inside = F.coalesce(F.try_divide(rank - before - 1, F.col("n") - 1), F.lit(0.0))
            return F.max(F.when((before < rank) & (rank <= F.col("upto")), F.col("lo") + (F.col("hi") - F.col("lo")) * inside))

        found = merged.groupBy(*keys, "ratio").agg(F.max("total").alias("n"), F.array(*map(at, range(4))).alias("at"))
        of = lambda r: F.max(F.when(F.col("ratio") == r, F.col("at"))).alias(r)
        found = found.groupBy(*keys).agg(F.max("n").alias(f"n_{name}"), *map(of, RATIOS))
        return found.select(*keys, f"n_{name}", F.struct(*RATIOS).alias(name))

    def blend(r: str) -> Column:
        own, shared, overall = (F.col(name)[r] for name in ("own", "shared", "overall"))
        mine, lang = (F.least(F.col(n) / least_rows, F.lit(1.0)) for n in ("n_own", "n_shared"))
        # Weights of exactly 1 and 0 leave a quantile as it is.
        toward = lambda w, x, y: F.zip_with(x, y, lambda a, b: w * a + (1 - w) * b)
        return toward(mine, own, toward(lang, shared, overall)).alias(r)

    def fence(r: str) -> Column:
        _, times, _, low = RATIOS[r]
        first, q1, q3, last = (F.col(r)[k] for k in range(4))
        beyond = (q3 - q1) * times
        floor = F.floor(F.least(q1 - beyond, first) * 100) / 100 if low else F.lit(None).cast("double")
        return F.struct(floor.alias("lo"), (F.ceil(F.greatest(q3 + beyond, last) * 100) / 100).alias("hi")).alias(r)

    own = quantiles(sketched, ["lang", "source"], "own")
    by_lang = quantiles(merge(["lang"]), ["lang"], "shared").withColumnRenamed("lang", "_lang")
    over_all = quantiles(merge([]), [], "overall").drop("n_overall")  # one row
    out = own.join(by_lang, F.col("lang").eqNullSafe(F.col("_lang"))).crossJoin(F.broadcast(over_all))
    return out.select("lang", "source", *map(blend, RATIOS)).select("lang", "source", F.struct(*map(fence, RATIOS)).alias("fences"))


def judge(counted: DataFrame, least_words: int = 10, repeat_percent: int = 20, least_rows: int = 100) -> DataFrame:
    """``counted`` with ``base_failed`` (too few words, or too many repeated ones), ``failed`` (the ratios beyond
    their fences) and ``kept`` (neither).

    The sketches are made of the texts that pass the base rules, so that junk doesn't widen its own fences. Null
    languages and sources are groups like any other. A group without a passing text has no fences and
    fails at the base rules. Rows that repeat count each.
    """
    n = F.col("n_words")
    counted = cut(counted.withColumn("base_failed", (n < least_words) | (F.col("n_repeat_words") * 100 > n * repeat_percent)))
    drawn = cut(thresholds(counted.filter(~F.col("base_failed")), least_rows))
    drawn = drawn.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), "fences")
    # A row for each language and source: Spark broadcasts it by its size, or shuffles.
    out = counted.join(drawn, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")

    def beyond(name: str) -> Column:
        value = F.when(n > 0, F.expr(f"try_divide({RATIOS[name][0].replace(' / ', ', ')})"))
        fence = F.col("fences")[name]
        return F.when((value > fence["hi"]) | F.coalesce(value < fence["lo"], F.lit(False)), F.lit(name))

    out = out.withColumn("failed", F.array_compact(F.array(*map(beyond, RATIOS))))
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0)).drop("_lang", "_source", "fences")

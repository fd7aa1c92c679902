"""Mixing sources to target weights by capped water-filling, with seeded whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nestfold.llm.order import running_sum
from nestfold.llm.words import fresh
from nestfold.session import cut

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, total: float, epochs: float) -> DataFrame:
    """``sources`` (size, weight) with ``target``: shares of ``total`` by weight, none above ``epochs`` times its size.

    Round by round the sources whose share exceeds their cap are clamped there, and what
    they can't take goes to the others by weight, until no share does. A round is one
    aggregate; only its two numbers come to the driver.
    """
    cap = F.col("size") * F.lit(float(epochs))
    level = None  # words for a unit of weight; it only rises
    while True:
        full = F.lit(False) if level is None else cap <= F.col("weight") * F.lit(level)
        left, weight = sources.agg(F.lit(float(total)) - F.coalesce(F.sum(F.when(full, cap)), F.lit(0.0)), F.sum(F.when(~full, F.col("weight")))).first()
        if not weight:
            return sources.withColumn("target", cap)
        new = max(0.0, left) / weight
        if level is not None and new <= level:
            return sources.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)))
        level = new


def _nth(seed: int, id_col: str, text_col: str, source_col: str) -> Column:
    """A document's place in the seeded order; only equal rows share one."""
    return F.xxhash64(F.lit(seed), id_col, source_col, text_col)


def plan_mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    epochs: int = 3,
    share: float = 1.0,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """By source: ``source_size``, ``weight``, ``target``, ``whole``, ``last``, ``last_rows`` and ``last_taken``, which say what ``take`` takes.

    Sources in the order of their code points, null last, get the weights in turn; all targets are ``share``
    of all words. A source's repetition is its target by its size: every document is taken ``whole`` times,
    and once more those that come first in an order by seeded hash, up to ``last``, where the
    rest of the target is met as nearly as a document allows. So a source's words miss their
    target by half a document at most, and no document is taken more than ``epochs`` times. Equal rows share
    their place and are counted together; of those at the last place ``last_taken`` of ``last_rows`` are taken.

    Null and empty texts have size 0. A null source is a source. An empty table has no sources.
    """
    rows = docs.select(F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), _nth(seed, id_col, text_col, source_col).alias("nth"))
    rows = cut(rows.groupBy("source", "size", "nth").agg(F.count("*").alias("copies"), F.sum("size").alias("words")))
    by_source = F.col("source").asc_nulls_last()
    sources = rows.groupBy("source").agg(F.sum("words").alias("size")).withColumn("one", F.lit(1))
    several = F.array(*(F.lit(float(w)) for w in weights))
    ranked = running_sum(sources, [by_source], "one", "rank")
    weight = F.element_at(several, (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    ranked = cut(running_sum(ranked.select("source", "size", weight.alias("weight")), [by_source], "size", "start"))
    total = ranked.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    filled = water_fill(ranked, total * share, epochs).withColumn("whole", F.coalesce(F.floor(F.try_divide("target", "size")), F.lit(0)))
    filled = cut(filled.withColumn("rest", F.col("target") - F.col("whole") * F.col("size")))

    # Once more, if half of the document or more lies below the rest of the target; of equal rows as many as do.
    placed = running_sum(rows, [by_source, F.col("nth")], "words", "before")
    offsets = filled.select(F.col("source").alias("_source"), "start", "rest")
    placed = placed.filter("size > 0").join(offsets, F.col("source").eqNullSafe(F.col("_source")))
    below = F.floor((F.col("rest") - (F.col("before") - F.col("start"))) / F.col("size") + F.lit(0.5))
    more = placed.withColumn("taken", F.least(F.col("copies"), below)).filter("taken > 0")
    last = more.groupBy(F.col("source").alias("_source")).agg(F.max(F.struct("nth", "copies", "taken")).alias("last"))
    out = filled.join(last, F.col("source").eqNullSafe(F.col("_source")), "left")
    return cut(
        out.select("source", F.col("size").alias("source_size"), "weight", "target", "whole", F.col("last.nth").alias("last"), F.col("last.copies").alias("last_rows"), F.col("last.taken").alias("last_taken"))
    )


def take(
    docs: DataFrame, plan: DataFrame, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", name: str = "mix"
) -> DataFrame:
    """``docs`` with a struct ``mix``: ``size`` in words, ``times`` it is taken, its source's ``source_size`` and ``target``.

    Each row is told by itself and the plan, and nothing but the plan, a row for each source, is joined. Only where a
    source's target ends among equal rows are these written and numbered. A column called ``name`` is
    replaced; others are carried along.
    """
    docs = docs.drop(*(c for c in docs.columns if c.lower() == name.lower()))
    there = {c: fresh([*docs.columns, name], f"plan_{c}") for c in plan.columns}
    of = lambda c: F.col(there[c])
    nth = _nth(seed, id_col, text_col, source_col)
    rows = docs.join(plan.withColumnsRenamed(there), F.col(source_col).eqNullSafe(of("source")), "left")

    def taken(some: DataFrame, more: Column) -> DataFrame:
        made = F.struct(
            word_count(F.col(text_col)).alias("size"), (of("whole") + F.coalesce(more, F.lit(False)).cast("long")).alias("times"), of("source_size").alias("source_size"), of("target").alias("target")
        )
        return some.select(*docs.columns, made.alias(name))

    if plan.filter("last_taken < last_rows").isEmpty():
        return taken(rows, nth <= of("last"))
    split = F.coalesce((nth == of("last")) & (of("last_taken") < of("last_rows")), F.lit(False))
    number, before, first, again = (fresh([*docs.columns, name, *there.values()], c) for c in ("number", "before", "first", "again"))
    equal = cut(rows.filter(split).withColumn(number, F.monotonically_increasing_id()))
    placed = cut(running_sum(equal.select(of("source"), number, F.lit(1).alias("one")), [of("source").asc_nulls_last(), F.col(number)], "one", before))
    firsts = placed.groupBy(of("source").alias(again)).agg(F.min(before).alias(first))
    placed = placed.join(firsts, of("source").eqNullSafe(F.col(again))).select(F.col(number).alias(again), (F.col(before) - F.col(first)).alias(before))
    equal = equal.join(placed, F.col(number) == F.col(again))
    return taken(rows.filter(~split), nth <= of("last")).unionByName(taken(equal, F.col(before) < of("last_taken")))

"""Putting sources together: page cut-off, quarantine, union, health."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nestfold.session import broadcast_if_small, cut


def page_early_stop(
    rows: DataFrame,
    source: str,
    page: str,
    is_fresh: Column,
    is_last: Column | None = None,
    max_page: int | None = None,
) -> DataFrame:
    """Fresh rows of the pages a newest-first reader would have visited.

    Reading stops at the first page without a fresh row, at a missing page, after a page
    marked last, or at ``max_page`` where the caller gives one. The page facts are one partial aggregate per (source, page),
    so a source holding most rows still combines before the shuffle. The joined side has one row
    per source and is broadcast once its count is known, so the rows are not moved at all.
    """
    last = F.lit(False) if is_last is None else is_last
    allowed = F.col(page) >= 1 if max_page is None else F.col(page).between(1, max_page)
    pages = cut(
        rows.filter(allowed)
        .groupBy(source, page)
        .agg(F.max(is_fresh).alias("any_fresh"), F.max(last).alias("any_last"))
    )
    # A page without a successor ends an unbroken run; the first such page ends the run from 1.
    ahead = pages.select(source, (F.col(page) - 1).cast(dict(pages.dtypes)[page]).alias(page))
    ends = pages.join(ahead, [source, page], "left_anti").groupBy(source).agg(F.min(page).alias("last_unbroken"))
    never = F.lit((1 << 31) - 1)
    stop = pages.groupBy(source).agg(
        F.min(page).alias("first_page"),
        F.coalesce(F.min(F.when(~F.col("any_fresh"), F.col(page))), never).alias("first_stale"),
        F.coalesce(F.min(F.when(F.col("any_last"), F.col(page))), never).alias("last_page"),
    )
    reach = F.when(F.col("first_page") == 1, F.least(F.col("first_stale") - 1, "last_page", "last_unbroken")).otherwise(0)
    stop = stop.join(ends, source).select(source, reach.alias("_reach"))
    visited = rows.join(broadcast_if_small(stop), source)
    return visited.filter(is_fresh & allowed & (F.col(page) <= F.col("_reach"))).drop("_reach")


def quarantine_split(df: DataFrame, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with every required field, and the others with the names of what is missing."""
    missing = F.array_compact(
        F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required])
    )
    tagged = df.withColumn("missing", missing)
    return tagged.filter(F.size("missing") == 0).drop("missing"), tagged.filter(F.size("missing") > 0)


def union_sources(frames: dict[str, DataFrame], seq: str) -> DataFrame:
    """All sources in one frame, ordered by source position and then by their own ``seq``.

    The combined order key is ``struct(source_no, seq)``: no global numbering, no sort.
    """
    tagged = [
        df.withColumn("source", F.lit(name)).withColumn("source_no", F.lit(i))
        for i, (name, df) in enumerate(frames.items())
    ]
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    return union.withColumn("arrival", F.struct("source_no", seq))


def source_health(rows: DataFrame, sources: list[str], errors: dict[str, str] | None = None) -> DataFrame:
    """Row count and error of every expected source, also of those that sent nothing."""
    return counted_health(rows.groupBy("source").agg(F.count("*").alias("n")), sources, errors)


def counted_health(counts: DataFrame, sources: list[str], errors: dict[str, str] | None = None) -> DataFrame:
    """``source_health`` from counts ``(source, n)`` that are known already."""
    errors = errors or {}
    expected = counts.sparkSession.createDataFrame(
        [(s, errors.get(s)) for s in sources], "source string, error string"
    )
    return expected.join(counts, "source", "left").select(
        "source", F.coalesce("n", F.lit(0)).alias("n"), "error"
    )

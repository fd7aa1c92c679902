"""Composite score, tiered ranking, top-k sections and the rejection list."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from nestfold.config import Destination, ScoreConfig


def closeness(minutes: Column, cap: float) -> Column:
    """1 at the door, 0 at the cap and beyond, 0 when unknown."""
    return F.coalesce(F.greatest(F.lit(0.0), F.lit(1.0) - minutes / F.lit(cap)), F.lit(0.0))


def score(
    destinations: list[Destination],
    freshness_days: int,
    as_of: datetime,
    cfg: ScoreConfig = ScoreConfig(),
) -> Column:
    """Weighted closeness to every destination plus surface, freshness and lift."""
    total = F.lit(0.0)
    for d in destinations:
        walk = F.try_element_at("commute", F.lit(d.name))
        total = total + F.lit(float(d.score_weight)) * closeness(walk, cfg.walk_cap_min)
    age_h = (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros("created_at")) / F.lit(3.6e9)
    fresh = F.greatest(F.lit(0.0), F.lit(1.0) - age_h / F.lit(freshness_days * 24.0))
    surface = F.least(F.lit(1.0), F.col("m2") / F.lit(cfg.surface_cap_m2))
    lift = F.when(F.col("elevator"), 1.0).otherwise(0.0)
    return (
        total
        + F.lit(cfg.surface_weight) * surface
        + F.lit(cfg.freshness_weight) * fresh
        + F.lit(cfg.elevator_weight) * lift
    )


def pet_friendly() -> Column:
    """Explicitly confirmed by the source or by the text; silence is not consent."""
    said = F.col("extraction")["pets_allowed"] == "yes"
    return F.coalesce(F.col("pets_allowed"), F.lit(False)) | F.coalesce(said, F.lit(False))


def rank_listings(
    df: DataFrame,
    destinations: list[Destination],
    freshness_days: int,
    as_of: datetime,
    cfg: ScoreConfig = ScoreConfig(),
) -> DataFrame:
    """Adds ``tier`` (1 = pet friendly) and ``score``. Sorting is left to the reader."""
    return df.withColumn("tier", F.when(pet_friendly(), 1).otherwise(0)).withColumn(
        "score", score(destinations, freshness_days, as_of, cfg)
    )


def rank_order(seq: str = "seq") -> list[Column]:
    """Tier first, then score; equal rows keep arrival order."""
    return [F.col("tier").desc(), F.col("score").desc(), F.col(seq).asc()]


def digest_topk(df: DataFrame, k: int, seq: str = "seq") -> tuple[DataFrame, DataFrame]:
    """The best ``k`` rows with their ``rank``; and one row with the ``overflow`` beyond them.

    The limit is the feature: each task keeps k rows and only those meet. The window that
    numbers them runs over at most k rows.
    """
    best = df.orderBy(*rank_order(seq)).limit(k)
    ranked = best.withColumn("rank", F.row_number().over(Window.orderBy(*rank_order(seq))))
    return ranked, overflow(df, k, "overflow")


def overflow(df: DataFrame, k: int, name: str) -> DataFrame:
    return df.agg(F.greatest(F.count("*") - k, F.lit(0)).alias(name))


def pick_canonical(
    df: DataFrame, cluster: str, rank: Column, created: str = "created_at", seq: str = "seq", cols: list[str] | None = None
) -> DataFrame:
    """The row that stands for each cluster: best source, newest, earliest arrival.

    A ``min_by`` with partial aggregation, so one cluster may hold any share of the rows.
    """
    cols = cols or [c for c in df.columns if c != cluster]
    order = F.struct(rank, -F.unix_micros(F.col(created)), F.col(seq))
    return (
        df.groupBy(cluster)
        .agg(F.min_by(F.struct(*cols), order).alias("_c"), F.count("*").alias("cluster_size"))
        .select(cluster, "cluster_size", *[F.col("_c")[c].alias(c) for c in cols])
    )


def rejection_tally(
    rejected: DataFrame, k: int = 30, order: str | list[str] = "seq"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Count per rule; the first ``k`` rejected rows in arrival order; and how many are not shown."""
    keys = [order] if isinstance(order, str) else order
    tally = rejected.groupBy("rule_id").agg(F.count("*").alias("n"))
    return tally, rejected.orderBy(*keys).limit(k), overflow(rejected, k, "remainder")

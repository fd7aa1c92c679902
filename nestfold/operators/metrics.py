"""Counters of a run. Each is one partial aggregate."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def state_stats(snapshot: DataFrame) -> DataFrame:
    return snapshot.agg(F.count("*").alias("listings_tracked"))


def monthly_call_count(cache: DataFrame, as_of: datetime, fetched: str = "fetched_at") -> DataFrame:
    """Cache entries written since the first of the month, distance skips included."""
    start = F.date_trunc("month", F.lit(as_of).cast("timestamp"))
    return cache.filter(F.col(fetched) >= start).agg(F.count("*").alias("calls"))


def funnel(df: DataFrame, stage: str = "stage") -> DataFrame:
    return df.groupBy(stage).agg(F.count("*").alias("n"))


def dedup_stats(clustered: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """Hashed rows, clusters, and clusters whose canonical row had no reason to be sent.

    ``clustered`` has ``code`` and, on canonical rows only, ``is_canonical`` true with
    ``notify_reason``.
    """
    quiet = F.col("is_canonical") & F.col("notify_reason").isNull()
    return clustered.agg(
        F.count("code").alias("phashed"),
        F.count_if(F.col("is_canonical")).alias("clusters"),
        F.count_if(quiet).alias("suppressed"),
    )


def click_counts(clicks: DataFrame, kind: str = "kind") -> DataFrame:
    return clicks.groupBy(kind).agg(F.count("*").alias("n"))


def channel_counts(posts: DataFrame) -> DataFrame:
    """Posts per channel and outcome."""
    return posts.groupBy("channel", "outcome").agg(F.count("*").alias("n"))

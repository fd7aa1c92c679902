"""What changed since a row was last sent."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nestfold.config import NotifyConfig
from nestfold.operators.state import upsert_snapshot


def notify_reason(
    df: DataFrame,
    notified: DataFrame,
    as_of: datetime,
    cfg: NotifyConfig = NotifyConfig(),
    key: str = "listing_key",
    stage: str = "stage",
) -> DataFrame:
    """Adds ``notify_reason``: new, price_drop, price_change, upgraded, relisted or null.

    ``notified`` has one row per key with ``notified_at, notified_price, notified_stage``;
    ``stage`` is a column with 'match' or 'near_miss'.
    """
    last = notified.select(key, "notified_at", "notified_price", "notified_stage")
    price, was = F.col("price_eur"), F.col("notified_price")
    old = F.lit(as_of) - F.make_dt_interval(F.lit(cfg.renotify_days))
    reason = (
        F.when(F.col("notified_at").isNull(), "new")
        .when(price < was * (1 - cfg.price_drop_pct), "price_drop")
        .when(price != was, "price_change")
        .when((F.col(stage) == "match") & (F.col("notified_stage") == "near_miss"), "upgraded")
        .when(F.col("notified_at") < old, "relisted")
    )
    return df.join(last, key, "left").select(*df.columns, reason.alias("notify_reason"))


def renotify_gate(df: DataFrame, mode: str = "digest", force: bool = False) -> DataFrame:
    """Rows worth sending: in digest mode only those with a reason, otherwise all."""
    return df if mode == "instant" or force else df.filter("notify_reason is not null")


def mark_notified(
    snapshot: DataFrame, sent: DataFrame, as_of: datetime, key: str = "listing_key", stage: str = "stage"
) -> DataFrame:
    """Stamp the sent rows in the snapshot; keys it does not know are ignored."""
    stamps = sent.select(
        key,
        F.lit(as_of).cast("timestamp").alias("notified_at"),
        F.col("price_eur").alias("notified_price"),
        F.col(stage).alias("notified_stage"),
    )
    cols = ["notified_at", "notified_price", "notified_stage"]
    return upsert_snapshot(snapshot, stamps, key, cols, "notified_at", insert=False)

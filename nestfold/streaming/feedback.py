"""Click and post streams.

Positions in the input live in the query's checkpoint, so a restarted query continues after
the last committed batch and never replays a click. Pass ``available_now=True`` to
drain what is there and stop.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from nestfold.operators.notify import mark_notified
from nestfold.operators.state import click_dispatch, fresh_only
from nestfold.streaming import outbox as outboxes


def _start(df: DataFrame, path: str, checkpoint: str, mode: str, available_now: bool) -> StreamingQuery:
    writer = (
        df.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode(mode)
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def dispatched(clicks: DataFrame, data: str = "data") -> DataFrame:
    """Clicks with ``kind`` and ``key``; works on batches and streams alike."""
    d = click_dispatch(F.col(data))
    return clicks.withColumn("_d", d).select("*", "_d.kind", "_d.key").drop("_d")


def click_stream(clicks: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Every click once, dispatched by its prefix, unknown ones included."""
    return _start(dispatched(clicks), path, checkpoint, "append", available_now)


def skip_stream(clicks: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Hidden keys, each written once.

    Hiding is forever, so the state keeps every hidden key: it grows with the distinct keys
    (not with the clicks) and is spread over the state store partitions.
    """
    hidden = dispatched(clicks).filter("kind = 'skip'").select("key").dropDuplicates(["key"])
    return _start(hidden, path, checkpoint, "append", available_now)


def post_stream(posts: DataFrame, path: str, checkpoint: str, available_now: bool = False, within: str | None = None) -> StreamingQuery:
    """Each (channel, message) once ever; or once ``within`` a delay of ``posted_at``, which
    bounds the state for sources that never re-send older posts."""
    keys = ["channel", "message_id"]
    if within is None:
        once = posts.dropDuplicates(keys)
    else:
        once = posts.withWatermark("posted_at", within).dropDuplicatesWithinWatermark(keys)
    return _start(once, path, checkpoint, "append", available_now)


def reduce_toggles(rows: pd.DataFrame) -> pd.DataFrame:
    """Ordered toggles with repeats removed: of a run of equal kinds only the row that
    matters stays (first ``fav``, last ``unfav``)."""
    rows = rows.sort_values(["ts", "seq"], kind="stable")
    fav = rows["kind"] == "fav"
    first_of_run = fav & ~fav.shift(1, fill_value=False)
    last_of_run = ~fav & fav.shift(-1, fill_value=True)
    return rows[first_of_run | last_of_run]


class FavoriteProcessor(StatefulProcessor):
    """Per key: since when it is a favourite (microseconds), or not at all.

    A key's clicks of one batch come in chunks and are folded chunk by chunk into
    alternating toggles, so memory follows the changes of mind and not the clicks. A batch is
    ordered by click time; batches follow each other as they arrive.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._since = handle.getValueState("since", StructType([StructField("ts", LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        kept: pd.DataFrame | None = None
        for chunk in rows:
            part = chunk[["kind", "ts", "seq"]]
            kept = reduce_toggles(part if kept is None else pd.concat([kept, part]))
        since = self._since.get()[0] if self._since.exists() else None
        for kind, ts in zip(kept["kind"], kept["ts"]):
            if kind == "unfav":
                since = None
            elif since is None:
                since = int(ts)
        if since is None:
            self._since.clear()
        else:
            self._since.update((since,))
        yield pd.DataFrame(
            {"key": [key[0]], "since": pd.array([since], dtype="Int64"), "active": [since is not None]}
        )

    def close(self) -> None:
        pass


def favorite_changes(clicks: DataFrame, ts: str = "ts", seq: str = "seq") -> DataFrame:
    """Streaming ``(key, since, active)`` after every batch that touched a key."""
    toggles = dispatched(clicks).filter("kind in ('fav', 'unfav')").select(
        "key", "kind", F.unix_micros(F.col(ts).cast("timestamp")).alias("ts"), F.col(seq).cast("bigint").alias("seq")
    )
    return toggles.groupBy("key").transformWithStateInPandas(
        statefulProcessor=FavoriteProcessor(),
        outputStructType="key string, since bigint, active boolean",
        outputMode="Update",
        timeMode="None",
    )


def favorite_stream(clicks: DataFrame, path: str, checkpoint: str, available_now: bool = False, ts: str = "ts", seq: str = "seq") -> StreamingQuery:
    """Favourite changes written batch by batch as ``batch_id=N`` directories; the newest row
    of a key is its state (``favorites_of``)."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    writer = (
        favorite_changes(clicks, ts, seq)
        .writeStream.foreachBatch(write)
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def favorites_of(changes: DataFrame) -> DataFrame:
    """Current favourites from the written changes."""
    last = changes.groupBy("key").agg(F.max_by(F.struct("since", "active"), "batch_id").alias("s"))
    return last.filter("s.active").select("key", F.timestamp_micros("s.since").alias("since"))


OUTBOX = "listing_key string, price_eur double, stage string"


def read_outbox(spark: SparkSession, path: str) -> DataFrame:
    """What was pushed so far, by batch; empty before the first push."""
    return outboxes.read_batches(spark, path, OUTBOX)


def instant_stream(
    rows: DataFrame, notified: DataFrame, outbox: str, checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    """Push rows never notified before into an outbox that shows whole batches only.

    ``rows`` has ``listing_key, price_eur, stage, seq`` and may repeat a key: the first of a batch
    is sent. ``notified`` is the snapshot as it was before the stream started. What the stream itself sent
    is one row for each key in its state, so no batch reads an earlier one. A batch that
    runs again starts from the same state and finds its manifest: each row leaves once.
    """
    outboxes.register(rows.sparkSession)
    sent = first_sent(fresh_only(rows.select("listing_key", "price_eur", "stage", "seq"), notified))
    writer = (
        sent.writeStream.foreachBatch(lambda batch, batch_id: outboxes.write_batch(batch, outbox, batch_id))
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def first_sent(rows: DataFrame) -> DataFrame:
    """Streaming rows with the least ``seq`` of each key, in the batch in which the key came first.

    All rows of a batch have its time, which the checkpoint keeps for a batch that runs again. The least row of a key
    over all batches and the time of its last batch are one aggregate: the two times agree in the key's first batch only
    (a clock that is set back must not hit an earlier batch's very millisecond). A missing ``seq`` counts as the last.
    """
    row = F.struct("at", F.col("seq").isNull().alias("unnumbered"), "seq", "price_eur", "stage")
    keys = rows.withColumn("at", F.current_timestamp()).groupBy("listing_key").agg(F.min(row).alias("first"), F.max("at").alias("last"))
    sent = keys.filter("first.at = last").select("listing_key", "first.price_eur", "first.stage")
    return sent.select(F.col("listing_key").cast("string"), F.col("price_eur").cast("double"), F.col("stage").cast("string"))


def fold_outbox(snapshot: DataFrame, sent: DataFrame, as_of: datetime) -> DataFrame:
    """Next snapshot with the pushed rows stamped; run once per digest, not per batch."""
    return mark_notified(snapshot, sent, as_of)

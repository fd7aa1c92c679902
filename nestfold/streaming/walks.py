"""The walking-time cache as state of a stream, with a time to live.

Answers fill the state, asks look it up. An entry is valid while it is younger than ``ttl_days`` at the time of
the ask, as in ``state.ttl_cache_lookup``; the state store itself drops entries a time to live after their last
answer, so it holds what can still be valid and no more.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

DAY_US = 86_400_000_000
ENTRY = StructType([StructField("walk_min", IntegerType()), StructField("fetched", LongType())])
LOOKED = "grid_key string, ask_id bigint, hit boolean, walk_min int"


class WalkCache(StatefulProcessor):
    """Per grid key the newest answer. Asks of a batch see the answers of the batches before it."""

    def __init__(self, ttl_days: int, state_ttl_ms: int):
        self.ttl_us, self.state_ttl_ms = ttl_days * DAY_US, state_ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._entry = handle.getValueState("entry", ENTRY, ttlDurationMs=self.state_ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        walk, fetched = self._entry.get() if self._entry.exists() else (None, None)
        newest: tuple[int, int | None] | None = None
        for chunk in rows:
            asks = chunk[chunk["ask_id"].notna()]
            if len(asks):
                hit = asks["at"].to_numpy() < fetched + self.ttl_us if fetched is not None else [False] * len(asks)
                minutes = pd.array([walk if h else None for h in hit], dtype="Int32")
                yield pd.DataFrame({"grid_key": key[0], "ask_id": asks["ask_id"].astype("int64").to_numpy(), "hit": hit, "walk_min": minutes})
            answers = chunk[chunk["ask_id"].isna()]
            if len(answers):
                last = answers.loc[answers["at"].idxmax()]
                said = (int(last["at"]), None if pd.isna(last["walk_min"]) else int(last["walk_min"]))
                newest = said if newest is None or said[0] > newest[0] else newest
        if newest is not None and (fetched is None or newest[0] >= fetched):
            self._entry.update((newest[1], newest[0]))

    def close(self) -> None:
        pass


def looked_up(rows: DataFrame, ttl_days: int = 90, state_ttl_ms: int | None = None) -> DataFrame:
    """Streaming ``(grid_key, ask_id, hit, walk_min)`` of each ask.

    ``rows`` has ``grid_key, at`` and either an ``ask_id`` (an ask) or none (an answer, ``walk_min`` minutes, null if there is no
    way). A live answer of null is a hit too. The answers of a batch hold from the next one on.
    """
    narrow = rows.select("grid_key", F.unix_micros(F.col("at").cast("timestamp")).alias("at"), F.col("ask_id").cast("bigint").alias("ask_id"), F.col("walk_min").cast("int").alias("walk_min"))
    return narrow.groupBy("grid_key").transformWithStateInPandas(
        statefulProcessor=WalkCache(ttl_days, state_ttl_ms or ttl_days * DAY_US // 1000),
        outputStructType=LOOKED,
        outputMode="Append",
        timeMode="ProcessingTime",
    )


def walk_stream(rows: DataFrame, path: str, checkpoint: str, available_now: bool = False, ttl_days: int = 90, state_ttl_ms: int | None = None) -> StreamingQuery:
    """Every ask once, with what the cache knew of it."""
    writer = looked_up(rows, ttl_days, state_ttl_ms).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    if not available_now:
        return writer.start()
    # State that lives by the clock asks for batch after batch, so a query that is to end takes none without data. A
    # query keeps the settings it was started with.
    conf, name = rows.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(name)
    conf.set(name, "false")
    try:
        return writer.trigger(availableNow=True).start()
    finally:
        conf.set(name, before)

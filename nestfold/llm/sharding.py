"""Shards of nearly equal bytes by Karmarkar-Karp differencing, with equal texts kept together.

A partial partition is one tuple of shard sums. The two with the largest spread are combined, the
largest sums of one with the smallest of the other, until one is left. Groups of equal texts are
the items. Groups below a fixed share of all bytes are first bundled by hash, so that one task
never combines more than twice ``resolution`` partial partitions, however large the table.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nestfold.llm.order import running_sum
from nestfold.session import cut


def difference(sizes: list[int], shards: int) -> list[int]:
    """The shard of each item.

    A partial partition holds its non-empty subsets as (sum, subset), largest first. Subsets point to the one
    they went into, so a combination costs as much as its subsets, not their items. Equal
    spreads are combined in the order they came.
    """
    n = len(sizes)
    into = list(range(n))
    heap = [(-s, k, [(s, k)]) for k, s in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, nth, b = heapq.heappop(heap)
        merged = list(a)
        met = max(0, len(a) + len(b) - shards)  # the smallest of a take the smallest of b, oppositely ordered
        merged += b[: len(b) - met]
        for k in range(met):
            at = len(a) - 1 - k
            s, mine = a[at]
            t, other = b[len(b) - met + k]
            into.append(len(into))
            into[mine] = into[other] = len(into) - 1
            merged[at] = (s + t, len(into) - 1)
        merged.sort(key=lambda p: -p[0])
        least = merged[-1][0] if len(merged) == shards else 0
        heapq.heappush(heap, (least - merged[0][0], nth, merged))
    shard = [-1] * len(into)
    for rank, (_, subset) in enumerate(heap[0][2] if heap else []):
        shard[subset] = rank
    for k in range(len(into) - 1, -1, -1):
        if into[k] != k:
            shard[k] = shard[into[k]]
    return shard[:n]


def _assign(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        items = pa.Table.from_batches(held)
        found = difference(items.column("size").to_pylist(), shards)
        yield from pa.table({"item": items.column("item"), "shard": pa.array(np.array(found, np.int32))}).to_batches()

    return run


def shard_by_bytes(
    docs: DataFrame, shards: int = 16, resolution: int = 1 << 14, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(id, size, text_crc32, shard, slot)``; the size is the text's UTF-8 bytes plus 1.

    Equal texts share a shard, so a group larger than a shard's part fills one alone. Slots number
    a shard's documents from 0 by their id. Bytes differ by less than ``shards`` / ``resolution`` of a
    shard where no group is larger than that.

    A null text has no bytes and counts as an empty one. Null ids come first among the slots; rows that
    repeat are documents of their own. Other columns are not read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    raw = text.cast("binary")
    rows = cut(
        docs.select(
            F.col(id_col).cast("long").alias("id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(raw).alias("text_crc32"),
            F.unhex(F.md5(raw)).alias("key"),
        )
    )
    groups = rows.groupBy("key").agg(F.sum("size").alias("size"))
    total = F.lit(rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0])
    single = F.col("size") * resolution >= total
    item = F.when(single, F.base64("key")).otherwise(F.pmod(F.xxhash64("key"), F.lit(resolution)).cast("string"))
    groups = cut(groups.select("key", "size", item.alias("item")))
    items = groups.groupBy("item").agg(F.sum("size").alias("size"))
    items = items.repartition(1).sortWithinPartitions(F.desc("size"), "item")  # twice ``resolution`` short rows at most
    placed = cut(items.mapInArrow(_assign(shards), "item string, shard int"))
    by_key = groups.join(F.broadcast(placed), "item").select("key", "shard")
    out = rows.join(by_key, "key").drop("key")
    out = running_sum(out.withColumn("one", F.lit(1).cast("long")), [F.col("shard"), F.col("id"), F.col("size"), F.col("text_crc32")], "one", "nth")
    before = out.groupBy("shard").agg(F.min("nth").alias("first"))  # one row for each shard
    return out.join(F.broadcast(before), "shard").select(F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("nth") - F.col("first")).alias("slot"))

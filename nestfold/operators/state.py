"""State tables: keyed merges, cache lookups, seen sets and folds.

Every fold is a partial aggregate (``max_by``/``min``), never a window over a key: a key
holding a third of all rows is combined before it is shuffled.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nestfold import schema
from nestfold.functions import text
from nestfold.session import cut


def last_per_key(df: DataFrame, key: str | list[str], order: str | list[str], cols: list[str]) -> DataFrame:
    """The last row of each key by ``order`` (made total by the values themselves)."""
    keys = [key] if isinstance(key, str) else key
    orders = [order] if isinstance(order, str) else order
    row = F.struct(*orders, *[c for c in cols if c not in orders])
    picked = df.groupBy(*keys).agg(F.max(row).alias("_r"))
    return picked.select(*keys, *[F.col("_r")[c].alias(c) for c in cols])


def upsert_snapshot(
    snapshot: DataFrame,
    batch: DataFrame,
    key: str,
    overwrite: list[str],
    seq: str,
    as_of: datetime | None = None,
    insert: bool = True,
) -> DataFrame:
    """Next snapshot after merging a batch on ``key``.

    ``overwrite`` columns come from the batch's last row per key; all other snapshot
    columns are kept. With ``as_of``, ``first_seen_at`` is kept or started and
    ``last_seen_at`` moved for merged rows. ``insert=False`` only updates known keys.
    """
    newest = last_per_key(batch, key, seq, overwrite).select(
        key, F.struct(*overwrite).alias("_new")
    )
    joined = snapshot.join(newest, key, "full" if insert else "left")
    hit = F.col("_new").isNotNull()
    cols = [F.col(key)]
    for name in snapshot.columns:
        if name == key:
            continue
        if name in overwrite:
            value = F.when(hit, F.col("_new")[name].cast(snapshot.schema[name].dataType)).otherwise(
                F.col(name)
            )
        elif as_of is not None and name == "first_seen_at":
            value = F.coalesce(F.col(name), F.when(hit, F.lit(as_of)))
        elif as_of is not None and name == "last_seen_at":
            value = F.when(hit, F.lit(as_of)).otherwise(F.col(name))
        else:
            value = F.col(name)
        cols.append(value.alias(name))
    return joined.select(*cols)


class VersionedTable:
    """A snapshot as numbered directories: a new version never overwrites one being read.

    The newest directory with a success mark is the table; a writer that dies leaves no mark,
    so its directory is ignored and its number is not used again.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    def _versions(self, complete: bool) -> list[int]:
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        found = []
        for status in fs.listStatus(root):
            name = status.getPath().getName()
            if not name.startswith("version="):
                continue
            done = jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
            if not complete or fs.exists(done):
                found.append(int(name.split("=")[1]))
        return sorted(found)

    def read(self) -> DataFrame | None:
        done = self._versions(complete=True)
        return self.spark.read.parquet(f"{self.path}/version={done[-1]}") if done else None

    def write(self, df: DataFrame) -> DataFrame:
        used = self._versions(complete=False)
        target = f"{self.path}/version={used[-1] + 1 if used else 1}"
        df.write.parquet(target)
        return self.spark.read.parquet(target)


def write_digest(df: DataFrame, path: str, run_date: str) -> None:
    """One partition per run date; writing a date again replaces only that date."""
    (
        df.withColumn("run_date", F.lit(run_date))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_date")
        .parquet(path)
    )


# --- caches -----------------------------------------------------------------------------


def payload_of(facts: Column) -> Column:
    return F.to_json(facts)


def facts_of(payload: Column) -> Column:
    """Stored payload to the facts struct; unknown fields are ignored, corrupt gives null."""
    parsed = F.from_json(payload, schema.EXTRACTION, {"mode": "PERMISSIVE"})
    sound = F.trim(payload).startswith("{") & F.try_parse_json(payload).isNotNull()
    return F.when(sound, parsed)


def cache_lookup(
    df: DataFrame, cache: DataFrame, key: str = "listing_key", text_col: str = "description"
) -> DataFrame:
    """Adds ``desc_hash`` and, where the stored facts are still valid, ``extraction``.

    Valid means same key, same content hash (a stored null never matches) and a payload
    that parses.
    """
    stored = cache.select(
        F.col(key).alias("_key"),
        F.col("desc_hash").alias("_hash"),
        facts_of(F.col("payload")).alias("extraction"),
    ).filter("extraction is not null and _hash is not null")
    left = df.drop("extraction").withColumn("desc_hash", text.content_hash(F.col(text_col)))
    valid = (F.col(key) == F.col("_key")) & (F.col("desc_hash") == F.col("_hash"))
    return left.join(stored, valid, "left").drop("_key", "_hash")


def split_hits(looked: DataFrame) -> tuple[DataFrame, DataFrame]:
    return (
        looked.filter("extraction is not null"),
        looked.filter("extraction is null").drop("extraction"),
    )


def cache_split(
    df: DataFrame, cache: DataFrame, key: str = "listing_key", text_col: str = "description"
) -> tuple[DataFrame, DataFrame]:
    """Rows whose stored facts are still valid, with ``extraction``; and the others."""
    return split_hits(cache_lookup(df, cache, key, text_col))


def ttl_cache_lookup(
    df: DataFrame, cache: DataFrame, key: str, value: str, fetched: str, ttl_days: int, as_of: datetime
) -> DataFrame:
    """Adds ``hit`` and the cached value. A live entry holding null is a hit too."""
    alive = F.lit(as_of) - F.make_dt_interval(F.lit(ttl_days))
    live = cache.filter(F.col(fetched) > alive).select(
        key, F.col(value), F.lit(True).alias("hit")
    )
    return df.join(live, key, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


# --- set-like state ----------------------------------------------------------------------


def skip_antijoin(df: DataFrame, skipped: DataFrame, key: str = "listing_key") -> DataFrame:
    """Rows the user has not hidden."""
    return df.join(skipped.select(key), key, "left_anti")


def skipped_profiles(skipped: DataFrame, snapshot: DataFrame, key: str = "listing_key") -> DataFrame:
    """What is known of the hidden rows; keys never stored as listings vanish."""
    return snapshot.join(skipped.select(key).distinct(), key, "left_semi")


def fresh_only(df: DataFrame, notified: DataFrame, key: str = "listing_key") -> DataFrame:
    """Rows never notified before the run: ``notified`` is the snapshot taken at its start."""
    return df.join(notified.filter("notified_at is not null").select(key), key, "left_anti")


def unseen_posts(posts: DataFrame, seen: DataFrame) -> DataFrame:
    """Posts of a channel not processed in any earlier run."""
    keys = ["channel", "message_id"]
    return posts.join(seen.select(*keys), keys, "left_anti")


def first_seen_set(events: DataFrame, key: str, ts: str) -> DataFrame:
    """Set union where the first insert of a key wins."""
    return events.groupBy(key).agg(F.min(ts).alias("first_ts"))


def toggle_fold(
    events: DataFrame,
    key: str,
    kind: str,
    ts: str,
    seq: str,
    on: str = "fav",
    off: str = "unfav",
    slice_seconds: int = 3600,
) -> DataFrame:
    """Keys switched on at the end, and since when.

    "Since" is the first ``on`` after the last ``off``; later ``on`` events do not move it.
    Time slices bound every group: each (key, slice) keeps its last ``off`` and first
    ``on`` as partial aggregates. Only the slice holding a key's last ``off`` is looked at
    again, and that slice cannot grow with the history of the key.
    """
    when = F.struct(F.col(ts).alias("ts"), F.col(seq).alias("seq"))
    slot = F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / F.lit(float(slice_seconds))).cast("bigint")
    marked = events.filter(F.col(kind).isin(on, off)).select(
        F.col(key).alias("key"), F.col(kind).alias("kind"), when.alias("at"), slot.alias("slot")
    )
    # One row per key and slice, read twice below.
    slices = cut(
        marked.groupBy("key", "slot").agg(
            F.max(F.when(F.col("kind") == off, F.col("at"))).alias("last_off"),
            F.min(F.when(F.col("kind") == on, F.col("at"))).alias("first_on"),
        )
    )
    last = slices.groupBy("key").agg(
        F.max("last_off").alias("off_at"), F.max(F.when(F.col("last_off").isNotNull(), F.col("slot"))).alias("off_slot")
    )
    later = (
        slices.join(last, "key")
        .filter(F.col("first_on").isNotNull() & (F.col("off_slot").isNull() | (F.col("slot") > F.col("off_slot"))))
        .select("key", F.col("first_on").alias("on_at"))
    )
    within = (
        marked.filter(F.col("kind") == on)
        .join(
            last.filter("off_slot is not null").withColumnRenamed("off_slot", "slot"), ["key", "slot"]
        )
        .filter(F.col("at") > F.col("off_at"))
        .select("key", F.col("at").alias("on_at"))
    )
    return (
        later.unionByName(within)
        .groupBy("key")
        .agg(F.min("on_at").alias("on_at"))
        .select(F.col("key").alias(key), F.col("on_at.ts").alias("since"))
    )


def click_dispatch(data: Column) -> Column:
    """Button payload ``prefix:key`` to ``struct<kind, key>``; other payloads are unknown."""
    cases = [("skip:", "skip"), ("unfav:", "unfav"), ("fav:", "fav")]
    kind, key = F.lit("unknown"), F.lit(None).cast("string")
    for prefix, name in cases:
        mine = F.coalesce(data.startswith(prefix), F.lit(False))
        kind = F.when(mine, name).otherwise(kind)
        key = F.when(mine, F.substr(data, F.lit(len(prefix) + 1))).otherwise(key)
    return F.struct(kind.alias("kind"), key.alias("key"))

"""Listings against named destinations: distances, cached walking times, the commute map."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nestfold.config import Destination, WalkConfig
from nestfold.functions import geo
from nestfold.operators.state import ttl_cache_lookup, upsert_snapshot
from nestfold.session import cut

# Destinations written into a plan together.
LITERAL_DESTINATIONS = 1_000


def load_destinations(rows: DataFrame) -> list[Destination]:
    """Destinations kept as a table ``(name, lat, lng, gates, score_weight)``, in name order.

    They are run parameters, so the table is read like a configuration file, row by row.
    """
    return [Destination(**r.asDict()) for r in rows.orderBy("name").toLocalIterator()]


def literal_destinations(destinations: list[Destination], first: int = 0) -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(i).alias("dest_ord"),
                F.lit(d.name).alias("dest"),
                F.lit(float(d.lat)).alias("dest_lat"),
                F.lit(float(d.lng)).alias("dest_lng"),
            )
            for i, d in enumerate(destinations, first)
        ]
    )


def per_destination(df: DataFrame, destinations: list[Destination]) -> DataFrame:
    """One row per listing and destination: a projection for each block of destinations, not a join."""
    if not destinations:
        none = literal_destinations([Destination("", 0.0, 0.0, False, 0.0)])
        return df.filter(F.lit(False)).withColumn("_d", F.explode(none)).select(*df.columns, "_d.*")
    blocks = range(0, len(destinations), LITERAL_DESTINATIONS)
    literals = [literal_destinations(destinations[a : a + LITERAL_DESTINATIONS], a) for a in blocks]
    wide = [df.withColumn("_d", F.explode(block)).select(*df.columns, "_d.*") for block in literals]
    return reduce(DataFrame.unionByName, wide)


def distance_matrix(df: DataFrame, destinations: list[Destination], key: str = "listing_key") -> DataFrame:
    """Long ``(key, dest, km)``; km is null for rows without coordinates."""
    km = geo.haversine(F.col("lat"), F.col("lng"), F.col("dest_lat"), F.col("dest_lng"))
    return per_destination(df.select(key, "lat", "lng"), destinations).select(key, "dest", km.alias("km"))


def resolve_walk(
    df: DataFrame,
    destinations: list[Destination],
    cache: DataFrame,
    provider: "DataFrame | Callable[[DataFrame], DataFrame]",
    as_of: datetime,
    cfg: WalkConfig = WalkConfig(),
    key: str = "listing_key",
    seq: str = "seq",
) -> tuple[DataFrame, DataFrame]:
    """Walking minutes per (listing, destination), and the next cache.

    Requests are reduced to one per grid cell and destination before anything is looked up;
    the earliest listing stands for its cell. Order: live cache entry, then the distance
    check (too far is stored as a null entry), then the provider: a frame
    ``(grid_key, walk_min)`` or a function from request rows to such a frame. A request the
    provider does not answer stays unresolved and is not cached, so the next run retries it.
    """
    wide = per_destination(
        df.select(key, seq, "lat", "lng", "address", "place_names"), destinations
    )
    asked = wide.select(
        key,
        seq,
        "dest",
        "dest_lat",
        "dest_lng",
        "lat",
        "lng",
        "address",
        geo.grid_key(
            F.col("lat"), F.col("lng"), F.col("address"), F.col("place_names"), F.col(key), F.col("dest"), cfg.grid_decimals
        ).alias("grid_key"),
    )
    first = asked.groupBy("grid_key").agg(
        F.min_by(F.struct("dest", "dest_lat", "dest_lng", "lat", "lng", "address"), F.col(seq)).alias("r")
    )
    requests = first.select("grid_key", "r.*")
    looked = ttl_cache_lookup(requests, cache, "grid_key", "walk_min", "fetched_at", cfg.ttl_days, as_of)
    km = geo.haversine(F.col("lat"), F.col("lng"), F.col("dest_lat"), F.col("dest_lng"))
    looked = looked.withColumn("too_far", ~F.col("hit") & F.coalesce(km > cfg.km_max, F.lit(False)))
    looked = cut(looked)
    open_requests = looked.filter("not hit and not too_far").drop("walk_min", "hit", "too_far")
    answers = provider(open_requests) if callable(provider) else provider
    answers = cut(
        open_requests.select("grid_key").join(answers.select("grid_key", "walk_min"), "grid_key")
    )
    known = (
        looked.filter("hit").select("grid_key", F.col("walk_min").cast("int").alias("walk_min"), F.lit("cache").alias("walk_source"))
        .unionByName(
            looked.filter("too_far").select(
                "grid_key", F.lit(None).cast("int").alias("walk_min"), F.lit("too_far").alias("walk_source")
            )
        )
        .unionByName(
            answers.select("grid_key", F.col("walk_min").cast("int"), F.lit("provider").alias("walk_source"))
        )
    )
    walks = asked.select(key, "dest", "grid_key").join(known, "grid_key", "left")
    stored = known.filter("walk_source <> 'cache'").select(
        "grid_key", "walk_min", F.lit(as_of).cast("timestamp").alias("fetched_at")
    )
    new_cache = upsert_snapshot(cache, stored, "grid_key", ["walk_min", "fetched_at"], "fetched_at")
    return walks, new_cache


def commute_map(walks: DataFrame, key: str = "listing_key") -> DataFrame:
    """``(key, commute map<dest, minutes>)``. A group holds one row per destination."""
    entry = F.struct(F.col("dest"), F.col("walk_min"))
    pairs = F.sort_array(F.collect_list(F.when(F.col("walk_source").isNotNull(), entry)))
    return walks.groupBy(key).agg(F.map_from_entries(pairs).alias("commute"))

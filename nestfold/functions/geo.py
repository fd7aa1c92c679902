"""Distances and grid keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from nestfold.functions.space import full_strip

EARTH_KM = 6371.0


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance in km."""
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lng = F.sin(F.radians(lng2 - lng1) / 2)
    chord = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lng * half_lng
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.when(chord > 1.0, 1.0).otherwise(chord)))


def coord_cell(lat: Column, lng: Column, decimals: int) -> Column:
    """``"lat,lng"`` rounded to a grid; null when either coordinate is."""
    return F.concat(
        F.round(lat, decimals).cast("string"), F.lit(","), F.round(lng, decimals).cast("string")
    )


def place_key(
    lat: Column,
    lng: Column,
    address: Column,
    place_names: Column,
    listing_key: Column,
    decimals: int = 3,
) -> Column:
    """Grid cell when there are coordinates, else a hash of the address, else the listing."""
    named = F.filter(
        F.concat(F.array(address), F.coalesce(place_names, F.array().cast("array<string>"))),
        lambda p: p.isNotNull() & (p != ""),
    )
    text = full_strip(F.lower(F.array_join(named, " ")))
    hashed = F.concat(F.lit("addr:"), F.substring(F.sha1(text), 1, 16))
    return F.coalesce(
        coord_cell(lat, lng, decimals),
        F.when(text != "", hashed),
        F.concat(F.lit("id:"), listing_key),
    )


def grid_key(
    lat: Column,
    lng: Column,
    address: Column,
    place_names: Column,
    listing_key: Column,
    dest: Column,
    decimals: int = 3,
) -> Column:
    """Cache key of one (place, destination) pair."""
    return F.concat(
        place_key(lat, lng, address, place_names, listing_key, decimals), F.lit("@"), dest
    )


def price_bucket(price: Column, width: int = 50) -> Column:
    return F.floor(price / F.lit(float(width))).cast("bigint")

"""Values shown on a card: links, short addresses, relative times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from nestfold.functions.space import full_strip

# Link shapes (fixed values).
LISTING_BASE_A = "https://www.4zida.rs"
RENT_BASE_B = "https://cityexpert.rs/izdavanje-nekretnina/beograd"
SALE_BASE_B = "https://cityexpert.rs/prodaja-nekretnina/beograd"
IMAGE_BASE_B = "https://img.cityexpert.rs/properties/720x"
MAPS_BASE = "https://www.google.com/maps?q="
ROUTE_BASE = "https://www.google.com/maps/dir/?api=1"


def image_url_b(prop_id: Column, photo: Column) -> Column:
    """Image address of source B; pictures are filed by thousands of property ids."""
    pid = prop_id.try_cast("bigint")
    folder = pid - F.pmod(pid, F.lit(1000))
    path = F.concat_ws("/", F.lit(IMAGE_BASE_B), folder, pid, F.lit("slike"), photo)
    return F.when(pid.isNotNull() & (photo != ""), path)


def listing_url_b(prop_id: Column, rent_or_sale: Column) -> Column:
    base = F.when(rent_or_sale == "s", SALE_BASE_B).otherwise(RENT_BASE_B)
    return F.concat_ws("/", base, prop_id.try_cast("bigint"), F.lit("stan"))


def short_address(address: Column, place_names: Column, city: str = "Belgrade") -> Column:
    """Street, smallest place if it is another name, and the city."""
    street = full_strip(F.substring_index(address, ",", 1))
    place = full_strip(F.try_element_at(place_names, F.lit(-1)))
    place = F.when(~place.eqNullSafe(street), F.nullif(place, F.lit("")))
    return F.concat_ws(", ", F.nullif(street, F.lit("")), place, F.lit(city))


def percent_encode(c: Column) -> Column:
    """Percent-encoding that keeps '/' and '~' and writes a space as %20."""
    encoded = F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    encoded = F.replace(encoded, F.lit("%2F"), F.lit("/"))
    encoded = F.replace(encoded, F.lit("*"), F.lit("%2A"))
    return F.replace(encoded, F.lit("%7E"), F.lit("~"))


def _point(lat: Column, lng: Column) -> Column:
    return F.concat(lat.cast("string"), F.lit(","), lng.cast("string"))


def maps_url(lat: Column, lng: Column, address: Column, place_names: Column) -> Column:
    target = F.coalesce(_point(lat, lng), percent_encode(short_address(address, place_names)))
    return F.concat(F.lit(MAPS_BASE), target)


def route_url(
    lat: Column,
    lng: Column,
    address: Column,
    place_names: Column,
    dest_lat: Column,
    dest_lng: Column,
    mode: str = "walking",
) -> Column:
    origin = F.coalesce(_point(lat, lng), percent_encode(short_address(address, place_names)))
    return F.concat(
        F.lit(ROUTE_BASE),
        F.lit("&origin="),
        origin,
        F.lit("&destination="),
        _point(dest_lat, dest_lng),
        F.lit(f"&travelmode={mode}"),
    )


def relative_time(then: Column, as_of: Column) -> Column:
    """just now / N h ago / yesterday / N days ago."""
    seconds = F.unix_micros(as_of) / F.lit(1e6) - F.unix_micros(then) / F.lit(1e6)
    hours = (seconds / 3600).cast("bigint")
    days = F.floor(hours / F.lit(24.0)).cast("bigint")
    return (
        F.when(hours < 1, "just now")
        .when(hours < 24, F.concat(hours.cast("string"), F.lit(" h ago")))
        .when(days == 1, "yesterday")
        .otherwise(F.concat(days.cast("string"), F.lit(" days ago")))
    )


def bills_flag(bills: Column, floor_eur: int = 200) -> Column:
    """Monthly bills worth showing: only above the floor."""
    return F.when(bills > floor_eur, bills)

"""JSON search responses to listings.

Both normalisers read one response per row, explode its adverts and drop an advert that
lacks a required field, leaving the others alone. ``rejected_*`` gives the dropped ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nestfold import schema
from nestfold.functions import parse, present, text, vocab


def _first_non_empty(*cols: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def _number(c: Column) -> tuple[Column, Column]:
    """Value (missing or blank counts as 0) and whether the text was a number at all."""
    raw = F.nullif(c, F.lit(""))
    value = F.coalesce(raw.try_cast("double"), F.lit(0.0))
    return value, raw.isNull() | raw.try_cast("double").isNotNull()


def _conform(df: DataFrame, extra: list[str]) -> DataFrame:
    cols = [F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.LISTING.fields]
    return df.select(*extra, *cols)


def parse_json_a(raw: DataFrame, json_col: str, keep: list[str] | None = None) -> DataFrame:
    """Every advert of every source-A response, with ``ok`` false on malformed ones."""
    keep = keep or []
    body = F.from_json(F.col(json_col), schema.SEARCH_A)
    ads = raw.select(*keep, F.explode(body["ads"]).alias("ad"))
    ad = F.col("ad")
    price, price_ok = _number(ad["price"])
    m2, m2_ok = _number(ad["m2"])
    rooms, rooms_ok = _number(ad["roomCount"])
    lifts, lifts_ok = _number(ad["elevator"])
    created = parse.parse_iso_time(ad["createdAt"])
    image = ad["image"]["search"]
    return ads.select(
        *keep,
        ad["id"].alias("id"),
        F.lit("4zida").alias("source"),
        F.concat(F.lit(present.LISTING_BASE_A), F.coalesce(ad["urlPath"], F.lit(""))).alias("url"),
        price.alias("price_eur"),
        m2.alias("m2"),
        rooms.alias("rooms"),
        parse.to_int(ad["redactedFloor"]).alias("floor"),
        parse.to_int(ad["redactedTotalFloors"]).alias("total_floors"),
        F.coalesce(ad["lastFloor"], F.lit(False)).alias("last_floor"),
        (lifts > 0).alias("elevator"),
        ad["furnished"].alias("furnished"),
        ad["heatingType"].alias("heating_type"),
        ad["petsAllowed"].alias("pets_allowed"),
        F.coalesce(_first_non_empty(ad["detailedTitle"], ad["title"]), F.lit("")).alias("title"),
        F.coalesce(ad["description100"], F.lit("")).alias("description"),
        _first_non_empty(ad["safeAddress"], ad["address"]).alias("address"),
        F.coalesce(ad["placeNames"], F.array().cast("array<string>")).alias("place_names"),
        _first_non_empty(image["380x0_fill_0_jpeg"], image["380x0_fill_0_webp"]).alias("image_url"),
        (F.coalesce(ad["agencyUrlPath"], F.lit("")) != "").alias("is_agency"),
        created.alias("created_at"),
        F.lit(None).cast("boolean").alias("dishwasher"),
        F.lit(None).cast("double").alias("lat"),
        F.lit(None).cast("double").alias("lng"),
        (ad["id"].isNotNull() & created.isNotNull() & price_ok & m2_ok & rooms_ok & lifts_ok).alias("ok"),
    )


def normalize_json_a(raw: DataFrame, json_col: str = "payload", keep: list[str] | None = None) -> DataFrame:
    """Source-A responses to listings. A missing lift count means there is no lift."""
    return _conform(parse_json_a(raw, json_col, keep).filter("ok"), keep or [])


def _location(c: Column) -> tuple[Column, Column]:
    head = F.substring_index(c, ",", 1)
    tail = F.substr(c, F.length(head) + 2)
    lat, lng = F.trim(head).try_cast("double"), F.trim(tail).try_cast("double")
    both = lat.isNotNull() & lng.isNotNull()
    return F.when(both, lat), F.when(both, lng)


def parse_json_b(raw: DataFrame, json_col: str, keep: list[str] | None = None) -> DataFrame:
    """Every property of every source-B response, with ``ok`` false on malformed ones."""
    keep = keep or []
    body = F.from_json(F.col(json_col), schema.SEARCH_B)
    rows = raw.select(*keep, F.explode(body["result"]).alias("p"))
    p = F.col("p")
    price, price_ok = _number(p["price"])
    size, size_ok = _number(p["size"])
    published = _first_non_empty(p["firstPublished"], p["availableFrom"])
    created = parse.parse_iso_time(published)
    lat, lng = _location(p["location"])
    spot = parse.parse_floor(p["floor"], "coded")
    top = (
        p["isNotLastFloor"].eqNullSafe(F.lit(False))
        & (spot["floor"] != 0)
        & (spot["floor"] == spot["total"])
    )
    structure = F.coalesce(p["structure"], F.lit(""))
    street = F.coalesce(p["street"], F.lit(""))
    heading = F.concat(structure, F.lit(" apartment, "), street)
    places = F.coalesce(p["polygons"], F.array().cast("array<string>"))
    prop_id = p["propId"].try_cast("bigint")
    return rows.select(
        *keep,
        p["uniqueID"].alias("id"),
        F.lit("cityexpert").alias("source"),
        present.listing_url_b(p["propId"], p["rentOrSale"]).alias("url"),
        price.alias("price_eur"),
        size.alias("m2"),
        F.coalesce(F.translate(p["structure"], ",", ".").try_cast("double"), F.lit(0.0)).alias("rooms"),
        spot["floor"].alias("floor"),
        spot["total"].alias("total_floors"),
        F.coalesce(top, F.lit(False)).alias("last_floor"),
        (~F.coalesce(p["isNoElevatorButLow"], F.lit(False))).alias("elevator"),
        vocab.code_label(p["furnished"], vocab.FURNISHED_CODES).alias("furnished"),
        vocab.priority_pick(p["heatingArray"], vocab.HEATING_CODES, vocab.HEATING_PRIORITY).alias(
            "heating_type"
        ),
        vocab.code_present(p["petsArray"], vocab.PET_CODE).alias("pets_allowed"),
        F.regexp_replace(heading, "^[, ]+|[, ]+$", "").alias("title"),
        F.concat(
            F.coalesce(p["municipality"], F.lit("")), F.lit(" · "), F.array_join(places, ", ")
        ).alias("description"),
        p["street"].alias("address"),
        places.alias("place_names"),
        present.image_url_b(p["propId"], p["coverPhoto"]).alias("image_url"),
        F.lit(True).alias("is_agency"),
        created.alias("created_at"),
        F.array_contains(
            F.coalesce(p["furnishingArray"], F.array().cast("array<string>")), "furDishWasher"
        ).alias("dishwasher"),
        lat.alias("lat"),
        lng.alias("lng"),
        (p["uniqueID"].isNotNull() & prop_id.isNotNull() & created.isNotNull() & price_ok & size_ok).alias("ok"),
    )


def normalize_json_b(raw: DataFrame, json_col: str = "payload", keep: list[str] | None = None) -> DataFrame:
    """Source-B responses to listings. A lift is assumed unless the payload denies it."""
    return _conform(parse_json_b(raw, json_col, keep).filter("ok"), keep or [])


def with_detail_text(
    df: DataFrame, details: DataFrame, key: str, text_col: str = "description", detail_col: str = "detail"
) -> DataFrame:
    """Take the detail page's text where it is longer than the preview.

    ``details`` holds at most one row per key; rows without one keep their preview.
    """
    longer = details.select(F.col(key), text.full_strip(F.col(detail_col)).alias("_detail"))
    joined = df.join(longer, key, "left")
    better = F.length("_detail") > F.length(F.coalesce(F.col(text_col), F.lit("")))
    return (
        joined.withColumn("upgraded", F.coalesce(better, F.lit(False)))
        .withColumn(text_col, F.when(better, F.col("_detail")).otherwise(F.col(text_col)))
        .drop("_detail")
    )

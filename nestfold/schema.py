"""Fixed schemas. Nullability carries meaning: null is "not exposed", never "no"."""

from __future__ import annotations

from pyspark.sql import types as T

EXTRACTION = T.StructType(
    [
        T.StructField("pets_allowed", T.StringType()),
        T.StructField("dishwasher", T.BooleanType()),
        T.StructField("elevator_confirmed", T.BooleanType()),
        T.StructField("heating_type_confirmed", T.StringType()),
        T.StructField("furnishing_confirmed", T.StringType()),
        T.StructField("max_lease_months", T.IntegerType()),
        T.StructField("bills_estimate_eur", T.IntegerType()),
        T.StructField("agency_or_owner", T.StringType()),
        T.StructField("red_flags", T.ArrayType(T.StringType())),
        T.StructField("summary_en", T.StringType()),
        T.StructField("description_en", T.StringType()),
    ]
)

# Columns every source normaliser produces, in order.
LISTING = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("source", T.StringType(), False),
        T.StructField("url", T.StringType(), False),
        T.StructField("price_eur", T.DoubleType(), False),
        T.StructField("m2", T.DoubleType(), False),
        T.StructField("rooms", T.DoubleType(), False),
        T.StructField("floor", T.IntegerType()),
        T.StructField("total_floors", T.IntegerType()),
        T.StructField("last_floor", T.BooleanType(), False),
        T.StructField("elevator", T.BooleanType()),
        T.StructField("furnished", T.StringType()),
        T.StructField("heating_type", T.StringType()),
        T.StructField("pets_allowed", T.BooleanType()),
        T.StructField("title", T.StringType(), False),
        T.StructField("description", T.StringType(), False),
        T.StructField("address", T.StringType()),
        T.StructField("place_names", T.ArrayType(T.StringType())),
        T.StructField("image_url", T.StringType()),
        T.StructField("is_agency", T.BooleanType(), False),
        T.StructField("created_at", T.TimestampType(), False),
        T.StructField("dishwasher", T.BooleanType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("lng", T.DoubleType()),
    ]
)

POST = T.StructType(
    [
        T.StructField("channel", T.StringType(), False),
        T.StructField("message_id", T.LongType(), False),
        T.StructField("text", T.StringType()),
        T.StructField("photo_urls", T.ArrayType(T.StringType())),
        T.StructField("posted_at", T.TimestampType()),
    ]
)

POST_FACTS = T.StructType(
    [
        T.StructField("m2", T.DoubleType()),
        T.StructField("pets_allowed", T.StringType()),
        T.StructField("address", T.StringType()),
        T.StructField("summary_en", T.StringType()),
    ]
)

# Raw payload of source A: one response per row. Numbers are read as text so that a malformed
# one drops its own advert only.
SEARCH_A = T.StructType(
    [
        T.StructField(
            "ads",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("id", T.StringType()),
                        T.StructField("createdAt", T.StringType()),
                        T.StructField("urlPath", T.StringType()),
                        T.StructField("price", T.StringType()),
                        T.StructField("m2", T.StringType()),
                        T.StructField("roomCount", T.StringType()),
                        T.StructField("redactedFloor", T.StringType()),
                        T.StructField("redactedTotalFloors", T.StringType()),
                        T.StructField("lastFloor", T.BooleanType()),
                        T.StructField("elevator", T.StringType()),
                        T.StructField("furnished", T.StringType()),
                        T.StructField("heatingType", T.StringType()),
                        T.StructField("petsAllowed", T.BooleanType()),
                        T.StructField("detailedTitle", T.StringType()),
                        T.StructField("title", T.StringType()),
                        T.StructField("description100", T.StringType()),
                        T.StructField("safeAddress", T.StringType()),
                        T.StructField("address", T.StringType()),
                        T.StructField("placeNames", T.ArrayType(T.StringType())),
                        T.StructField("agencyUrlPath", T.StringType()),
                        T.StructField(
                            "image",
                            T.StructType(
                                [
                                    T.StructField(
                                        "search",
                                        T.StructType(
                                            [
                                                T.StructField("380x0_fill_0_jpeg", T.StringType()),
                                                T.StructField("380x0_fill_0_webp", T.StringType()),
                                            ]
                                        ),
                                    )
                                ]
                            ),
                        ),
                    ]
                )
            ),
        )
    ]
)

# Raw payload of source B (second JSON shape). Code arrays mix numbers and strings, so they
# are read as strings.
SEARCH_B = T.StructType(
    [
        T.StructField(
            "result",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("uniqueID", T.StringType()),
                        T.StructField("propId", T.StringType()),
                        T.StructField("firstPublished", T.StringType()),
                        T.StructField("availableFrom", T.StringType()),
                        T.StructField("rentOrSale", T.StringType()),
                        T.StructField("location", T.StringType()),
                        T.StructField("floor", T.StringType()),
                        T.StructField("size", T.StringType()),
                        T.StructField("price", T.StringType()),
                        T.StructField("structure", T.StringType()),
                        T.StructField("furnished", T.IntegerType()),
                        T.StructField("furnishingArray", T.ArrayType(T.StringType())),
                        T.StructField("heatingArray", T.ArrayType(T.StringType())),
                        T.StructField("petsArray", T.ArrayType(T.StringType())),
                        T.StructField("isNoElevatorButLow", T.BooleanType()),
                        T.StructField("isNotLastFloor", T.BooleanType()),
                        T.StructField("street", T.StringType()),
                        T.StructField("municipality", T.StringType()),
                        T.StructField("polygons", T.ArrayType(T.StringType())),
                        T.StructField("coverPhoto", T.StringType()),
                    ]
                )
            ),
        ),
        T.StructField(
            "info", T.StructType([T.StructField("isLastPage", T.BooleanType())])
        ),
    ]
)

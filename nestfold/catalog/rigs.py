"""Input rigs: listings, payloads, state and clicks derived from the given tables.

A rig is one SQL text in the dialect both engines share, so the operator under test and its
check read the same rows. Attributes are arithmetic hashes of a unique key.
"""

from __future__ import annotations

import zlib
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from nestfold.config import Destination
from nestfold.session import configure

AS_OF = datetime(2026, 6, 1, 12, 0, 0)
AS_OF_SQL = "TIMESTAMP '2026-06-01 12:00:00'"
PRIME = 2147483647
SOURCES = ["4zida", "cityexpert", "nekretnine", "halooglasi"]


def h(name: str, n: int, key: str = "j") -> str:
    """A number in [0, n) that depends on ``key`` and the attribute name."""
    a = zlib.crc32(name.encode()) % 1_000_003 + 1_000_003
    b = zlib.crc32(name[::-1].encode()) % PRIME
    mixed = f"((({key} + 17) * {a} + {b}) % {PRIME} * {a % 7919 + 104729} % {PRIME})"
    return f"({mixed} % {n})"


def pick(number: str, words: list[str | None]) -> str:
    cases = " ".join(
        f"WHEN {i} THEN " + ("NULL" if w is None else "'" + w.replace("'", "''") + "'")
        for i, w in enumerate(words)
    )
    return f"CASE {number} {cases} END"


def flag(number: str) -> str:
    """Three states: true, false, unknown."""
    return f"CASE {number} WHEN 0 THEN true WHEN 1 THEN false END"


HEAT_WORDS = [
    "district", "central", "gas", "tapec", "centralno", "Centralno", " etažno ", "podno", "TA",
    "klima", "električno", "podno grejanje", "centralno grejanje", "nepoznato", "", None, "etazno", "\tGas\u00a0\n",
]
FURN_WORDS = [
    "yes", "semi", "no", "furnished", "Namešten", "namesten", "polunamešten", "prazan", "empty",
    "???", "", None, " yes ", "semi-furnished", "\u00a0Yes\t",
]
PHRASES = [
    "Bez ljubimaca.",
    "Ljubimci dozvoljeni.",
    "Ima mašina za sudove.",
    "Centralno grejanje, namešten.",
    "Etažno grejanje, polunamešten.",
    "Minimum 18 meseci, računi oko 250.",
    "Prazan stan, samo studenti.",
    "Vlasnik, lift, pets ok.",
    "Agencija nudi, bills 90.",
    "",
]
PLACES = ["Vračar,Beograd", "Dorćol,Stari grad,Beograd", "Blok 45,Novi Beograd,Beograd", "Beograd", ""]

LISTINGS = f"""
SELECT k AS seq,
  CAST(k AS STRING) AS id,
  {pick('k % 4', SOURCES)} AS source,
  {pick('k % 4', SOURCES)} || ':' || CAST(k AS STRING) AS listing_key,
  'https://example.org/stan/' || CAST(k AS STRING) AS url,
  CAST(400 + {h('price', 1200)} + CASE WHEN k <> j THEN CAST(FLOOR(k / 10) AS BIGINT) % 4 * 30 ELSE 0 END AS DOUBLE) AS price_eur,
  0.5 * (1 + {h('rooms', 8)}) AS rooms,
  CAST(25 + {h('m2', 100)} AS DOUBLE) AS m2,
  CASE WHEN {h('nofloor', 17)} = 0 THEN NULL ELSE CAST({h('floor', 9)} - 1 AS INT) END AS floor,
  CAST({h('floors', 9)} + 1 AS INT) AS total_floors,
  false AS last_floor,
  {flag(h('lift', 3))} AS elevator,
  {pick(h('furn', 15), FURN_WORDS)} AS furnished,
  {pick(h('heat', 18), HEAT_WORDS)} AS heating_type,
  {flag(h('pets', 3))} AS pets_allowed,
  'Stan ' || substr(md5(CAST(j AS STRING)), 1, 24) AS title,
  'Opis ' || substr(md5(CAST(j AS STRING)), 1, 6) || '. ' || {pick(h('say', 10), PHRASES)} || ' ' || {pick(h('say2', 10), PHRASES)} AS description,
  CASE WHEN {h('addr', 5)} = 0 THEN NULL ELSE 'Ulica ' || CAST({h('street', 400)} AS STRING) || ', sprat ' || CAST({h('floor', 9)} AS STRING) END AS address,
  {pick(h('place', 5), PLACES)} AS places,
  CASE WHEN {h('photo', 20)} = 0 THEN '  ' WHEN {h('photo', 20)} = 1 THEN NULL ELSE 'https://img.example.org/' || CAST(j AS STRING) END AS image_url,
  ({h('agency', 2)} = 0) AS is_agency,
  {AS_OF_SQL} - {h('age', 240)} * INTERVAL '1' HOUR AS created_at,
  {flag(h('dish', 3))} AS dishwasher,
  CASE WHEN {h('geo', 6)} = 0 THEN NULL ELSE 44.70 + {h('lat', 250)} * 0.0004 END AS lat,
  CASE WHEN {h('geo', 6)} = 0 THEN NULL ELSE 20.35 + {h('lng', 250)} * 0.0004 END AS lng,
  CASE WHEN {h('img', 4)} = 0 THEN NULL ELSE {h('code1', PRIME)} * 4294967296 + {h('code2', PRIME)} * 2 - ({h('code2', PRIME)} * 2) % 8 + k % 8 END AS code,
  {pick(h('xpets', 3), ['yes', 'no', 'unknown'])} AS x_pets,
  {flag(h('xdish', 3))} AS x_dish,
  {pick(h('xheat', 18, 'j + 5'), HEAT_WORDS)} AS x_heat,
  {pick(h('xfurn', 15, 'j + 5'), FURN_WORDS)} AS x_furn,
  CASE WHEN {h('lease', 4)} = 0 THEN CAST({h('months', 24)} AS INT) END AS x_lease,
  CASE WHEN {h('bills', 2)} = 0 THEN CAST(100 + {h('eur', 200)} AS INT) END AS x_bills
FROM (SELECT o_orderkey AS k,
             CASE WHEN o_orderkey % 10 = 0 AND o_orderkey > 0 THEN o_orderkey - 1 ELSE o_orderkey END AS j
      FROM {{orders}}) o
"""

# Previously notified rows, the stored snapshot and caches, keyed like the listings.
HISTORY = f"""
SELECT listing_key, price_eur AS old_price,
  {AS_OF_SQL} - 40 * INTERVAL '24' HOUR AS first_seen_at,
  {AS_OF_SQL} - (seq % 30) * INTERVAL '24' HOUR AS last_seen_at,
  CASE WHEN seq % 3 = 0 THEN {AS_OF_SQL} - (seq % 30) * INTERVAL '24' HOUR END AS notified_at,
  CASE WHEN seq % 3 = 0 AND seq % 11 > 0 THEN price_eur * (1 + (seq % 9 - 3) * 0.02) END AS notified_price,
  CASE WHEN seq % 3 = 0 THEN CASE WHEN seq % 2 = 0 THEN 'match' ELSE 'near_miss' END END AS notified_stage,
  seq
FROM ({LISTINGS}) l WHERE seq % 7 <> 0
"""

CLICKS = """
SELECT event_id AS update_id, ts, user_id,
  CASE event_type WHEN 'click' THEN 'skip:' WHEN 'signup' THEN 'fav:' WHEN 'error' THEN 'unfav:'
                  WHEN 'view' THEN 'look:' ELSE '' END || CAST(user_id AS STRING) AS data
FROM {events}
"""

CODES_BASE = "SELECT vec_id, embedding, label FROM {embeddings}"

TITLES = """
SELECT doc_id AS seq, CAST(doc_id AS STRING) AS listing_key,
  CAST(500 + 10 * (n_chars % 50) AS DOUBLE) AS price_eur, text AS description, source, lang
FROM {documents}
"""

# Free-form posts: document text with a planted sentence.
POST_LINES = [
    "60m2, ljubimci dozvoljeni, adresa: Krunska 35, centar. #аренда",
    "72.5 m², pets ok #Аренда!",
    "45m2 pets allowed #арендаквартиры",
    "80 кв, bez ljubimaca. #АРЕНДА",
    "Izdajem stan, bez detalja",
    "55m2 pets ok, adresa: Njegoševa 1",
    "66,5m2 разрешены животные, adresa: Bulevar 7.",
]
POSTS = f"""
SELECT source AS channel, doc_id AS message_id, {pick('doc_id % 7', POST_LINES)} || ' ' || text AS text,
  TIMESTAMP '2026-05-01 00:00:00' + (doc_id % 700) * INTERVAL '1' HOUR AS posted_at
FROM {{documents}}
"""

DESTINATIONS = [
    Destination("office", 44.80, 20.46, True, 0.45),
    Destination("nursery", 44.77, 20.44, True, 0.25),
    Destination("park", 44.82, 20.40, False, 0.05),
]

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]
# Tables whose rows carry enough work to be worth spreading.
SPREAD = {"orders", "documents", "pages", "part", "customer"}


# Listing rows compress more than tenfold in an exchange, so partitions are put together up to a few megabytes only:
# what a task sorts stays bounded however large the input is.
EXCHANGED_BYTES = "8m"
# Narrow columns make a split of a file many rows, and listings are far wider than the keys that they are made from.
ROWS_A_TASK = 250_000
_ROWS: dict[str, int] = {}


def _rows(df: DataFrame, path: str) -> int:
    """The rows of a given table as its files' footers count them, once an application."""
    name = f"{df.sparkSession.sparkContext.applicationId} {path}"
    if name not in _ROWS:
        _ROWS[name] = df.count()
    return _ROWS[name]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. One small file is one task however many cores there are, and a split of a large one any number of rows,
    so an input with fewer partitions than cores, or with more rows in them than a task should widen, is spread."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name not in SPREAD:
        return df
    wanted = max(spark.sparkContext.defaultParallelism, -(-_rows(df, f"{sf_dir}/{name}") // ROWS_A_TASK))
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df


def rig(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The rig's rows in Spark."""
    configure(spark).conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", EXCHANGED_BYTES)
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in sql}
    return spark.sql(sql, **used)


def text_of(sql: str) -> str:
    """The rig's SQL with plain table names."""
    return sql.format(**{t: t for t in TABLES})


def with_parts(listings: DataFrame) -> DataFrame:
    """Listing rig with its array and struct columns."""
    from pyspark.sql import functions as F

    from nestfold import schema

    said = {
        "pets_allowed": "x_pets",
        "dishwasher": "x_dish",
        "heating_type_confirmed": "x_heat",
        "furnishing_confirmed": "x_furn",
        "max_lease_months": "x_lease",
        "bills_estimate_eur": "x_bills",
    }
    # Every ninth row was never looked at.
    extraction = F.struct(
        *[
            (F.col(said[f.name]) if f.name in said else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.EXTRACTION.fields
        ]
    )
    places = F.filter(F.split("places", ","), lambda p: p != "")
    return (
        listings.withColumn("extraction", F.when(F.col("seq") % 9 != 0, extraction))
        .withColumn("place_names", places)
        .drop("places", *said.values())
    )


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_parts(rig(spark, sf_dir, LISTINGS))

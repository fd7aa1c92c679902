"""Listing rules, distances, ranking and notification over the listing rig."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nestfold.catalog import rigs
from nestfold.catalog.rigs import AS_OF, AS_OF_SQL, DESTINATIONS, HISTORY, LISTINGS
from nestfold.config import FilterConfig, MatchConfig
from nestfold.functions import geo, parse, present, vocab
from nestfold.operators import distance, metrics, notify, rank, rules, similarity, snapshot, state
from nestfold.session import work_folder
from nestfold.sources import captured, feed

CFG = FilterConfig()
STRICT = FilterConfig(elevator_required=True, dishwasher_required=True)
L = f"({rigs.text_of(LISTINGS)})"
HIST = f"({rigs.text_of(HISTORY)})"


def _ruled(spark: SparkSession, d: str, cfg: FilterConfig = CFG) -> DataFrame:
    return rules.structural_filter(rigs.listings(spark, d), cfg, AS_OF)


# --- structural rules ----------------------------------------------------------------------


def structural_filter(spark, d):
    return _ruled(spark, d, STRICT).select("listing_key", "rule_id", "reject_reason")


def _structural_sql(cfg: FilterConfig, cols: str = "*") -> str:
    lift = "WHEN floor > 0 AND elevator IS NOT DISTINCT FROM false THEN 'elevator'" if cfg.elevator_required else ""
    return f"""
SELECT {cols} FROM (SELECT *, CASE
    WHEN price_eur <= 0 OR price_eur > {cfg.price_eur_max} THEN 'price'
    WHEN rooms < {cfg.rooms_min} OR rooms > {cfg.rooms_max} THEN 'rooms'
    WHEN m2 < {cfg.surface_m2_min} THEN 'surface'
    WHEN floor IS NULL THEN 'floor_unknown'
    WHEN floor < 0 THEN 'basement'
    {lift}
    WHEN created_at < {AS_OF_SQL} - INTERVAL 7 DAY THEN 'age'
    WHEN trim(coalesce(image_url, '')) = '' THEN 'photo' END AS rule_id FROM {L} l) r"""


STRUCTURAL_SQL = f"""
SELECT listing_key, rule_id, CASE rule_id
  WHEN 'price' THEN 'price ' || price_eur || '€ > cap 1100.0€'
  WHEN 'rooms' THEN 'rooms ' || CAST(rooms AS DOUBLE) || ' outside [1.5, 3.0]'
  WHEN 'surface' THEN 'surface ' || m2 || 'm² < 55.0m²'
  WHEN 'floor_unknown' THEN 'floor unknown'
  WHEN 'basement' THEN 'basement floor (' || floor || ')'
  WHEN 'elevator' THEN 'no elevator'
  WHEN 'age' THEN 'older than 7d'
  WHEN 'photo' THEN 'no photo' END AS reject_reason
FROM ({_structural_sql(STRICT)}) q"""


# --- facts rules ---------------------------------------------------------------------------


def facts_filter(spark, d):
    out = rules.facts_filter(rigs.listings(spark, d), STRICT)
    return out.select(
        "listing_key", "verdict", F.get("hard", F.lit(0)).alias("first_hard"),
        F.array_join("soft", "; ").alias("soft_reasons"), F.size("hard").alias("n_hard"),
    )


def _case_map(col: str, table: dict[str, str]) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items())
    return f"CASE lower(trim({col}, chr(32) || chr(9) || chr(10) || chr(160))) {whens} END"


FACTS_VALUES = f"""
SELECT *, coalesce(pets_allowed, CASE WHEN looked THEN CASE x_pets WHEN 'yes' THEN true WHEN 'no' THEN false END END) AS pets,
  CASE WHEN dishwasher THEN true WHEN looked THEN x_dish END AS dish,
  coalesce({_case_map('heating_type', vocab.HEATING)}, CASE WHEN looked THEN {_case_map('x_heat', vocab.HEATING)} END) AS heat,
  coalesce({_case_map('furnished', vocab.FURNISHING)}, CASE WHEN looked THEN {_case_map('x_furn', vocab.FURNISHING)} END) AS furn,
  CASE WHEN looked THEN x_lease END AS lease
FROM (SELECT *, seq % 9 <> 0 AS looked FROM {L} l0) l1"""


def _facts_sql(dish: bool) -> str:
    dish_hard = "CASE WHEN dish = false THEN 'no dishwasher' END," if dish else ""
    dish_soft = "CASE WHEN dish IS NULL THEN 'dishwasher unclear' END," if dish else ""
    return f"""
SELECT *, CASE WHEN len(hard) > 0 THEN 'rejected' WHEN len(soft) > 0 THEN 'near_miss' ELSE 'passed' END AS verdict
FROM (SELECT *, list_filter([
    CASE WHEN pets = false THEN 'pets not allowed' END, {dish_hard}
    CASE WHEN heat NOT IN ('centralno','etazno','podno') THEN 'heating=' || heat || ' not in [''centralno'', ''etazno'', ''podno'']' END,
    CASE WHEN furn NOT IN ('furnished','semi-furnished') THEN 'furnishing=' || furn || ' not in [''furnished'', ''semi-furnished'']' END,
    CASE WHEN lease > 12 THEN 'min lease ' || lease || 'mo > 12mo' END], lambda x: x IS NOT NULL) AS hard,
  list_filter([{dish_soft} CASE WHEN heat IS NULL THEN 'heating unclear' END,
    CASE WHEN furn IS NULL THEN 'furnishing unclear' END], lambda x: x IS NOT NULL) AS soft
  FROM ({FACTS_VALUES}) v) w"""


FACTS_SQL = f"""
SELECT listing_key, verdict, hard[1] AS first_hard, array_to_string(soft, '; ') AS soft_reasons,
  CAST(len(hard) AS INT) AS n_hard FROM ({_facts_sql(True)}) f"""


def canonicalize_vocab(spark, d):
    df = rules.canonicalize_vocab(rigs.listings(spark, d), "heating_type", vocab.HEATING, "heating")
    terms = spark.createDataFrame(list(vocab.FURNISHING.items()), "raw string, canonical string")
    df = rules.canonicalize_vocab(df, "furnished", terms, "furnishing")
    return df.select("listing_key", "heating", "furnishing")


CANON_SQL = f"""
SELECT listing_key, {_case_map('heating_type', vocab.HEATING)} AS heating, {_case_map('furnished', vocab.FURNISHING)} AS furnishing
FROM {L} l"""


def resolve_tristate(spark, d):
    df = rigs.listings(spark, d)
    out = vocab.resolve_tristate(F.col("pets_allowed"), F.col("extraction.pets_allowed"))
    return df.select("listing_key", out.cast("int").alias("pets"))


def pets_state(spark, d):
    said = F.col("extraction.pets_allowed")
    return rigs.listings(spark, d).select(
        "listing_key",
        vocab.pets_state(F.col("pets_allowed"), said, "digest").alias("digest_state"),
        vocab.pets_state(F.col("pets_allowed"), said, "card").alias("card_state"),
    )


PETS_STATE_SQL = f"""
SELECT listing_key,
  CASE WHEN pets_allowed THEN 'yes' WHEN pets_allowed = false THEN 'no' WHEN seq % 9 <> 0 THEN x_pets ELSE 'unknown' END AS digest_state,
  CASE WHEN pets_allowed THEN 'yes' WHEN seq % 9 <> 0 THEN x_pets WHEN pets_allowed = false THEN 'no' ELSE 'unknown' END AS card_state
FROM {L} l"""


# --- distances -----------------------------------------------------------------------------

KM_SQL = "6371.0 * 2 * asin(sqrt(pow(sin(radians({b} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({b})) * pow(sin(radians({d} - {c}) / 2), 2)))"
DEST_SQL = "(VALUES " + ", ".join(
    f"({i}, '{x.name}', CAST({x.lat} AS DOUBLE), CAST({x.lng} AS DOUBLE), {x.gates}, CAST({x.score_weight} AS DOUBLE))"
    for i, x in enumerate(DESTINATIONS)
) + ") AS t(ord, dest, dlat, dlng, gates, weight)"
KM = KM_SQL.format(a="lat", b="dlat", c="lng", d="dlng")


def haversine(spark, d):
    o = DESTINATIONS[0]
    km = geo.haversine(F.col("lat"), F.col("lng"), F.lit(o.lat), F.lit(o.lng))
    return rigs.listings(spark, d).select("listing_key", F.round(km, 6).alias("km"))


HAVERSINE_SQL = f"SELECT listing_key, round({KM}, 6) AS km FROM {L} l JOIN {DEST_SQL} ON ord = 0"


def grid_key(spark, d):
    df = rigs.listings(spark, d)
    cols = [F.col(c) for c in ("lat", "lng", "address", "place_names", "listing_key")]
    return df.select("listing_key", geo.grid_key(*cols, F.lit("office")).alias("grid_key"))


PLACE_SQL = """CASE WHEN lat IS NOT NULL AND lng IS NOT NULL THEN round(lat, 3) || ',' || round(lng, 3)
  WHEN trim(lower(concat_ws(' ', nullif(address, ''), nullif(replace(places, ',', ' '), '')))) <> ''
  THEN 'addr:' || substr(sha1(trim(lower(concat_ws(' ', nullif(address, ''), nullif(replace(places, ',', ' '), ''))))), 1, 16)
  ELSE 'id:' || listing_key END"""
GRID_SQL = f"SELECT listing_key, {PLACE_SQL} || '@office' AS grid_key FROM {L} l"


def distance_matrix(spark, d):
    out = distance.distance_matrix(rigs.listings(spark, d), DESTINATIONS)
    return out.select("listing_key", "dest", F.round("km", 6).alias("km"))


def distance_matrix_table(spark, d):
    """Destinations read from a table."""
    rows = rigs.table(spark, d, "nation").select(
        F.col("n_name").alias("name"), (F.lit(44.0) + F.col("n_nationkey") / 64).alias("lat"), F.lit(20.5).alias("lng"),
        F.lit(False).alias("gates"), F.lit(0.0).alias("score_weight"),
    )
    out = distance.distance_matrix(rigs.listings(spark, d), distance.load_destinations(rows))
    return out.select("listing_key", "dest", F.round("km", 6).alias("km"))


MATRIX_SQL = f"SELECT listing_key, dest, round({KM}, 6) AS km FROM {L} l CROSS JOIN {DEST_SQL}"
MATRIX_TABLE_SQL = f"""SELECT listing_key, dest, round({KM}, 6) AS km FROM {L} l
CROSS JOIN (SELECT n_name AS dest, 44.0::DOUBLE + n_nationkey / 64 AS dlat, 20.5::DOUBLE AS dlng FROM nation) x"""


def _walk_cache(spark, d) -> DataFrame:
    """Entries for a third of the cells, some expired, some holding null."""
    asked = rigs.rig(spark, d, LISTINGS).filter("seq % 3 = 0 and lat is not null")
    cell = F.concat(geo.coord_cell(F.col("lat"), F.col("lng"), 3), F.lit("@office"))
    rows = asked.select(cell.alias("grid_key"), "seq").groupBy("grid_key").agg(F.min("seq").alias("s"))
    return rows.select(
        "grid_key",
        F.when(F.col("s") % 5 > 0, (F.col("s") % 60).cast("int")).alias("walk_min"),
        (F.lit(AS_OF) - F.make_dt_interval((F.col("s") % 120).cast("int"))).alias("fetched_at"),
    )


CACHE_SQL = f"""
SELECT grid_key, CASE WHEN s % 5 > 0 THEN CAST(s % 60 AS INT) END AS walk_min, {AS_OF_SQL} - (s % 120) * INTERVAL 1 DAY AS fetched_at
FROM (SELECT round(lat, 3) || ',' || round(lng, 3) || '@office' AS grid_key, min(seq) AS s
      FROM {L} l WHERE seq % 3 = 0 AND lat IS NOT NULL GROUP BY 1) c"""


def _provider(requests: DataFrame) -> DataFrame:
    """Twelve minutes per km, as a duration text; one street in ten has no answer yet."""
    km = geo.haversine(F.col("lat"), F.col("lng"), F.col("dest_lat"), F.col("dest_lng"))
    text = F.concat((F.floor(km * 720)).cast("string"), F.lit("s"))
    answered = F.col("lat").isNotNull() | ~F.coalesce(F.col("address"), F.lit("")).contains("7")
    return requests.filter(answered).select("grid_key", parse.duration_minutes(text).alias("walk_min"))


def _walks(spark, d) -> tuple[DataFrame, DataFrame]:
    return distance.resolve_walk(
        rigs.listings(spark, d), DESTINATIONS, _walk_cache(spark, d), _provider, AS_OF
    )


WALKS_SQL = f"""
WITH req AS (SELECT seq, listing_key, dest, dlat, dlng, lat, lng, address, {PLACE_SQL} || '@' || dest AS grid_key
             FROM {L} l CROSS JOIN {DEST_SQL}),
 one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY grid_key ORDER BY seq) AS rn FROM req) r WHERE rn = 1),
 cache AS (SELECT * FROM ({CACHE_SQL}) c WHERE fetched_at > {AS_OF_SQL} - INTERVAL 90 DAY),
 known AS (
  SELECT one.grid_key,
    CASE WHEN cache.grid_key IS NOT NULL THEN 'cache' WHEN {KM} > 10 THEN 'too_far'
         WHEN lat IS NOT NULL OR coalesce(address, '') NOT LIKE '%7%' THEN 'provider' END AS walk_source,
    CASE WHEN cache.grid_key IS NOT NULL THEN cache.walk_min WHEN {KM} > 10 THEN NULL
         ELSE CAST(round_even(floor({KM} * 720) / 60, 0) AS INT) END AS walk_min
  FROM one LEFT JOIN cache ON one.grid_key = cache.grid_key)"""


def resolve_walk(spark, d):
    walks, _ = _walks(spark, d)
    return walks.select("listing_key", "dest", "walk_min", "walk_source")


RESOLVE_SQL = WALKS_SQL + """
SELECT listing_key, dest, walk_min, walk_source FROM req JOIN known USING (grid_key)"""


def resolve_walk_cache(spark, d):
    _, cache = _walks(spark, d)
    return cache.select("grid_key", "walk_min", F.date_format("fetched_at", "yyyy-MM-dd").alias("fetched_on"))


RESOLVE_CACHE_SQL = WALKS_SQL + f""",
 fresh AS (SELECT grid_key, walk_min, '2026-06-01' AS fetched_on FROM known WHERE walk_source IN ('too_far', 'provider'))
SELECT * FROM fresh UNION ALL
SELECT grid_key, walk_min, strftime(fetched_at, '%Y-%m-%d') FROM ({CACHE_SQL}) c WHERE grid_key NOT IN (SELECT grid_key FROM fresh)"""


def _with_commute(spark, d) -> DataFrame:
    walks, _ = _walks(spark, d)
    return rigs.listings(spark, d).join(distance.commute_map(walks), "listing_key", "left")


def commute_map(spark, d):
    walks, _ = _walks(spark, d)
    entry = lambda n: F.try_element_at("commute", F.lit(n))
    return distance.commute_map(walks).select(
        "listing_key", *[entry(x.name).alias(x.name) for x in DESTINATIONS], F.size("commute").alias("known")
    )


COMMUTE_MAP_SQL = WALKS_SQL + """
SELECT listing_key, max(walk_min) FILTER (dest = 'office') AS office, max(walk_min) FILTER (dest = 'nursery') AS nursery,
  max(walk_min) FILTER (dest = 'park') AS park, CAST(count(walk_source) AS INT) AS known
FROM req JOIN known USING (grid_key) GROUP BY 1"""


def commute_gate(spark, d):
    gating = [x.name for x in DESTINATIONS if x.gates]
    return rules.commute_gate(_with_commute(spark, d), gating, 40).select("listing_key", "gate_reason")


GATE_SQL = WALKS_SQL + f""",
 gates AS (SELECT listing_key, ord, CASE WHEN walk_min IS NULL THEN 'no walking route to ' || req.dest
    WHEN walk_min > 40 THEN req.dest || ' ' || walk_min || 'm > 40m walk' END AS why
  FROM req JOIN known USING (grid_key) JOIN {DEST_SQL} ON req.dest = t.dest WHERE gates)
SELECT listing_key, arg_min(why, ord) FILTER (why IS NOT NULL) AS gate_reason FROM gates GROUP BY 1"""


def ttl_cache_lookup(spark, d):
    asked = rigs.listings(spark, d).select(
        "listing_key",
        F.concat(geo.coord_cell(F.col("lat"), F.col("lng"), 3), F.lit("@office")).alias("grid_key"),
    )
    out = state.ttl_cache_lookup(asked, _walk_cache(spark, d), "grid_key", "walk_min", "fetched_at", 90, AS_OF)
    return out.select("listing_key", F.col("hit").cast("int").alias("hit"), "walk_min")


TTL_SQL = f"""
SELECT listing_key, CAST(c.grid_key IS NOT NULL AS INT) AS hit, c.walk_min FROM {L} l
LEFT JOIN (SELECT * FROM ({CACHE_SQL}) x WHERE fetched_at > {AS_OF_SQL} - INTERVAL 90 DAY) c
  ON c.grid_key = round(lat, 3) || ',' || round(lng, 3) || '@office'"""


def monthly_call_count(spark, d):
    return metrics.monthly_call_count(_walk_cache(spark, d), AS_OF.replace(month=5, day=20))


MONTHLY_SQL = f"SELECT count(*) AS calls FROM ({CACHE_SQL}) c WHERE fetched_at >= TIMESTAMP '2026-05-01'"


# --- ranking -------------------------------------------------------------------------------


def _plain_ranked(spark, d) -> DataFrame:
    """Survivors of the structural rules with walking times straight from the distance."""
    alive = _ruled(spark, d).filter("rule_id is null")
    entries = []
    for x in DESTINATIONS:
        km = geo.haversine(F.col("lat"), F.col("lng"), F.lit(x.lat), F.lit(x.lng))
        entries += [F.lit(x.name), F.floor(km * 12).cast("int")]
    alive = alive.withColumn("commute", F.create_map(*entries))
    return rank.rank_listings(alive, DESTINATIONS, CFG.freshness_days, AS_OF)


CLOSE = " + ".join(
    f"{x.score_weight} * coalesce(greatest(0, 1 - floor({KM_SQL.format(a='lat', b=x.lat, c='lng', d=x.lng)} * 12) / 40), 0)"
    for x in DESTINATIONS
)
RANKED_SQL = f"""
SELECT *, CASE WHEN coalesce(pets_allowed, false) OR (seq % 9 <> 0 AND x_pets = 'yes') THEN 1 ELSE 0 END AS tier,
  {CLOSE} + 0.1 * least(1, m2 / 80) + 0.1 * greatest(0, 1 - epoch({AS_OF_SQL} - created_at) / 3600 / 168)
  + CASE WHEN elevator THEN 0.1 ELSE 0 END AS score
FROM ({_structural_sql(CFG)}) s WHERE rule_id IS NULL"""


def rank_listings(spark, d):
    return _plain_ranked(spark, d).select("listing_key", "tier", F.round("score", 6).alias("score"))


def digest_topk(spark, d):
    # Scores are ordered at six decimals, so that both engines see the same ties.
    rows, _ = rank.digest_topk(_plain_ranked(spark, d).withColumn("score", F.round("score", 6)), 10)
    return rows.select("rank", "listing_key", "tier", "score")


TOPK_SQL = f"""
SELECT CAST(row_number() OVER (ORDER BY tier DESC, round(score, 6) DESC, seq) AS INT) AS rank, listing_key, tier, round(score, 6) AS score
FROM ({RANKED_SQL}) r ORDER BY rank LIMIT 10"""


def digest_overflow(spark, d):
    _, rest = rank.digest_topk(_plain_ranked(spark, d), 10)
    return rest


OVERFLOW_SQL = f"SELECT greatest(count(*) - 10, 0) AS overflow FROM ({RANKED_SQL}) r"


SHORT_SQL = """concat_ws(', ', nullif(trim(split_part(address, ',', 1)), ''),
  CASE WHEN places <> '' AND split_part(places, ',', -1) IS DISTINCT FROM trim(split_part(address, ',', 1)) THEN split_part(places, ',', -1) END, 'Belgrade')"""
HOURS = f"CAST(floor(epoch({AS_OF_SQL} - created_at) / 3600) AS BIGINT)"
POSTED_SQL = f"""CASE WHEN {HOURS} < 1 THEN 'just now' WHEN {HOURS} < 24 THEN {HOURS} || ' h ago'
  WHEN {HOURS} < 48 THEN 'yesterday' ELSE CAST(floor({HOURS} / 24) AS BIGINT) || ' days ago' END"""

def short_address(spark, d):
    return rigs.listings(spark, d).select(
        "listing_key", present.short_address(F.col("address"), F.col("place_names")).alias("short_address")
    )


def relative_time(spark, d):
    return rigs.listings(spark, d).select(
        "listing_key",
        present.relative_time(F.col("created_at"), F.lit(AS_OF).cast("timestamp")).alias("posted"),
    )


def build_urls(spark, d):
    df = rigs.listings(spark, d)
    o = DESTINATIONS[0]
    at = [F.col(c) for c in ("lat", "lng", "address", "place_names")]
    return df.select(
        "listing_key",
        present.image_url_b(F.col("id"), F.concat(F.lit("p"), "id", F.lit(".jpg"))).alias("image"),
        present.listing_url_b(F.col("id"), F.when(F.col("is_agency"), "s")).alias("link"),
        present.maps_url(*at).alias("map"),
        present.route_url(*at, F.lit(o.lat), F.lit(o.lng)).alias("route"),
    )


_POINT = f"CASE WHEN lat IS NOT NULL THEN lat || ',' || lng ELSE replace(url_encode({SHORT_SQL}), '%2F', '/') END"
URLS_SQL = f"""
SELECT listing_key,
  'https://img.cityexpert.rs/properties/720x/' || (seq - seq % 1000) || '/' || id || '/slike/p' || id || '.jpg' AS image,
  CASE WHEN is_agency THEN 'https://cityexpert.rs/prodaja-nekretnina/beograd/' ELSE 'https://cityexpert.rs/izdavanje-nekretnina/beograd/' END || id || '/stan' AS link,
  'https://www.google.com/maps?q=' || {_POINT} AS map,
  'https://www.google.com/maps/dir/?api=1&origin=' || {_POINT} || '&destination=44.8,20.46&travelmode=walking' AS route
FROM {L} l"""


def rejection_tally(spark, d):
    tally, _, _ = rank.rejection_tally(_ruled(spark, d).filter("rule_id is not null"))
    return tally


def rejection_shown(spark, d):
    _, shown, _ = rank.rejection_tally(_ruled(spark, d).filter("rule_id is not null"))
    return shown.select("seq", "rule_id")


def rejection_remainder(spark, d):
    return rank.rejection_tally(_ruled(spark, d).filter("rule_id is not null"))[2]


def pick_canonical(spark, d):
    df = similarity.grid_signature(rigs.listings(spark, d).filter("lat is not null"))
    df = df.withColumn("cluster", F.concat_ws("|", "cell", F.col("price_cell").cast("string")))
    out = rank.pick_canonical(df, "cluster", vocab.source_rank(F.col("source")), cols=["listing_key", "source", "seq"])
    return out.select("cluster", "cluster_size", "listing_key")


CANONICAL_SQL = f"""
SELECT cluster, count(*) AS cluster_size,
  arg_min(listing_key, struct_pack(a := list_position(['4zida','cityexpert','nekretnine','halooglasi'], source), b := -epoch(created_at), c := seq)) AS listing_key
FROM (SELECT *, round(lat, 4) || ',' || round(lng, 4) || '|' || CAST(floor(price_eur / 50) AS BIGINT) AS cluster
      FROM {L} l WHERE lat IS NOT NULL) c GROUP BY 1"""


def grid_bucket_join(spark, d):
    # Sizes get a fraction here so that neighbours below the tolerance exist.
    df = rigs.listings(spark, d).withColumn("m2", F.col("m2") + (F.col("seq") % 4) / 4)
    out = similarity.grid_bucket_join(df, cfg=MatchConfig(coord_decimals=2))
    return out.select("cell", "price_cell", "m2_a", "m2_b")


GRID_JOIN_SQL = f"""
WITH s AS (SELECT DISTINCT round(lat, 2) || ',' || round(lng, 2) AS cell, CAST(floor(price_eur / 50) AS BIGINT) AS price_cell,
             m2 + (seq % 4) / 4 AS m2 FROM {L} l WHERE lat IS NOT NULL)
SELECT a.cell, a.price_cell, a.m2 AS m2_a, b.m2 AS m2_b FROM s a JOIN s b USING (cell, price_cell)
WHERE a.m2 < b.m2 AND b.m2 - a.m2 < 1"""


# --- change detection ------------------------------------------------------------------------


def _history(spark, d) -> DataFrame:
    return rigs.rig(spark, d, HISTORY)


def _reasoned(spark, d) -> DataFrame:
    df = rigs.listings(spark, d).withColumn("stage", F.when(F.col("seq") % 5 > 0, "match").otherwise("near_miss"))
    return notify.notify_reason(df, _history(spark, d), AS_OF)


def notify_reason(spark, d):
    return _reasoned(spark, d).select("listing_key", "stage", "notify_reason")


REASON_SQL = f"""
SELECT l.listing_key, CASE WHEN l.seq % 5 > 0 THEN 'match' ELSE 'near_miss' END AS stage,
  CASE WHEN notified_at IS NULL THEN 'new'
    WHEN notified_price IS NOT NULL AND price_eur < notified_price * (1 - 0.05::DOUBLE) THEN 'price_drop'
    WHEN notified_price IS NOT NULL AND price_eur <> notified_price THEN 'price_change'
    WHEN l.seq % 5 > 0 AND notified_stage = 'near_miss' THEN 'upgraded'
    WHEN {AS_OF_SQL} - notified_at > INTERVAL 14 DAY THEN 'relisted' END AS notify_reason, l.price_eur
FROM {L} l LEFT JOIN {HIST} hh USING (listing_key)"""


def renotify_gate(spark, d):
    rows = _reasoned(spark, d)
    modes = {"digest": ("digest", False), "instant": ("instant", False), "forced": ("digest", True)}
    gated = [notify.renotify_gate(rows, *how).select(F.lit(name).alias("mode"), "listing_key", "notify_reason") for name, how in modes.items()]
    return reduce(DataFrame.unionByName, gated)


def fresh_only(spark, d):
    return state.fresh_only(rigs.listings(spark, d), _history(spark, d)).select("listing_key", "source")


def mark_notified(spark, d):
    sent = notify.renotify_gate(_reasoned(spark, d), "digest")
    out = notify.mark_notified(_history(spark, d), sent, AS_OF)
    return out.select(
        "listing_key",
        F.date_format("notified_at", "yyyy-MM-dd HH:mm:ss").alias("notified_at"),
        F.round("notified_price", 4).alias("notified_price"),
        "notified_stage",
    )


MARK_SQL = f"""
SELECT hh.listing_key,
  CASE WHEN r.notify_reason IS NOT NULL THEN '2026-06-01 12:00:00' ELSE strftime(hh.notified_at, '%Y-%m-%d %H:%M:%S') END AS notified_at,
  round(CASE WHEN r.notify_reason IS NOT NULL THEN r.price_eur ELSE hh.notified_price END, 4) AS notified_price,
  CASE WHEN r.notify_reason IS NOT NULL THEN r.stage ELSE hh.notified_stage END AS notified_stage
FROM {HIST} hh JOIN ({REASON_SQL}) r USING (listing_key)"""


def upsert_snapshot(spark, d):
    """Every listing arrives twice, the second time dearer; the stored rows are the history."""
    snap = _history(spark, d).select(
        "listing_key", F.col("old_price").alias("price_eur"), "first_seen_at", "last_seen_at", "notified_price"
    )
    rows = rigs.listings(spark, d).filter("seq % 2 = 0").select("listing_key", "price_eur", "seq")
    batch = rows.unionByName(rows.withColumn("price_eur", F.col("price_eur") + 7).withColumn("seq", F.col("seq") + 1_000_000_000))
    out = state.upsert_snapshot(snap, batch, "listing_key", ["price_eur"], "seq", AS_OF)
    fmt = "yyyy-MM-dd"
    return out.select(
        "listing_key", "price_eur", F.date_format("first_seen_at", fmt).alias("first_seen"),
        F.date_format("last_seen_at", fmt).alias("last_seen"), F.round("notified_price", 4).alias("notified_price"),
    )


UPSERT_SQL = f"""
SELECT listing_key, CASE WHEN b.listing_key IS NOT NULL THEN b.price_eur + 7 ELSE s.old_price END AS price_eur,
  strftime(coalesce(s.first_seen_at, {AS_OF_SQL}), '%Y-%m-%d') AS first_seen,
  strftime(CASE WHEN b.listing_key IS NOT NULL THEN {AS_OF_SQL} ELSE s.last_seen_at END, '%Y-%m-%d') AS last_seen,
  round(s.notified_price, 4) AS notified_price
FROM {HIST} s FULL JOIN (SELECT listing_key, price_eur FROM {L} l WHERE seq % 2 = 0) b USING (listing_key)"""


def upsert_bucketed(spark, d):
    """The same merge into a bucketed snapshot, which writes the batch's buckets only."""
    snap = _history(spark, d).select("listing_key", F.col("old_price").alias("price_eur"), "first_seen_at", "last_seen_at", "notified_price")
    rows = rigs.listings(spark, d).filter("seq % 2 = 0").select("listing_key", "price_eur", "seq")
    batch = rows.unionByName(rows.withColumn("price_eur", F.col("price_eur") + 7).withColumn("seq", F.col("seq") + 1_000_000_000))
    schema = "listing_key string, price_eur double, first_seen_at timestamp, last_seen_at timestamp, notified_price double"
    stored = snapshot.BucketedSnapshot(spark, work_folder(spark, "snapshot"), "listing_key", schema, buckets=8)
    stored.merge(snap.withColumn("seq", F.lit(0)), snap.columns[1:], "seq")
    stored.merge(batch, ["price_eur"], "seq", AS_OF)
    fmt = "yyyy-MM-dd"
    return stored.read().select(
        "listing_key", "price_eur", F.date_format("first_seen_at", fmt).alias("first_seen"),
        F.date_format("last_seen_at", fmt).alias("last_seen"), F.round("notified_price", 4).alias("notified_price"),
    )


def upsert_codes(spark, d):
    """Codes of known rows alone; what a batch has besides is not inserted."""
    known = _history(spark, d).select("listing_key", "seq", F.lit(None).cast("bigint").alias("code"), "notified_price").filter("seq % 5 <> 0").drop("seq")
    out = state.upsert_snapshot(known, rigs.listings(spark, d).filter("code is not null and seq % 2 = 0"), "listing_key", ["code"], "seq", insert=False)
    return out.select("listing_key", "code", F.round("notified_price", 4).alias("notified_price"))


CODES_UPSERT_SQL = f"""
SELECT s.listing_key, l.code, round(s.notified_price, 4) AS notified_price
FROM {HIST} s LEFT JOIN (SELECT listing_key, code FROM {L} q WHERE seq % 2 = 0) l USING (listing_key) WHERE s.seq % 5 <> 0"""


def upsert_lineitem(spark, d):
    """In-batch repeats: the line items hold the same (order, line) key many times."""
    items = rigs.table(spark, d, "lineitem")
    key = F.concat_ws(":", "l_orderkey", "l_linenumber").alias("line_key")
    order = F.struct("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").alias("seq")
    batch = items.select(key, order, F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("qty"))
    empty = spark.createDataFrame([], "line_key string, price double, qty double")
    return state.upsert_snapshot(empty, batch, "line_key", ["price", "qty"], "seq")


UPSERT_LINE_SQL = """
SELECT l_orderkey || ':' || l_linenumber AS line_key,
  arg_max(l_extendedprice, (l_partkey, l_suppkey, l_quantity, l_extendedprice)) AS price,
  arg_max(l_quantity, (l_partkey, l_suppkey, l_quantity, l_extendedprice)) AS qty
FROM lineitem GROUP BY 1"""


def state_stats(spark, d):
    return metrics.state_stats(_history(spark, d))


def funnel(spark, d):
    ruled = _ruled(spark, d)
    judged = rules.facts_filter(ruled.filter("rule_id is null"), CFG)
    stages = ruled.filter("rule_id is not null").select(F.lit("structural_rejected").alias("stage")).unionByName(
        judged.select(F.concat(F.lit("facts_"), "verdict").alias("stage"))
    )
    return metrics.funnel(stages)


FUNNEL_SQL = f"""
WITH s AS (SELECT listing_key, rule_id FROM ({_structural_sql(CFG)}) q)
SELECT coalesce(CASE WHEN rule_id IS NOT NULL THEN 'structural_rejected' END, 'facts_' || verdict) AS stage, count(*) AS n
FROM s JOIN ({_facts_sql(False)}) f USING (listing_key) GROUP BY 1"""


def dedup_stats(spark, d):
    """Cluster = grid and price cell; the canonical row carries the reason."""
    df = similarity.grid_signature(_reasoned(spark, d).filter("lat is not null"))
    df = df.withColumn("cluster_id", F.concat_ws("|", "cell", F.col("price_cell").cast("string")))
    best = rank.pick_canonical(df, "cluster_id", vocab.source_rank(F.col("source")), cols=["seq"]).select(
        "seq", F.lit(True).alias("is_canonical")
    )
    marked = df.join(best, "seq", "left").withColumn("is_canonical", F.coalesce("is_canonical", F.lit(False)))
    return metrics.dedup_stats(marked)


DEDUP_SQL = f"""
WITH c AS ({CANONICAL_SQL})
SELECT (SELECT count(code) FROM {L} l WHERE lat IS NOT NULL) AS phashed, count(*) AS clusters,
  count(*) FILTER (r.notify_reason IS NULL) AS suppressed FROM c JOIN ({REASON_SQL}) r USING (listing_key)"""


# --- sources ---------------------------------------------------------------------------------


def union_sources(spark, d):
    df = rigs.listings(spark, d).select("source", "id", "seq", "dishwasher")
    frames = {s: df.filter(F.col("source") == s).drop("source") for s in rigs.SOURCES}
    frames["nekretnine"] = frames["nekretnine"].drop("dishwasher")
    out = feed.union_sources(frames, "seq")
    return out.select("source", "source_no", "id", "seq", F.col("dishwasher").cast("int").alias("dishwasher"))


UNION_SQL = f"""
SELECT source, CAST(list_position(['4zida','cityexpert','nekretnine','halooglasi'], source) - 1 AS INT) AS source_no, id, seq,
  CASE WHEN source <> 'nekretnine' THEN CAST(dishwasher AS INT) END AS dishwasher FROM {L} l"""


def source_health(spark, d):
    df = rigs.listings(spark, d).filter("source <> 'halooglasi'")
    return feed.source_health(df, rigs.SOURCES, {"halooglasi": "blocked"})


HEALTH_SQL = f"""
SELECT s AS source, count(l.seq) AS n, CASE WHEN s = 'halooglasi' THEN 'blocked' END AS error
FROM (SELECT unnest(['4zida','cityexpert','nekretnine','halooglasi']) AS s) x
LEFT JOIN (SELECT source, seq FROM {L} q WHERE source <> 'halooglasi') l ON l.source = s GROUP BY 1, 3"""


def page_early_stop(spark, d):
    """Pages of 30 rows; freshness fades with the page, one source marks a last page, one has a gap at
    page 60, and one is capped by the caller."""
    df = rigs.listings(spark, d)
    page = (F.floor(F.col("seq") / 30.0) + 1).cast("int")
    df = df.withColumn("page", page).filter("not (source = 'halooglasi' and page = 60)")
    fresh = (F.col("seq") % 90) < (91 - F.col("page") - F.col("seq") % 4)
    last = (F.col("source") == "nekretnine") & (F.col("page") == 12)
    capped = F.col("source") == "cityexpert"
    whole = feed.page_early_stop(df.filter(~capped), "source", "page", fresh, last)
    return whole.unionByName(feed.page_early_stop(df.filter(capped), "source", "page", fresh, last, 50)).select("source", "page", "seq")


STOP_SQL = f"""
WITH p AS (SELECT source, seq, CAST(floor(seq / 30) AS INT) + 1 AS page FROM {L} l),
 f AS (SELECT *, (seq % 90) < (91 - page - seq % 4) AS fresh, source = 'nekretnine' AND page = 12 AS is_last
       FROM p WHERE (source <> 'cityexpert' OR page <= 50) AND NOT (source = 'halooglasi' AND page = 60)),
 g AS (SELECT source, page, bool_or(fresh) AS any_fresh, bool_or(is_last) AS any_last FROM f GROUP BY 1, 2),
 w AS (SELECT *, count(*) FILTER (NOT any_fresh) OVER (PARTITION BY source ORDER BY page) AS stale,
         count(*) FILTER (any_last) OVER (PARTITION BY source ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS past,
         row_number() OVER (PARTITION BY source ORDER BY page) AS nth FROM g)
SELECT f.source, f.page, f.seq FROM f JOIN w ON f.source = w.source AND f.page = w.page
WHERE fresh AND stale = 0 AND past = 0 AND nth = w.page"""


# Captured pages in one folder: a page is a few kilobytes, and a folder for each would be a file for some ten rows.
PAGES_A_FOLDER = 1_000


def captured_pages(spark, d):
    """The same pages as files, read by a reader that stops; no source is capped."""
    df = rigs.listings(spark, d)
    page = (F.floor(F.col("seq") / 30.0) + 1).cast("int")
    df = df.withColumn("page", page).filter("not (source = 'halooglasi' and page = 60)")
    fresh = (F.col("seq") % 90) < (91 - F.col("page") - F.col("seq") % 4)
    last = (F.col("source") == "nekretnine") & (F.col("page") == 12)
    folder = f"{work_folder(spark, 'pages')}"
    # Without nulls the writer needs no order of its own, which would undo that of the pages.
    source = F.coalesce("source", F.lit("__HIVE_DEFAULT_PARTITION__")).alias("source")
    first = F.col("page") - F.pmod(F.col("page") - 1, F.lit(PAGES_A_FOLDER))
    span = F.concat_ws("-", first, first + PAGES_A_FOLDER - 1).alias("pages")
    rows = df.select(source, span, "page", "seq", F.when(fresh, "yes").otherwise("no").alias("fresh"), last.alias("last"))
    rows.repartition("source", "pages").sortWithinPartitions("source", "pages", "page").write.partitionBy("source", "pages").json(folder)
    captured.register(spark)
    options = {"path": folder, "fresh_field": "fresh", "fresh_since": "yes", "last_field": "last", "span": str(PAGES_A_FOLDER)}
    read = spark.read.format("captured_pages").options(**options).load()
    return read.select("source", "page", F.get_json_object("payload", "$.seq").cast("bigint").alias("seq"))


CAPTURED_SQL = STOP_SQL.replace("(source <> 'cityexpert' OR page <= 50) AND ", "")


QUERIES = {
    f.__name__: f
    for f in (
        structural_filter, facts_filter, canonicalize_vocab, resolve_tristate, pets_state, haversine, grid_key,
        distance_matrix, distance_matrix_table, resolve_walk, resolve_walk_cache, commute_map, commute_gate, ttl_cache_lookup,
        monthly_call_count, rank_listings, digest_topk, digest_overflow, short_address, relative_time,
        build_urls, rejection_tally, rejection_shown, rejection_remainder, pick_canonical, grid_bucket_join,
        notify_reason, renotify_gate, fresh_only, mark_notified, upsert_snapshot, upsert_lineitem, state_stats,
        funnel, dedup_stats, union_sources, source_health, page_early_stop, captured_pages, upsert_bucketed, upsert_codes,
    )
}

ORACLE = {
    "structural_filter": STRUCTURAL_SQL,
    "facts_filter": FACTS_SQL,
    "canonicalize_vocab": CANON_SQL,
    "resolve_tristate": f"SELECT listing_key, CAST(pets AS INT) AS pets FROM ({FACTS_VALUES}) v",
    "pets_state": PETS_STATE_SQL,
    "haversine": HAVERSINE_SQL,
    "grid_key": GRID_SQL,
    "distance_matrix": MATRIX_SQL,
    "distance_matrix_table": MATRIX_TABLE_SQL,
    "resolve_walk": RESOLVE_SQL,
    "resolve_walk_cache": RESOLVE_CACHE_SQL,
    "commute_map": COMMUTE_MAP_SQL,
    "commute_gate": GATE_SQL,
    "ttl_cache_lookup": TTL_SQL,
    "monthly_call_count": MONTHLY_SQL,
    "rank_listings": f"SELECT listing_key, tier, round(score, 6) AS score FROM ({RANKED_SQL}) r",
    "digest_topk": TOPK_SQL,
    "digest_overflow": OVERFLOW_SQL,
    "short_address": f"SELECT listing_key, {SHORT_SQL} AS short_address FROM {L} l",
    "relative_time": f"SELECT listing_key, {POSTED_SQL} AS posted FROM {L} l",
    "build_urls": URLS_SQL,
    "rejection_tally": f"SELECT rule_id, count(*) AS n FROM ({_structural_sql(CFG)}) s WHERE rule_id IS NOT NULL GROUP BY 1",
    "rejection_shown": f"SELECT seq, rule_id FROM ({_structural_sql(CFG)}) s WHERE rule_id IS NOT NULL ORDER BY seq LIMIT 30",
    "rejection_remainder": f"SELECT greatest(count(*) - 30, 0) AS remainder FROM ({_structural_sql(CFG)}) s WHERE rule_id IS NOT NULL",
    "pick_canonical": CANONICAL_SQL,
    "grid_bucket_join": GRID_JOIN_SQL,
    "notify_reason": f"SELECT listing_key, stage, notify_reason FROM ({REASON_SQL}) r",
    "renotify_gate": f"""SELECT mode, listing_key, notify_reason FROM ({REASON_SQL}) r, (VALUES ('digest'), ('instant'), ('forced')) m(mode)
        WHERE mode <> 'digest' OR notify_reason IS NOT NULL""",
    "fresh_only": f"SELECT listing_key, source FROM {L} l WHERE listing_key NOT IN (SELECT listing_key FROM {HIST} hh WHERE notified_at IS NOT NULL)",
    "mark_notified": MARK_SQL,
    "upsert_snapshot": UPSERT_SQL,
    "upsert_lineitem": UPSERT_LINE_SQL,
    "state_stats": f"SELECT count(*) AS listings_tracked FROM {HIST} hh",
    "funnel": FUNNEL_SQL,
    "dedup_stats": DEDUP_SQL,
    "union_sources": UNION_SQL,
    "source_health": HEALTH_SQL,
    "page_early_stop": STOP_SQL,
    "captured_pages": CAPTURED_SQL,
    "upsert_bucketed": UPSERT_SQL,
    "upsert_codes": CODES_UPSERT_SQL,
}

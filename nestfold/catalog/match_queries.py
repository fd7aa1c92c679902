"""Similarity joins, components, clusters and the composed pipelines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nestfold.catalog import rigs, state_queries
from nestfold.catalog.listing_queries import (
    _POINT, DEST_SQL, HIST, POSTED_SQL, RANKED_SQL, SHORT_SQL, WALKS_SQL, _facts_sql, _history, _plain_ranked, _provider, _structural_sql, _walk_cache,
)
from nestfold.catalog.rigs import AS_OF, AS_OF_SQL, CODES_BASE, DESTINATIONS, LISTINGS, POSTS, pick
from nestfold.config import DigestConfig
from nestfold.functions import codes
from nestfold.operators import cluster, similarity
from nestfold.plans import channel, digest
from nestfold.session import cut, work_folder

L = f"({rigs.text_of(LISTINGS)})"

# --- image codes ---------------------------------------------------------------------------


def _codes(spark, d) -> DataFrame:
    """Fingerprints of the vectors, and a copy of each with up to eight low bits flipped."""
    base = rigs.rig(spark, d, CODES_BASE).select("vec_id", codes.vector_fingerprint(F.col("embedding")).alias("code"))
    flip = F.get(F.array(*[F.lit((1 << n) - 1).cast("bigint") for n in range(9)]), (F.col("vec_id") % 9).cast("int"))
    copy = base.select((F.col("vec_id") + 1_000_000_000).alias("vec_id"), F.col("code").bitwiseXOR(flip).alias("code"))
    return base.unionByName(copy)


CODES_SQL = f"""
WITH base AS ({state_queries.CODE_SQL}),
 codes AS (SELECT vec_id, code FROM base UNION ALL SELECT vec_id + 1000000000, xor(code, (1 << (vec_id % 9)) - 1) FROM base)"""


def hamming_join(spark, d):
    return similarity.hamming_join(_codes(spark, d))


HAMMING_SQL = CODES_SQL + """, d AS (SELECT DISTINCT code FROM codes)
SELECT a.code AS code_a, b.code AS code_b, CAST(bit_count(xor(a.code, b.code)) AS INT) AS dist
FROM d a JOIN d b ON a.code < b.code AND bit_count(xor(a.code, b.code)) <= 6"""


def post_dup_antijoin(spark, d):
    """The flipped copies that no original is near to."""
    rows = _codes(spark, d)
    known = rows.filter("vec_id < 1000000000 and vec_id % 2 = 0")
    return similarity.post_dup_antijoin(rows.filter("vec_id >= 1000000000"), known).select("vec_id")


POST_DUP_SQL = CODES_SQL + """
SELECT vec_id FROM codes a WHERE vec_id >= 1000000000 AND NOT EXISTS (
  SELECT 1 FROM codes b WHERE b.vec_id < 1000000000 AND b.vec_id % 2 = 0 AND bit_count(xor(a.code, b.code)) <= 6)"""


def connected_components(spark, d):
    """Codes linked by nearness, as one component each."""
    edges = similarity.hamming_join(_codes(spark, d)).select(F.col("code_b").alias("later"), F.col("code_a").alias("earlier"))
    return cluster.connected_components(edges).select(F.col("node").alias("code"), "component_id")


COMPONENTS_SQL = CODES_SQL.replace("WITH base", "WITH RECURSIVE base", 1) + """, d AS (SELECT DISTINCT code FROM codes),
 e AS (SELECT a.code AS x, b.code AS y FROM d a JOIN d b ON a.code <> b.code AND bit_count(xor(a.code, b.code)) <= 6),
 walk AS (SELECT x, x AS seen FROM e UNION SELECT w.x, e.y FROM walk w JOIN e ON e.x = w.seen)
SELECT x AS code, min(seen) AS component_id FROM walk GROUP BY 1"""


# --- titles and clusters ---------------------------------------------------------------------

# Every listing's title whole, without its last 4 or 10 characters, or with another one at place 13 or 21, at rising
# prices; copies differ in it. What two variants share are blocks that keep their places, so a ratio is twice
# the shorter length, less the changed places in it, by both lengths.
_CHANGED = [0, 0, 13, 0, 21, 13, 0]
_CUTS = [0, 4, 0, 10, 0, 0, 0]
_NTH = lambda values: f"CAST({pick('seq % 7', [str(v) for v in values])} AS INT)"
TITLE_VARIANTS = f"""
SELECT seq, base, place, CASE WHEN place > 0 THEN substr(base, 1, place - 1) || 'Z' || substr(base, place + 1) ELSE substr(base, 1, length(base) - cut) END AS title, price_eur
FROM (SELECT seq, title AS base, {_NTH(_CHANGED)} AS place, {_NTH(_CUTS)} AS cut, price_eur * (1 + seq % 3 * 0.02) AS price_eur FROM ({LISTINGS}) l) t"""


def fuzzy_title_join(spark, d):
    out = similarity.fuzzy_title_join(rigs.rig(spark, d, TITLE_VARIANTS))
    return out.select(
        "later_title", F.round("later_price", 4).alias("later_price"), "earlier_title", F.round("earlier_price", 4).alias("earlier_price"), F.round("ratio", 6).alias("ratio")
    )


# Titles are random: only variants of one are near.
_MATCHED = "(least(length(a.title), length(b.title)) - CASE WHEN a.place = b.place THEN 0 ELSE CAST(a.place BETWEEN 1 AND length(b.title) AS INT) + CAST(b.place BETWEEN 1 AND length(a.title) AS INT) END)"
FUZZY_SQL = f"""
WITH e AS (SELECT lower(title) AS title, price_eur AS price, min(seq) AS first, max(seq) AS last, any_value(base) AS base, any_value(place) AS place
           FROM ({rigs.text_of(TITLE_VARIANTS)}) t WHERE price_eur > 0 GROUP BY 1, 2)
SELECT a.title AS later_title, round(a.price, 4) AS later_price, b.title AS earlier_title, round(b.price, 4) AS earlier_price,
  round(2.0 * {_MATCHED} / (length(a.title) + length(b.title)), 6) AS ratio
FROM e a JOIN e b ON a.base = b.base AND (a.title, a.price) <> (b.title, b.price) AND a.last > b.first
WHERE abs(a.price - b.price) / greatest(a.price, b.price) <= 0.05
  AND 2.0 * {_MATCHED} / (length(a.title) + length(b.title)) >= 0.8"""


def _flats(spark, d) -> DataFrame:
    return rigs.listings(spark, d).select("seq", "code", "lat", "lng", "m2", "price_eur", "title")


def same_flat_edges(spark, d):
    """Of each listing with an earlier one of the same flat its edge to the nearest, with the layer, and how many of
    all its edges aren't pairs of their layer."""
    flats = _flats(spark, d)
    edges = cut(similarity.same_flat_edges(flats))
    sides = [F.struct(*flats.columns).alias(n) for n in ("a", "b")]
    a, b = F.col("a"), F.col("b")
    coded = F.bit_count(a["code"].bitwiseXOR(b["code"])) <= 6
    cell = lambda r: F.struct(F.round(r["lat"], 4), F.round(r["lng"], 4), F.floor(r["price_eur"] / 50))
    near = (cell(a) == cell(b)) & (F.abs(a["m2"] - b["m2"]) < 1)
    titled = (a["title"] == b["title"]) & (F.abs(a["price_eur"] - b["price_eur"]) / F.greatest(a["price_eur"], b["price_eur"]) <= 0.05)
    right = F.coalesce(F.when(F.col("layer") == 1, coded).when(F.col("layer") == 2, near).when(F.col("layer") == 3, titled), F.lit(False))
    whole = edges.join(flats.select(F.col("seq").alias("later"), sides[0]), "later").join(flats.select(F.col("seq").alias("earlier"), sides[1]), "earlier")
    nearest = F.max(F.struct("earlier", "layer")).alias("e")
    return whole.groupBy("later").agg(nearest, F.count_if(~right).alias("wrong")).select("later", "e.earlier", "e.layer", "wrong")


def cluster_flats(spark, d):
    rows = _flats(spark, d)
    out = cluster.cluster_flats(rows, similarity.same_flat_edges(rows))
    return out.select("seq", "cluster_id")


# Random titles match only when equal.
_PAIRS = f"""
rows AS MATERIALIZED (SELECT seq, code, round(lat, 4) AS la, round(lng, 4) AS lo, m2, price_eur AS p, floor(price_eur / 50) AS pb, title FROM {L} l),
 pairs AS MATERIALIZED (
  SELECT a.seq AS x, b.seq AS y, 1 AS layer FROM rows a JOIN rows b ON a.seq > b.seq AND bit_count(xor(a.code, b.code)) <= 6
  UNION SELECT a.seq, b.seq, 2 FROM rows a JOIN rows b ON a.la = b.la AND a.lo = b.lo AND a.pb = b.pb AND a.seq > b.seq AND abs(a.m2 - b.m2) < 1
  UNION SELECT a.seq, b.seq, 3 FROM rows a JOIN rows b ON a.title = b.title AND a.seq > b.seq AND abs(a.p - b.p) / greatest(a.p, b.p) <= 0.05)"""
# Edges are sparse, but the nearest earlier match of a row is always among them, with the first layer that finds it.
EDGES_SQL = f"""WITH {_PAIRS}
SELECT x AS later, y AS earlier, min(layer) AS layer, CAST(0 AS BIGINT) AS wrong FROM pairs GROUP BY x, y QUALIFY y = max(y) OVER (PARTITION BY x)"""
# A row's cluster is the smallest row reachable through ever earlier matches.
CLUSTER_SQL = f"""
WITH RECURSIVE {_PAIRS}, walk AS (SELECT x, y FROM pairs UNION SELECT w.x, p.y FROM walk w JOIN pairs p ON p.x = w.y)
SELECT r.seq, least(r.seq, coalesce(min(w.y), r.seq)) AS cluster_id FROM rows r LEFT JOIN walk w ON w.x = r.seq GROUP BY r.seq"""


def skipped_dup_antijoin(spark, d):
    """Listings that are no copy of a hidden one. Copies share title and nearly the code."""
    rows = rigs.listings(spark, d)
    hidden = rows.filter("seq % 10 = 9").select("seq", "code", "title", "price_eur")
    return similarity.skipped_dup_antijoin(rows.filter("seq % 10 <> 9"), hidden).select("listing_key")


# Random titles match only their planted copies: same title, price within 5 %; or near codes.
SKIPPED_DUP_SQL = f"""
SELECT listing_key FROM {L} a WHERE seq % 10 <> 9 AND NOT EXISTS (
  SELECT 1 FROM {L} b WHERE b.seq % 10 = 9 AND b.title = a.title AND (abs(a.price_eur - b.price_eur) / greatest(a.price_eur, b.price_eur) <= 0.05
    OR bit_count(xor(a.code, b.code)) <= 6))"""


# --- pipelines -------------------------------------------------------------------------------

CFG = DigestConfig()


def _inputs(spark, d) -> digest.DigestInputs:
    rows = rigs.listings(spark, d).drop("extraction")
    stored = _history(spark, d).select("listing_key", "first_seen_at", "last_seen_at", "notified_at", "notified_price", "notified_stage")
    snapshot = rows.select("listing_key", "code", *digest.LISTING_STATE).join(stored, "listing_key")
    empty = spark.createDataFrame([], "listing_key string, payload string, desc_hash string, extracted_at timestamp")
    return digest.DigestInputs(
        listings=rows,
        snapshot=snapshot,
        skipped=state_queries._skipped(spark, d),
        extraction_cache=empty,
        walk_cache=_walk_cache(spark, d),
        walk_provider=_provider,
        destinations=DESTINATIONS,
    )


def digest_gate(spark, d):
    """Rejections of all three stages of the pipeline, facts taken from the text."""
    gated = digest.gate_candidates(_inputs(spark, d), CFG, AS_OF)
    return gated.rejected.select("stage", "rule_id", "listing_key")


# The two phrases of a listing's description, as facts.
_SAYS = {
    "pets": ["no", "yes", None, None, None, None, None, "yes", None, None],
    "heat": [None, None, None, "centralno", "etazno", None, None, None, None, None],
    "furn": [None, None, None, "furnished", "semi-furnished", None, "unfurnished", None, None, None],
    "lease": [None, None, None, None, None, "18", None, None, None, None],
}
_S1, _S2 = rigs.h("say", 10), rigs.h("say2", 10)
_TWO = lambda n: f"[{rigs.pick('p1', _SAYS[n])}, {rigs.pick('p2', _SAYS[n])}]"
_FIRST = lambda n, order: f"CASE {' '.join(f'''WHEN list_contains({_TWO(n)}, '{v}') THEN '{v}' ''' for v in order)} END"
_TEXT_LISTINGS = f"""
SELECT * REPLACE ({_FIRST('pets', ['no', 'yes'])} AS x_pets, {_FIRST('heat', ['etazno', 'centralno'])} AS x_heat,
    {_FIRST('furn', ['unfurnished', 'semi-furnished', 'furnished'])} AS x_furn, CAST({_FIRST('lease', ['18'])} AS INT) AS x_lease)
FROM (SELECT l.*, {_S1} AS p1, {_S2} AS p2 FROM (SELECT *, CASE WHEN seq % 10 = 0 AND seq > 0 THEN seq - 1 ELSE seq END AS j FROM {L} q) l) t"""


def _over_text(sql: str) -> str:
    """A check written for the listing rig, over the rows with facts from their text."""
    return sql.replace(f"seq % 9 <> 0 AS looked FROM {L} l0", f"true AS looked FROM ({_TEXT_LISTINGS}) l0")


_WALK_CTES = WALKS_SQL.replace("WITH req AS", "req AS").replace(f"FROM {L} l CROSS JOIN", "FROM maybe l CROSS JOIN", 1)
# Visible rows with their first failing rule; facts of those without one; walking times asked for by what the facts leave.
_GATE_CTES = f"""
v AS MATERIALIZED (SELECT listing_key, rule_id FROM ({_structural_sql(CFG.filters)}) s WHERE listing_key NOT IN ({state_queries.SKIPPED_SQL})),
 f AS MATERIALIZED (SELECT q.* FROM ({_over_text(_facts_sql(False))}) q JOIN v USING (listing_key) WHERE v.rule_id IS NULL),
 maybe AS MATERIALIZED (SELECT * FROM f WHERE verdict <> 'rejected'),
 {_WALK_CTES},
 legs AS MATERIALIZED (SELECT req.listing_key, t.dest, gates, walk_min FROM req JOIN known USING (grid_key) JOIN {DEST_SQL} ON req.dest = t.dest),
 far AS MATERIALIZED (SELECT DISTINCT listing_key FROM legs WHERE gates AND (walk_min IS NULL OR walk_min > {CFG.filters.walk_min_max}))"""
GATE_SQL = f"""
WITH {_GATE_CTES}
SELECT 'structural' AS stage, rule_id, listing_key FROM v WHERE rule_id IS NOT NULL
UNION ALL
SELECT 'facts', CASE WHEN hard[1] LIKE 'pets%' THEN 'pets' WHEN hard[1] LIKE 'heating%' THEN 'heating' WHEN hard[1] LIKE 'furnishing%' THEN 'furnishing' ELSE 'lease' END, listing_key
FROM f WHERE verdict = 'rejected'
UNION ALL SELECT 'commute', 'commute', listing_key FROM far"""


def run_digest(spark, d):
    """The whole pipeline; its cards."""
    cards = digest.run_digest(_inputs(spark, d), CFG, AS_OF).cards
    return cards.withColumn("score", F.round("score", 6))


def run_digest_instant(spark, d):
    cards = digest.run_digest(_inputs(spark, d), CFG, AS_OF, mode="instant").cards
    return cards.select("section", "listing_key", "price_eur", "tier", "place", "unconfirmed")


_NUM = lambda x: f"CAST({x!r} AS DOUBLE)"
_CLOSE = " + ".join(
    f"{_NUM(float(x.score_weight))} * coalesce(greatest(CAST(0 AS DOUBLE), 1 - (SELECT max(walk_min) FROM legs WHERE legs.listing_key = r.listing_key AND dest = '{x.name}') / {_NUM(float(CFG.score.walk_cap_min))}), 0)"
    for x in DESTINATIONS
)
_AGE = f"(epoch_us({AS_OF_SQL}) - epoch_us(created_at)) / CAST(3.6e9 AS DOUBLE)"
# Random titles match only when equal, codes only those of copies.
_DIGEST_CTES = f"""
WITH RECURSIVE {_GATE_CTES},
 hidden AS MATERIALIZED (SELECT CASE WHEN seq % 7 <> 0 THEN code END AS code, title, price_eur FROM {L} l WHERE listing_key IN ({state_queries.SKIPPED_SQL})),
 kept AS MATERIALIZED (
  SELECT *, CASE verdict WHEN 'passed' THEN 'match' ELSE 'near_miss' END AS stage FROM maybe c
  WHERE listing_key NOT IN (SELECT listing_key FROM far) AND NOT EXISTS (SELECT 1 FROM hidden h WHERE h.title = c.title
    AND (abs(c.price_eur - h.price_eur) / greatest(c.price_eur, h.price_eur) <= 0.05 OR bit_count(xor(c.code, h.code)) <= 6))),
 {_PAIRS.replace(f"FROM {L} l)", "FROM kept WHERE stage = 'match')")},
 walk AS (SELECT x, y FROM pairs UNION SELECT w.x, p.y FROM walk w JOIN pairs p ON p.x = w.y),
 labels AS (SELECT r.seq, least(r.seq, coalesce(min(w.y), r.seq)) AS cluster_id FROM rows r LEFT JOIN walk w ON w.x = r.seq GROUP BY r.seq),
 standing AS (SELECT arg_min(k.seq, struct_pack(a := list_position(['4zida','cityexpert','nekretnine','halooglasi'], source), b := -epoch_us(created_at), c := k.seq)) AS seq
              FROM kept k JOIN labels USING (seq) GROUP BY cluster_id),
 reasoned AS MATERIALIZED (
  SELECT k.*, hh.notified_at, CASE WHEN notified_at IS NULL THEN 'new'
    WHEN notified_price IS NOT NULL AND price_eur < notified_price * (1 - 0.05::DOUBLE) THEN 'price_drop'
    WHEN notified_price IS NOT NULL AND price_eur <> notified_price THEN 'price_change'
    WHEN k.stage = 'match' AND notified_stage = 'near_miss' THEN 'upgraded'
    WHEN {AS_OF_SQL} - notified_at > INTERVAL 14 DAY THEN 'relisted' END AS notify_reason
  FROM kept k LEFT JOIN (SELECT listing_key, notified_at, notified_price, notified_stage FROM {HIST} q) hh USING (listing_key)
  WHERE k.stage = 'near_miss' OR k.seq IN (SELECT seq FROM standing)),
 ranked AS MATERIALIZED (
  SELECT *, CASE WHEN coalesce(pets_allowed, false) OR coalesce(x_pets = 'yes', false) THEN 1 ELSE 0 END AS tier,
    {_CLOSE} + {_NUM(float(CFG.score.surface_weight))} * least(CAST(1 AS DOUBLE), m2 / {_NUM(float(CFG.score.surface_cap_m2))})
    + {_NUM(float(CFG.score.freshness_weight))} * greatest(CAST(0 AS DOUBLE), 1 - {_AGE} / {_NUM(CFG.filters.freshness_days * 24.0)})
    + {_NUM(float(CFG.score.elevator_weight))} * CASE WHEN elevator THEN CAST(1 AS DOUBLE) ELSE 0 END AS score
  FROM reasoned r)"""
_SAID = lambda n: f"(p1 = {n} OR p2 = {n})"
DIGEST_SQL = _DIGEST_CTES + f""",
 numbered AS (SELECT *, CAST(row_number() OVER (PARTITION BY stage ORDER BY tier DESC, score DESC, seq) AS INT) AS rank FROM ranked WHERE notify_reason IS NOT NULL)
SELECT stage AS section, rank, listing_key,
  CASE notify_reason WHEN 'price_drop' THEN 'price drop' WHEN 'price_change' THEN 'price changed' WHEN 'upgraded' THEN 'upgraded from near-miss' WHEN 'relisted' THEN 're-surfaced' END AS badge,
  price_eur, rooms, m2, tier, round(score, 6) AS score, CASE WHEN pets_allowed THEN 'yes' ELSE coalesce(x_pets, 'unknown') END AS pets, {SHORT_SQL} AS place, {POSTED_SQL} AS posted,
  CASE WHEN p1 = 5 OR (p1 <> 8 AND p2 = 5) THEN 250 END AS bills, coalesce(x_heat, heating_type) AS heating, coalesce(dishwasher, false) OR {_SAID(2)} AS dishwasher,
  elevator, floor, total_floors, is_agency, CASE WHEN {_SAID(6)} THEN 'students only' ELSE '' END AS red_flags, CAST(NULL AS VARCHAR) AS summary,
  array_to_string(soft, '; ') AS unconfirmed, 'https://www.google.com/maps?q=' || {_POINT} AS map_url
FROM numbered WHERE rank <= CASE stage WHEN 'match' THEN {CFG.top_matches} ELSE {CFG.top_near} END"""
INSTANT_DIGEST_SQL = _DIGEST_CTES + f"""
SELECT stage AS section, listing_key, price_eur, tier, {SHORT_SQL} AS place, array_to_string(soft, '; ') AS unconfirmed FROM ranked WHERE notified_at IS NULL"""


def stored_digest(spark, d):
    """The snapshot that a run leaves for the next one: stamps of what was sent over those of the history."""
    folder = work_folder(spark, "state")
    digest.store_run(digest.run_digest(_inputs(spark, d), CFG, AS_OF), folder, "2026-06-01")
    left = digest.stored_state(spark, folder)["snapshot"]
    return left.select(
        "listing_key", F.date_format("notified_at", "yyyy-MM-dd HH:mm:ss").alias("notified_at"), F.round("notified_price", 4).alias("notified_price"),
        "notified_stage", F.date_format("last_seen_at", "yyyy-MM-dd").alias("last_seen"),
    )


STORED_SQL = _DIGEST_CTES + f""",
 sent AS (SELECT listing_key, price_eur, stage FROM ranked WHERE notify_reason IS NOT NULL)
SELECT l.listing_key, CASE WHEN s.listing_key IS NOT NULL THEN '2026-06-01 12:00:00' ELSE strftime(hh.notified_at, '%Y-%m-%d %H:%M:%S') END AS notified_at,
  round(CASE WHEN s.listing_key IS NOT NULL THEN s.price_eur ELSE hh.notified_price END, 4) AS notified_price,
  CASE WHEN s.listing_key IS NOT NULL THEN s.stage ELSE hh.notified_stage END AS notified_stage, '2026-06-01' AS last_seen
FROM {L} l LEFT JOIN {HIST} hh USING (listing_key) LEFT JOIN sent s USING (listing_key)"""


def digest_rows(spark, d):
    """Card data of the structural survivors, through the pipeline's own columns."""
    df = _plain_ranked(spark, d).withColumn("stage", F.when(F.col("seq") % 5 > 0, "match").otherwise("near_miss"))
    df = df.withColumn("notify_reason", F.element_at(F.array(*map(F.lit, ["new", *digest.BADGES])), (F.col("seq") % 5 + 1).cast("int"))).withColumn("soft", F.array(F.col("source"), F.lit("x")))
    return digest.digest_rows(df.withColumn("score", F.round("score", 6)), CFG, AS_OF).drop("score", "red_flags", "summary")


DIGEST_ROWS_SQL = f"""
WITH r AS (SELECT *, CASE WHEN seq % 5 > 0 THEN 'match' ELSE 'near_miss' END AS stage, seq % 9 <> 0 AS looked FROM ({RANKED_SQL}) q),
 n AS (SELECT *, CAST(row_number() OVER (PARTITION BY stage ORDER BY tier DESC, round(score, 6) DESC, seq) AS INT) AS rank FROM r)
SELECT stage AS section, rank, listing_key, (['price drop', 'price changed', 'upgraded from near-miss', 're-surfaced'])[seq % 5] AS badge, price_eur, rooms, m2, tier,
  CASE WHEN pets_allowed THEN 'yes' WHEN looked THEN x_pets WHEN pets_allowed = false THEN 'no' ELSE 'unknown' END AS pets, {SHORT_SQL} AS place, {POSTED_SQL} AS posted,
  CASE WHEN looked AND x_bills > 200 THEN x_bills END AS bills, coalesce(CASE WHEN looked THEN nullif(x_heat, '') END, heating_type) AS heating,
  coalesce(dishwasher, false) OR coalesce(looked AND x_dish, false) AS dishwasher, elevator, floor, total_floors, is_agency, source || '; x' AS unconfirmed,
  'https://www.google.com/maps?q=' || {_POINT} AS map_url
FROM n WHERE rank <= CASE stage WHEN 'match' THEN {CFG.top_matches} ELSE {CFG.top_near} END"""


def _channel(spark, d) -> channel.ChannelOutputs:
    posts = rigs.rig(spark, d, POSTS)
    known = _codes(spark, d)
    picture = known.withColumnRenamed("vec_id", "message_id")
    posts = posts.join(picture, "message_id", "left")
    seen = posts.filter("message_id % 11 = 0").select("channel", "message_id")
    walks = posts.select(F.lit("none").alias("grid_key")).distinct().select(
        "grid_key", F.lit(5).alias("walk_min"), F.lit(AS_OF).cast("timestamp").alias("fetched_at")
    )
    minutes = lambda q: q.select("grid_key", F.length("address").alias("walk_min"))
    hidden = known.filter("vec_id >= 1000000000 and vec_id % 4 = 0").select("code")
    return channel.run_channel(posts, seen, hidden, walks, minutes, DESTINATIONS[0], AS_OF, 55.0, "#аренда")


def run_channel(spark, d):
    return _channel(spark, d).outbox


_DUP = "EXISTS (SELECT 1 FROM codes a JOIN codes b ON a.vec_id = doc_id AND b.vec_id >= 1000000000 AND b.vec_id % 4 = 0 AND bit_count(xor(a.code, b.code)) <= 6)"
CHANNEL_SQL = CODES_SQL + f"""
SELECT source AS channel, doc_id AS message_id, CAST({state_queries.SIZE} AS DOUBLE) AS m2,
  CASE doc_id % 7 WHEN 0 THEN 'Krunska 35, centar' END AS address, 'https://t.me/' || source || '/' || doc_id AS permalink,
  CASE doc_id % 7 WHEN 0 THEN 18 END AS walk_min
FROM documents WHERE doc_id % 11 <> 0 AND {state_queries.TAGGED} AND {state_queries.PETS_OK} AND {state_queries.SIZE} > 55 AND NOT {_DUP}"""


def run_channel_counts(spark, d):
    return _channel(spark, d).counts


CHANNEL_COUNTS_SQL = CODES_SQL + f"""
SELECT source AS channel, CASE WHEN NOT ({state_queries.TAGGED}) THEN 'untagged' WHEN NOT ({state_queries.PETS_OK} AND coalesce({state_queries.SIZE}, 0) > 55) THEN 'filtered'
  WHEN {_DUP} THEN 'deduped' ELSE 'pushed' END AS outcome, count(*) AS n
FROM documents WHERE doc_id % 11 <> 0 GROUP BY 1, 2"""

QUERIES = {
    f.__name__: f
    for f in (
        hamming_join, post_dup_antijoin, connected_components, fuzzy_title_join, same_flat_edges, cluster_flats,
        skipped_dup_antijoin, digest_gate, digest_rows, run_digest, run_digest_instant, stored_digest, run_channel, run_channel_counts,
    )
}

ORACLE = {
    "hamming_join": HAMMING_SQL,
    "post_dup_antijoin": POST_DUP_SQL,
    "connected_components": COMPONENTS_SQL,
    "fuzzy_title_join": FUZZY_SQL,
    "same_flat_edges": EDGES_SQL,
    "cluster_flats": CLUSTER_SQL,
    "skipped_dup_antijoin": SKIPPED_DUP_SQL,
    "digest_gate": GATE_SQL,
    "digest_rows": DIGEST_ROWS_SQL,
    "run_digest": DIGEST_SQL,
    "run_digest_instant": INSTANT_DIGEST_SQL,
    "stored_digest": STORED_SQL,
    "run_channel": CHANNEL_SQL,
    "run_channel_counts": CHANNEL_COUNTS_SQL,
}

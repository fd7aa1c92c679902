"""Payloads and pages to rows. Payloads are written by SQL from the given tables, so the
check computes the expected fields straight from the columns and never parses anything."""

from __future__ import annotations

from pyspark.sql import functions as F

from nestfold.catalog import rigs
from nestfold.catalog.rigs import h, pick
from nestfold.functions import parse, text, vocab
from nestfold.sources import feed, html, json_ads

K = "p_partkey"


def _q(expr: str) -> str:
    return f"CAST({expr} AS STRING)"


# --- source A: JSON ----------------------------------------------------------------------------

A_BASE = f"""
SELECT {K} AS k, {h('price', 1500, K)} AS price, {h('m2', 90, K)} AS m2, {h('rooms', 8, K)} AS rooms,
  {h('floor', 12, K)} AS floor, {h('bad', 9, K)} AS bad, {h('pets', 3, K)} AS pets, {h('lift', 4, K)} AS lift,
  {h('img', 3, K)} AS img, {h('hour', 24, K)} AS hour, p_name, p_brand
FROM {{part}}"""
A_AD = f"""'{{{{"id":"a' || {_q('k')} || '"' ||
  CASE WHEN bad = 0 THEN '' WHEN bad = 1 THEN ',"createdAt":"yesterday"'
       ELSE ',"createdAt":"2026-05-20T' || lpad({_q('hour')}, 2, '0') || ':30:00+02:00"' END ||
  ',"urlPath":"/stan/' || {_q('k')} || '","price":' || CASE WHEN bad = 2 THEN '"n/a"' ELSE {_q('price')} END ||
  ',"m2":' || {_q('m2')} || ',"roomCount":' || {_q('rooms * 0.5')} || ',"redactedFloor":' || {_q('floor')} ||
  ',"redactedTotalFloors":"12","lastFloor":' || CASE WHEN floor = 11 THEN 'true' ELSE 'false' END ||
  CASE WHEN lift = 0 THEN '' ELSE ',"elevator":' || {_q('lift - 1')} END ||
  CASE pets WHEN 0 THEN '' WHEN 1 THEN ',"petsAllowed":true' ELSE ',"petsAllowed":false' END ||
  ',"furnished":"semi","heatingType":"district","detailedTitle":"' || CASE WHEN rooms = 0 THEN '' ELSE p_name || ' lux' END ||
  '","title":"' || p_name || '","description100":"opis","address":"' || p_brand ||
  '","placeNames":["Vračar","Beograd"],"extra":{{{{"x":[1]}}}}' ||
  CASE img WHEN 0 THEN '' WHEN 1 THEN ',"image":{{{{"search":{{{{"380x0_fill_0_webp":"w' || {_q('k')} || '"}}}}}}}}'
           ELSE ',"image":{{{{"search":{{{{"380x0_fill_0_webp":"w","380x0_fill_0_jpeg":"j' || {_q('k')} || '"}}}}}}}}' END ||
  CASE WHEN lift = 1 THEN ',"agencyUrlPath":"/ag/1"' ELSE '' END || '}}}}'"""
# Two adverts in each response.
A_PAYLOADS = f"""
SELECT k AS page, '{{{{"total":2,"ads":[' || {A_AD} || ',' || replace({A_AD}, '"id":"a', '"id":"b') || ']}}}}' AS payload
FROM ({A_BASE}) t"""


def normalize_json_a(spark, d):
    out = json_ads.normalize_json_a(rigs.rig(spark, d, A_PAYLOADS))
    return out.select(
        "id", "source", "url", "price_eur", "m2", "rooms", "floor", "total_floors",
        F.col("last_floor").cast("int").alias("last_floor"), F.col("elevator").cast("int").alias("elevator"),
        "furnished", "heating_type", F.col("pets_allowed").cast("int").alias("pets"), "title", "description",
        "address", F.array_join("place_names", "/").alias("places"), "image_url",
        F.col("is_agency").cast("int").alias("is_agency"), F.unix_seconds("created_at").alias("created"),
    )


A_SQL = f"""
SELECT c || k AS id, '4zida' AS source, 'https://www.4zida.rs/stan/' || k AS url, CAST(price AS DOUBLE) AS price_eur,
  CAST(m2 AS DOUBLE) AS m2, CAST(rooms * 0.5 AS DOUBLE) AS rooms, CAST(floor AS INT) AS floor, 12 AS total_floors,
  CAST(floor = 11 AS INT) AS last_floor, CAST(lift > 1 AS INT) AS elevator, 'semi' AS furnished, 'district' AS heating_type,
  CASE pets WHEN 1 THEN 1 WHEN 2 THEN 0 END AS pets, CASE WHEN rooms = 0 THEN p_name ELSE p_name || ' lux' END AS title,
  'opis' AS description, p_brand AS address, 'Vračar/Beograd' AS places,
  CASE img WHEN 1 THEN 'w' || k WHEN 2 THEN 'j' || k END AS image_url, CAST(lift = 1 AS INT) AS is_agency,
  CAST(epoch(TIMESTAMP '2026-05-20 00:30:00') AS BIGINT) + (hour - 2) * 3600 AS created
FROM ({rigs.text_of(A_BASE)}) t, (VALUES ('a'), ('b')) v(c) WHERE bad > 2"""


def quarantine_split(spark, d):
    ads = json_ads.parse_json_a(rigs.rig(spark, d, A_PAYLOADS), "payload")
    good, bad = feed.quarantine_split(ads, ["id", "created_at", "image_url"])
    return good.select("id", F.lit("").alias("missing")).unionByName(bad.select("id", F.array_join("missing", ",").alias("missing")))


QUARANTINE_SQL = f"""
SELECT c || k AS id, concat_ws(',', CASE WHEN bad < 2 THEN 'created_at' END, CASE WHEN img = 0 THEN 'image_url' END) AS missing
FROM ({rigs.text_of(A_BASE)}) t, (VALUES ('a'), ('b')) v(c)"""


def longest_text_upgrade(spark, d):
    """Previews are the first 60 characters; every third detail page is shorter, or gone."""
    docs = rigs.rig(spark, d, rigs.TITLES)
    previews = docs.select("listing_key", F.substring("description", 1, 60).alias("description"))
    details = docs.filter("seq % 5 <> 0").select(
        "listing_key",
        F.when(F.col("seq") % 3 == 0, F.substring("description", 1, 20))
        .otherwise(F.concat(F.lit("  "), "description", F.lit("\n")))
        .alias("detail"),
    )
    out = json_ads.with_detail_text(previews, details, "listing_key")
    return out.select("listing_key", F.col("upgraded").cast("int").alias("upgraded"), F.md5("description").alias("digest"))


LONGEST_SQL = """
WITH t AS (SELECT CAST(doc_id AS STRING) AS listing_key, substr(text, 1, 60) AS p,
  CASE WHEN doc_id % 5 <> 0 THEN regexp_replace(CASE WHEN doc_id % 3 = 0 THEN substr(text, 1, 20) ELSE text END, '^\\s+|\\s+$', '', 'g') END AS q
  FROM documents)
SELECT listing_key, CAST(coalesce(length(q) > length(p), false) AS INT) AS upgraded,
  md5(CASE WHEN length(q) > length(p) THEN q ELSE p END) AS digest FROM t"""


# --- source B: JSON ----------------------------------------------------------------------------

# The last has a number of seventy digits behind its mark.
B_FLOORS = ["5_8", "PR", "VPR", "SU", "10", "6_6", "x_2", "POL", "1_11", "??", "4_" + "0" * 69 + "9"]
B_FLOOR = ["5", "0", "0", "-1", "10", "6", None, "-1", "1", None, "4"]
B_TOTAL = ["8", None, None, None, None, "6", None, None, "11", None, "9"]
B_HEAT = ["[1]", "[4]", "[10]", "[21]", "[26]", "[99]", "[1,4]", "[4,4,99]", "[12345]", '["bogus",4]', "[]", "null"]
B_HEATING = ["centralno", "elektricni", "TA", "podno", "klima", "etazno", "centralno", "etazno", None, "elektricni", None, None]
B_PETS = ["[1,2]", "[1]", "[]", "null", '["bogus"]', '["2"]']
B_PET = ["1", "0", "0", None, None, "1"]

B_BASE = f"""
SELECT s_suppkey AS k, {h('fl', 11, 's_suppkey')} AS fl, {h('ht', 12, 's_suppkey')} AS ht, {h('pt', 6, 's_suppkey')} AS pt,
  {h('lo', 3, 's_suppkey')} AS lo, {h('bad', 8, 's_suppkey')} AS bad, {h('fu', 5, 's_suppkey')} AS fu,
  {h('price', 900, 's_suppkey')} AS price, {h('kind', 7, 's_suppkey')} AS kind, s_name
FROM {{supplier}}"""
B_PAYLOADS = f"""
SELECT k AS page, '{{{{"result":[{{{{"uniqueID":"u' || {_q('k')} || '"' ||
  CASE WHEN bad = 0 THEN '' ELSE ',"propId":' || {_q('k + 40000')} END ||
  CASE WHEN bad = 1 THEN ',"firstPublished":"","availableFrom":null'
       WHEN bad = 2 THEN ',"availableFrom":"2026-05-21T00:00:00Z"' ELSE ',"firstPublished":"2026-05-20T08:00:00.000Z"' END ||
  ',"rentOrSale":"' || CASE WHEN kind = 0 THEN 's' ELSE 'r' END || '","location":' ||
  CASE lo WHEN 0 THEN 'null' WHEN 1 THEN '"44.8, 20.' || {_q('10 + k % 90')} || '"' ELSE '"nowhere"' END ||
  ',"floor":' || CASE WHEN fl = 4 THEN '10' ELSE '"' || {pick('fl', B_FLOORS)} || '"' END ||
  ',"size":' || {_q('30 + k % 70')} || ',"price":' || {_q('price')} || ',"structure":"' || {_q('kind')} || ',5","furnished":' || {_q('fu')} ||
  ',"furnishingArray":' || CASE WHEN fu = 1 THEN '["furDishWasher","furBed"]' ELSE 'null' END ||
  ',"heatingArray":' || {pick('ht', B_HEAT)} || ',"petsArray":' || {pick('pt', B_PETS)} ||
  ',"isNoElevatorButLow":' || CASE WHEN kind = 1 THEN 'true' ELSE 'false' END || ',"isNotLastFloor":false' ||
  ',"street":"' || s_name || '","municipality":"Vračar","polygons":["Centar","Slavija"],"coverPhoto":' ||
  CASE WHEN kind = 2 THEN 'null' ELSE '"ph.avif"' END || '}}}}],"info":{{{{"isLastPage":false}}}}}}}}' AS payload
FROM ({B_BASE}) t"""


def normalize_json_b(spark, d):
    out = json_ads.normalize_json_b(rigs.rig(spark, d, B_PAYLOADS))
    ints = ["last_floor", "elevator", "pets_allowed", "is_agency", "dishwasher"]
    return out.select(
        "id", "source", "url", "price_eur", "m2", "rooms", "floor", "total_floors", "furnished", "heating_type",
        *[F.col(c).cast("int").alias(c) for c in ints], "title", "description", "address",
        F.array_join("place_names", "/").alias("places"), "image_url", "lat", "lng", F.unix_seconds("created_at").alias("created"),
    )


B_SQL = f"""
SELECT 'u' || k AS id, 'cityexpert' AS source,
  CASE WHEN kind = 0 THEN 'https://cityexpert.rs/prodaja-nekretnina/beograd/' ELSE 'https://cityexpert.rs/izdavanje-nekretnina/beograd/' END || (k + 40000) || '/stan' AS url,
  CAST(price AS DOUBLE) AS price_eur, CAST(30 + k % 70 AS DOUBLE) AS m2, CAST(kind + 0.5 AS DOUBLE) AS rooms,
  CAST({pick('fl', B_FLOOR)} AS INT) AS floor, CAST({pick('fl', B_TOTAL)} AS INT) AS total_floors,
  {pick('fu', [None, 'yes', 'semi', 'no', None])} AS furnished, {pick('ht', B_HEATING)} AS heating_type,
  CAST(fl = 5 AS INT) AS last_floor, CAST(kind <> 1 AS INT) AS elevator, CAST({pick('pt', B_PET)} AS INT) AS pets_allowed,
  1 AS is_agency, CAST(fu = 1 AS INT) AS dishwasher, kind || ',5 apartment, ' || s_name AS title,
  'Vračar · Centar, Slavija' AS description, s_name AS address, 'Centar/Slavija' AS places,
  CASE WHEN kind <> 2 THEN 'https://img.cityexpert.rs/properties/720x/' || ((k + 40000) - (k + 40000) % 1000) || '/' || (k + 40000) || '/slike/ph.avif' END AS image_url,
  CASE WHEN lo = 1 THEN 44.8::DOUBLE END AS lat, CASE WHEN lo = 1 THEN CAST('20.' || (10 + k % 90) AS DOUBLE) END AS lng,
  CAST(epoch(CASE WHEN bad = 2 THEN TIMESTAMP '2026-05-21 00:00:00' ELSE TIMESTAMP '2026-05-20 08:00:00' END) AS BIGINT) AS created
FROM ({rigs.text_of(B_BASE)}) t WHERE bad > 1"""


def priority_pick(spark, d):
    """Heating codes of a part: three numbers from its key, one of them not a code."""
    codes = F.array(*[F.get(F.array(*[F.lit(str(c)) for c in (1, 4, 10, 21, 26, 99, 7)]), (F.col(K) * m % 7).cast("int")) for m in (3, 5)], F.lit("x"))
    return rigs.table(spark, d, "part").select(
        K, vocab.priority_pick(codes, vocab.HEATING_CODES, vocab.HEATING_PRIORITY).alias("heating")
    )


_RANKED = pick("{}", ["0", "5", "3", "2", "4", "1", "9"])
PRIORITY_SQL = f"""
SELECT {K}, (['centralno','etazno','podno','TA','klima','elektricni'])[
  least(CAST({_RANKED.format(f'({K} * 3 % 7)')} AS INT), CAST({_RANKED.format(f'({K} * 5 % 7)')} AS INT)) + 1] AS heating FROM part"""


def code_flags(spark, d):
    part = rigs.table(spark, d, "part")
    codes = F.array((F.col(K) % 4).cast("string"), F.when(F.col(K) % 6 == 0, "cat").otherwise("3"))
    codes = F.when(F.col(K) % 5 > 0, codes)
    return part.select(
        K,
        vocab.code_present(codes, 2).cast("int").alias("pets"),
        vocab.code_label(F.col(K) % 5, vocab.FURNISHED_CODES).alias("furnished"),
    )


FLAGS_SQL = f"""
SELECT {K}, CASE WHEN {K} % 5 > 0 AND {K} % 6 > 0 THEN CAST({K} % 4 = 2 AS INT) END AS pets,
  CASE {K} % 5 WHEN 1 THEN 'yes' WHEN 2 THEN 'semi' WHEN 3 THEN 'no' END AS furnished FROM part"""


# --- HTML --------------------------------------------------------------------------------------


def extract_blocks(spark, d):
    """Navigation entries of the given pages, one block per list item."""
    pages = rigs.table(spark, d, "pages")
    out = html.extract_blocks(pages, "html", "<li>", {"link": 'href="([^"]+)"', "label": ">([^<]+)</a>"}, ["page_id"])
    return out.select("page_id", "block_no", "link", "label")


BLOCKS_SQL = """
SELECT page_id, CAST(i - 1 AS INT) AS block_no, nullif(regexp_extract(b, 'href="([^"]+)"', 1), '') AS link,
  nullif(regexp_extract(b, '>([^<]+)</a>', 1), '') AS label
FROM (SELECT page_id, unnest(string_split(html, '<li>')[2:]) AS b, generate_subscripts(string_split(html, '<li>')[2:], 1) AS i FROM pages) t"""

D_FLOORS = ["10 / -", "3/5", "PR / 4", "SU / 4", "", "VPR/3"]
D_FLOOR = ["10", "3", "0", "-1", None, "0"]
D_TOTAL = [None, "5", "4", "4", None, "3"]
D_TITLES = ["Dvosoban stan", "Trosoban lux", "Garsonjera", "Kuća", "Četvorosoban &amp; terasa", "jednoiposoban"]
D_ROOMS = ["2.0", "3.0", "0.5", "0.0", "4.0", "1.5"]

CARD_BASE = f"""
SELECT {K} AS k, {h('t', 6, K)} AS t, {h('price', 1500, K)} AS price, {h('cur', 5, K)} AS cur, {h('bad', 7, K)} AS bad,
  {h('fl', 6, K)} AS fl, {h('lift', 2, K)} AS lift, {h('heat', 3, K)} AS heat, 10 + {h('day', 18, K)} AS day, p_name, p_brand,
  {h('gone', 10, K)} AS gone FROM {{part}}"""
# Each list page holds a card and an insert without link.
CARD_PAGES = f"""
SELECT k, '<div class="x"><div class="offer-body big"><h2 class="offer-title"><a' ||
  CASE WHEN bad = 0 THEN '' ELSE ' href="/stan/' || {_q('k')} || '/"' END ||
  ' onclick="push({{{{&quot;price&quot;:&quot;' || {_q('price')} || '&quot;,&quot;currency&quot;:&quot;' ||
  CASE WHEN cur = 0 THEN 'RSD' ELSE 'EUR' END || '&quot;,&quot;item_category4&quot;:&quot;' || {_q('30 + k % 50')} ||
  ',5&quot;,&quot;item_category2&quot;:&quot;Stan u zgradi&quot;}}}})"> ' || {pick('t', D_TITLES)} || CASE WHEN k % 5 = 0 THEN ' <b>' || p_name || '</b>' ELSE ' ' || p_name END ||
  ' </a></h2><p class="offer-location"> Vračar, Beograd, , Srbija, Evropa </p><div class="offer-meta-info">' ||
  CASE WHEN bad = 1 THEN 'juče' ELSE ' objavljen ' || {_q('day')} || '.05.2026 ' END ||
  '</div></div><div class="offer-body"><h2>oglas</h2></div></div>' AS html FROM ({CARD_BASE}) t"""
# Descriptions: plain, with nested elements and a second one that is never closed, with a comment and a ">" in an attribute.
D_TEXTS = [
    "<div class=\"description\"><p>Opis</p> ' || repeat('dugo ', 1200) || p_name || '</div>",
    '<div class="big description"><p>Lep stan.</p><div>Lista<ul><li>a<li>b</ul></div>Bez &quot;ljubimaca&quot;, <br>minimum 18 meseci.</div><p class=description>Jos <b>' "' || p_name || '",
    "<section class=\"x description\"><SECTION title=\"a>b\">Prvi</SECTION><!-- </section> --><hr/>Drugi<br>' || p_name || '</section>",
]
D_READ = ["'Opis  ' || repeat('dugo ', 1200) || p_name", "'Lep stan. Lista a b Bez \"ljubimaca\",  minimum 18 meseci. Jos  ' || p_name", "'Prvi Drugi ' || p_name"]


def _by_k(values: list[str]) -> str:
    return f"CASE k % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


DETAIL_PAGES = f"""
SELECT 'https://www.nekretnine.rs/stan/' || {_q('k')} || '/' AS url,
  '<head><meta property="og:image" content="https://i.example/' || {_q('k')} || '.jpg?a=1&amp;b=2"></head><span>Sprat:</span><br/>' ||
  {pick('fl', D_FLOORS)} || '</span><span>Grejanje:</span><br>' || {pick('heat', ['Centralno', '<b>EG</b>', ''])} ||
  '</span><span>Adresa:</span><br />staro</span><span>Adresa:</span><br />Ulica <i>' || p_brand || '</i></span><h3>Dodatna opremljenost</h3><p>' || repeat('razno ', 1100) || '</p><li> ' ||
  CASE WHEN lift = 0 THEN 'Lift' ELSE 'Liftovi' END || ' </li>' || {_by_k(["'" + t + "'" for t in D_TEXTS])} || '<h3>Okolina</h3><li>Lift</li>' AS html
FROM ({CARD_BASE}) t WHERE gone > 0"""


def extract_kv_pairs(spark, d):
    out = html.extract_kv_pairs(rigs.rig(spark, d, DETAIL_PAGES), "html", html.DETAIL_B_PAIR, "pairs", ["url"])
    get = lambda n: F.try_element_at("pairs", F.lit(n))
    return out.select("url", get("Sprat").alias("floor"), get("Grejanje").alias("heating"), get("Adresa").alias("address"), F.size("pairs").alias("n"))


KV_SQL = f"""
SELECT 'https://www.nekretnine.rs/stan/' || k || '/' AS url, {pick('fl', D_FLOORS)} AS floor, {pick('heat', ['Centralno', 'EG', ''])} AS heating,
  'Ulica ' || p_brand AS address, 3 AS n FROM ({rigs.text_of(CARD_BASE)}) t WHERE gone > 0"""


def extract_cards(spark, d):
    out = html.cards_b(rigs.rig(spark, d, CARD_PAGES))
    return out.select("id", "url", "title", "price_eur", "m2", "rooms", "location", F.date_format("posted_at", "yyyy-MM-dd").alias("posted"))


CARDS_SQL = f"""
SELECT CAST(k AS STRING) AS id, 'https://www.nekretnine.rs/stan/' || k || '/' AS url, replace({pick('t', D_TITLES)}, '&amp;', '&') || CASE WHEN k % 5 = 0 THEN '  ' ELSE ' ' END || p_name AS title,
  CASE WHEN cur = 0 THEN 0.0 ELSE price END::DOUBLE AS price_eur, 30.5::DOUBLE + k % 50 AS m2, CAST({pick('t', D_ROOMS)} AS DOUBLE) AS rooms,
  'Vračar, Beograd, , Srbija, Evropa' AS location, '2026-05-' || day AS posted
FROM ({rigs.text_of(CARD_BASE)}) t WHERE bad > 1"""


def card_detail_join(spark, d):
    cards = html.cards_b(rigs.rig(spark, d, CARD_PAGES))
    out = html.card_detail_join(cards, html.details_b(rigs.rig(spark, d, DETAIL_PAGES)))
    return out.select(
        "id", "source", "url", "price_eur", "floor", "total_floors", F.col("elevator").cast("int").alias("elevator"),
        F.col("last_floor").cast("int").alias("last_floor"), "heating_type", "description", "address",
        F.array_join("place_names", "/").alias("places"), "image_url",
    )


CARD_JOIN_SQL = f"""
SELECT CAST(k AS STRING) AS id, 'nekretnine' AS source, 'https://www.nekretnine.rs/stan/' || k || '/' AS url,
  CASE WHEN cur = 0 THEN 0.0 ELSE price END::DOUBLE AS price_eur, CAST({pick('fl', D_FLOOR)} AS INT) AS floor,
  CAST({pick('fl', D_TOTAL)} AS INT) AS total_floors, CAST(lift = 0 AS INT) AS elevator, 0 AS last_floor,
  {pick('heat', ['Centralno', 'EG', None])} AS heating_type, {_by_k(D_READ)} AS description, 'Ulica ' || p_brand AS address,
  'Vračar/Beograd/Srbija' AS places, 'https://i.example/' || k || '.jpg?a=1&b=2' AS image_url
FROM ({rigs.text_of(CARD_BASE)}) t WHERE bad > 1 AND gone > 0"""

C_FLOORS = ["VI/7", "XII/15", "PR/4", "SUT/4", "", "3/3", "XX", "IV/IV"]
C_FLOOR = ["6", "12", "0", "-1", None, "3", "20", "4"]
C_TOTAL = ["7", "15", "4", "4", None, "3", None, "4"]
C_BASE = f"""
SELECT c_custkey AS k, {h('fl', 8, 'c_custkey')} AS fl, {h('bad', 9, 'c_custkey')} AS bad, {h('price', 4, 'c_custkey')} AS price,
  {h('own', 3, 'c_custkey')} AS own, 1 + {h('day', 28, 'c_custkey')} AS day, c_name FROM {{customer}}"""
C_PAGES = f"""
SELECT '<div class="product-item promo">reklama</div><div class="product-item"' || CASE WHEN bad = 0 THEN '' ELSE ' data-id="h' || {_q('k')} || '"' END ||
  '><a class="a-images" href="/stan/' || {_q('k')} || '?kid=1&amp;x=2"><img src="https://h.example/' || {_q('k')} || '.jpg"></a>' ||
  '<div class="central-feature"><span data-value="' || {pick('price', ['900', '1.000', '2.500', ''])} || '"><i>x</i></span></div>' ||
  '<h3 class="product-title"><a href="#"> ' || c_name || ' &euro; </a></h3><ul class="subtitle-places"><li> Beograd </li><li>Vračar&nbsp;</li><li> </li></ul>' ||
  '<ul class="product-features"><li><div class="value-wrapper">' || {_q('30 + k % 60')} || '&nbsp;m2<span class="legend">Kvadratura</span></div></li>' ||
  '<li><div class="value-wrapper">' || {_q('1 + k % 4')} || ',5<span class="legend">Broj soba</span></div></li>' ||
  '<li><div class="value-wrapper">' || {pick('fl', C_FLOORS)} || '<span class="legend">Spratnost</span></div></li></ul>' ||
  '<span class="publish-date">' || CASE WHEN bad = 1 THEN 'danas' ELSE {_q('day')} || '.5.2026.' END || '</span>' ||
  CASE own WHEN 0 THEN '<span data-field-name="oglasivac_nekretnine_s" data-field-value="agencija"></span>' ELSE '' END ||
  '<p class="text-description-list"> Opis stana </p></div>' AS html FROM ({C_BASE}) t"""


def extract_listings_c(spark, d):
    out = html.listings_c(rigs.rig(spark, d, C_PAGES))
    return out.select(
        "id", "url", "price_eur", "m2", "rooms", "floor", "total_floors", F.col("last_floor").cast("int").alias("last_floor"),
        "title", "description", "address", F.array_join("place_names", "/").alias("places"), "image_url",
        F.col("is_agency").cast("int").alias("is_agency"), F.date_format("created_at", "yyyy-MM-dd").alias("posted"),
    )


C_SQL = f"""
SELECT 'h' || k AS id, 'https://www.halooglasi.com/stan/' || k AS url, CAST({pick('price', ['900', '1000', '2500', '0'])} AS DOUBLE) AS price_eur,
  CAST(30 + k % 60 AS DOUBLE) AS m2, 1.5::DOUBLE + k % 4 AS rooms, CAST({pick('fl', C_FLOOR)} AS INT) AS floor, CAST({pick('fl', C_TOTAL)} AS INT) AS total_floors,
  CAST(fl IN (5, 7) AS INT) AS last_floor, c_name || ' €' AS title, 'Opis stana' AS description, 'Vračar' AS address, 'Beograd/Vračar' AS places,
  'https://h.example/' || k || '.jpg' AS image_url, CAST(own = 0 AS INT) AS is_agency, '2026-05-' || lpad(CAST(day AS STRING), 2, '0') AS posted
FROM ({rigs.text_of(C_BASE)}) t WHERE bad > 1"""

# Channel pages: the document's post, a card of another channel, and on some a service message.
POST_PAGES = f"""
SELECT source AS channel, '<div class="tgme_widget_message js" data-post="' || source || '/' || {_q('doc_id')} || '">' ||
  CASE doc_id % 3 WHEN 0 THEN '<a style="background-image:url(''https://cdn.example/' || {_q('doc_id')} || '.jpg'')"></a><a style="background-image:url(''data:x'')"></a>' ELSE '' END ||
  CASE WHEN doc_id % 5 = 0 THEN '' ELSE '<div class="tgme_widget_message_text js" dir="auto">Vra&#269;ar 65m&#xB2;<br/>' ||
    replace(replace(text, '&', '&amp;'), '<', '&lt;') || '</div>' END ||
  '<time datetime="2026-05-17T09:' || lpad({_q('doc_id % 60')}, 2, '0') || ':00+02:00">9:30</time></div>' ||
  '<div class="tgme_widget_message" data-post="other/9"><div class="tgme_widget_message_text">ne</div></div>' AS html
FROM {{documents}}"""


def extract_posts(spark, d):
    out = html.extract_posts(rigs.rig(spark, d, POST_PAGES))
    return out.select("channel", "message_id", F.md5("text").alias("digest"), F.array_join("photo_urls", ",").alias("photos"), F.unix_seconds("posted_at").alias("posted"))


POSTS_SQL = """
SELECT source AS channel, doc_id AS message_id, md5(CASE WHEN doc_id % 5 = 0 THEN '' ELSE regexp_replace('Vračar 65m²' || chr(10) || text, '\\s+$', '') END) AS digest,
  CASE WHEN doc_id % 3 = 0 THEN 'https://cdn.example/' || doc_id || '.jpg' ELSE '' END AS photos,
  CAST(epoch(TIMESTAMP '2026-05-17 07:00:00') AS BIGINT) + doc_id % 60 * 60 AS posted
FROM documents WHERE doc_id % 5 <> 0 OR doc_id % 3 = 0"""


# --- field parsers -------------------------------------------------------------------------------


def parse_floor(spark, d):
    part = rigs.rig(spark, d, f"SELECT k, {pick('k % 6', D_FLOORS)} AS listed, {pick('k % 8', C_FLOORS)} AS roman, {pick('k % 10', B_FLOORS)} AS coded FROM ({CARD_BASE}) t")
    spots = {n: parse.parse_floor(F.col(n), n) for n in ("listed", "roman", "coded")}
    return part.select("k", *[s[f].alias(f"{n}_{f}") for n, s in spots.items() for f in ("floor", "total")])


FLOOR_SQL = f"""
SELECT {K} AS k, CAST({pick(f'{K} % 6', D_FLOOR)} AS INT) AS listed_floor, CAST({pick(f'{K} % 6', D_TOTAL)} AS INT) AS listed_total,
  CAST({pick(f'{K} % 8', C_FLOOR)} AS INT) AS roman_floor, CAST({pick(f'{K} % 8', C_TOTAL)} AS INT) AS roman_total,
  CAST({pick(f'{K} % 10', B_FLOOR)} AS INT) AS coded_floor, CAST({pick(f'{K} % 10', B_TOTAL)} AS INT) AS coded_total FROM part"""


def rooms_from_text(spark, d):
    words = [*parse.ROOM_WORDS, "kuća", "DVOSOBAN i trosoban"]
    df = rigs.rig(spark, d, f"SELECT k, p_name || ' ' || {pick('k % 12', words)} AS t FROM ({CARD_BASE}) b")
    return df.select("k", parse.rooms_from_text(F.col("t")).alias("rooms"))


ROOMS_SQL = f"SELECT {K} AS k, CAST({pick(f'{K} % 12', [*map(str, parse.ROOM_WORDS.values()), None, '2.0'])} AS DOUBLE) AS rooms FROM part"


def parse_price(spark, d):
    df = rigs.rig(spark, d, f"SELECT k, CASE k % 5 WHEN 0 THEN 'po dogovoru' WHEN 1 THEN '' WHEN 2 THEN NULL WHEN 3 THEN ' 1.' || lpad({_q('price % 1000')}, 3, '0') || ' ' ELSE {_q('price')} END AS t FROM ({CARD_BASE}) b")
    return df.select("k", parse.parse_price(F.col("t")).alias("price"))


PRICE_SQL = f"SELECT k, CAST(CASE k % 5 WHEN 3 THEN 1000 + price % 1000 WHEN 4 THEN price ELSE 0 END AS DOUBLE) AS price FROM ({rigs.text_of(CARD_BASE)}) b"


def parse_numbers(spark, d):
    df = rigs.rig(spark, d, f"SELECT k, CASE WHEN k % 7 = 0 THEN 'nema' ELSE 'oko ' || {_q('price')} || ',75 m2' END AS t FROM ({CARD_BASE}) b")
    return df.select("k", parse.first_int(F.col("t")).alias("whole"), parse.first_float(F.col("t")).alias("decimal"))


NUMBERS_SQL = f"SELECT k, CASE WHEN k % 7 > 0 THEN CAST(price AS INT) END AS whole, CASE WHEN k % 7 > 0 THEN price + 0.75::DOUBLE END AS decimal FROM ({rigs.text_of(CARD_BASE)}) b"


def parse_dates(spark, d):
    df = rigs.rig(spark, d, f"SELECT k, CASE k % 6 WHEN 0 THEN 'danas' WHEN 1 THEN '31.2.2026.' ELSE ' ' || {_q('day')} || '.5.2026. ' END AS a, 'objavljen ' || CASE WHEN k % 6 = 2 THEN '1.1.26' ELSE {_q('day')} || '.05.2026' END AS b, '2026-05-' || {_q('day')} || CASE k % 3 WHEN 0 THEN 'T10:00:00Z' WHEN 1 THEN 'T10:00:00+02:00' ELSE 'x' END AS c FROM ({CARD_BASE}) b")
    day = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm")
    return df.select(
        "k",
        day(parse.parse_dotted_date(F.col("a"))).alias("anchored"),
        day(parse.parse_dotted_date(F.col("b"), anchored=False)).alias("found"),
        day(parse.parse_iso_time(F.col("c"))).alias("iso"),
    )


DATES_SQL = f"""
SELECT k, CASE WHEN k % 6 > 1 THEN '2026-05-' || day || ' 00:00' END AS anchored, CASE WHEN k % 6 <> 2 THEN '2026-05-' || day || ' 00:00' END AS found,
  CASE k % 3 WHEN 0 THEN '2026-05-' || day || ' 10:00' WHEN 1 THEN '2026-05-' || day || ' 08:00' END AS iso FROM ({rigs.text_of(CARD_BASE)}) b"""


def duration_minutes(spark, d):
    df = rigs.rig(spark, d, f"SELECT k, CASE WHEN k % 8 = 0 THEN 'soon' ELSE {_q('price * 10')} || 's' END AS t FROM ({CARD_BASE}) b")
    return df.select("k", parse.duration_minutes(F.col("t")).alias("minutes"))


DURATION_SQL = f"SELECT k, CASE WHEN k % 8 > 0 THEN CAST(round_even(price * 10 / 60, 0) AS INT) END AS minutes FROM ({rigs.text_of(CARD_BASE)}) b"


def normalize_title(spark, d):
    return rigs.table(spark, d, "documents").select("doc_id", F.md5(text.normalize_title(F.col("text"))).alias("digest"))


TITLE_SQL = r"""
SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g'))) AS digest FROM documents"""


def content_hash(spark, d):
    padded = F.concat(F.lit("\n\t "), "text", F.lit(" \r\n"))
    rows = rigs.table(spark, d, "documents").select(
        "doc_id", text.content_hash(F.when(F.col("doc_id") % 10 > 0, padded)).alias("hash")
    )
    return rows


HASH_SQL = r"""
SELECT doc_id, sha1(CASE WHEN doc_id % 10 > 0 THEN regexp_replace(text, '^\s+|\s+$', '', 'g') ELSE '' END) AS hash FROM documents"""


def strip_markup(spark, d):
    return rigs.table(spark, d, "pages").select(
        "page_id",
        F.md5(text.strip_markup(F.col("html"))).alias("lines"),
        F.md5(text.clean_inline(F.col("html"))).alias("inline"),
    )


STRIP_SQL = r"""
SELECT page_id,
  md5(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '<br\s*/?>', chr(10), 'gi'), '<[^>]+>', '', 'g'),
    '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', chr(160)), '&#39;', chr(39)), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '^[\s\x{a0}]+|[\s\x{a0}]+$', '', 'g')) AS lines,
  md5(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))) AS inline FROM pages"""


QUERIES = {
    f.__name__: f
    for f in (
        normalize_json_a, normalize_json_b, quarantine_split, longest_text_upgrade, priority_pick, code_flags,
        extract_blocks, extract_kv_pairs, extract_cards, card_detail_join, extract_listings_c, extract_posts,
        parse_floor, rooms_from_text, parse_price, parse_numbers, parse_dates, duration_minutes,
        normalize_title, content_hash, strip_markup,
    )
}

ORACLE = {
    "normalize_json_a": A_SQL,
    "normalize_json_b": B_SQL,
    "quarantine_split": QUARANTINE_SQL,
    "longest_text_upgrade": LONGEST_SQL,
    "priority_pick": PRIORITY_SQL,
    "code_flags": FLAGS_SQL,
    "extract_blocks": BLOCKS_SQL,
    "extract_kv_pairs": KV_SQL,
    "extract_cards": CARDS_SQL,
    "card_detail_join": CARD_JOIN_SQL,
    "extract_listings_c": C_SQL,
    "extract_posts": POSTS_SQL,
    "parse_floor": FLOOR_SQL,
    "rooms_from_text": ROOMS_SQL,
    "parse_price": PRICE_SQL,
    "parse_numbers": NUMBERS_SQL,
    "parse_dates": DATES_SQL,
    "duration_minutes": DURATION_SQL,
    "normalize_title": TITLE_SQL,
    "content_hash": HASH_SQL,
    "strip_markup": STRIP_SQL,
}

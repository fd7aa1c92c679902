"""Clicks, posts, caches, enrichment and streams."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nestfold.catalog import rigs
from nestfold.catalog.listing_queries import TTL_SQL, _walk_cache
from nestfold.catalog.rigs import AS_OF, CLICKS, LISTINGS, POSTS, TITLES, pick
from nestfold.functions import codes, geo, text
from nestfold.operators import enrich, metrics, rules, state
from nestfold.session import configure, work_folder
from nestfold.sources import captured
from nestfold.streaming import feedback, walks

L = f"({rigs.text_of(LISTINGS)})"
FMT = "yyyy-MM-dd HH:mm:ss"


def _clicks(spark, d) -> DataFrame:
    return feedback.dispatched(rigs.rig(spark, d, CLICKS))


CLICK_SQL = """
SELECT event_id AS update_id, ts, CASE event_type WHEN 'click' THEN 'skip' WHEN 'signup' THEN 'fav' WHEN 'error' THEN 'unfav' ELSE 'unknown' END AS kind,
  CASE WHEN event_type IN ('click', 'signup', 'error') THEN CAST(user_id AS STRING) END AS key FROM events"""


def click_dispatch(spark, d):
    return _clicks(spark, d).select("update_id", "kind", "key")


def click_counts(spark, d):
    return metrics.click_counts(_clicks(spark, d))


def first_seen_set(spark, d):
    out = state.first_seen_set(_clicks(spark, d).filter("kind = 'skip'"), "key", "ts")
    return out.select("key", F.date_format("first_ts", FMT).alias("first_ts"))


FIRST_SQL = f"SELECT key, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts FROM ({CLICK_SQL}) c WHERE kind = 'skip' GROUP BY 1"


def toggle_fold(spark, d):
    out = state.toggle_fold(_clicks(spark, d), "key", "kind", "ts", "update_id")
    return out.select("key", F.date_format("since", FMT).alias("since"))


TOGGLE_SQL = f"""
WITH c AS (SELECT *, max(CASE WHEN kind = 'unfav' THEN (ts, update_id) END) OVER (PARTITION BY key) AS off
           FROM ({CLICK_SQL}) k WHERE kind IN ('fav', 'unfav'))
SELECT key, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS since FROM c WHERE kind = 'fav' AND (off IS NULL OR (ts, update_id) > off) GROUP BY 1"""


def _skipped(spark, d) -> DataFrame:
    """Hidden keys: the listing whose number the user has, of source by number."""
    key = F.concat_ws(":", F.get(F.array(*[F.lit(s) for s in rigs.SOURCES]), (F.col("user_id") % 4).cast("int")), "user_id")
    return _clicks(spark, d).filter("kind = 'skip'").select(key.alias("listing_key")).distinct()


SKIPPED_SQL = f"SELECT DISTINCT (['4zida','cityexpert','nekretnine','halooglasi'])[user_id % 4 + 1] || ':' || user_id AS listing_key FROM events WHERE event_type = 'click'"


def skip_antijoin(spark, d):
    return state.skip_antijoin(rigs.listings(spark, d), _skipped(spark, d)).select("listing_key")


def skipped_profiles(spark, d):
    out = state.skipped_profiles(_skipped(spark, d), rigs.listings(spark, d).filter("seq % 3 <> 0"))
    return out.select("listing_key", "price_eur", "m2", "title", "code")


PROFILES_SQL = f"SELECT listing_key, price_eur, m2, title, code FROM {L} l WHERE seq % 3 <> 0 AND listing_key IN ({SKIPPED_SQL})"


# --- posts -----------------------------------------------------------------------------------


def _posts(spark, d) -> DataFrame:
    return rigs.rig(spark, d, POSTS)


P = f"({rigs.text_of(POSTS)})"
TAGGED = "doc_id % 7 IN (0, 1, 3)"
PETS_OK = "doc_id % 7 IN (0, 1, 2, 5, 6)"
SIZE = "CASE doc_id % 7 WHEN 0 THEN 60.0 WHEN 1 THEN 72.5 WHEN 2 THEN 45.0 WHEN 3 THEN 80.0 WHEN 5 THEN 55.0 WHEN 6 THEN 66.5 END"


def hashtag_filter(spark, d):
    return rules.hashtag_filter(_posts(spark, d), "#аренда").select("channel", "message_id")


def post_filter(spark, d):
    # The rig's sentence comes first; the document behind it may state sizes of its own.
    posts = _posts(spark, d).withColumn("facts", enrich.post_facts(F.col("text")))
    return rules.post_filter(posts, 55.0).select("channel", "message_id", "facts.m2", "facts.address")


POST_FILTER_SQL = f"""
SELECT source AS channel, doc_id AS message_id, CAST({SIZE} AS DOUBLE) AS m2,
  CASE doc_id % 7 WHEN 0 THEN 'Krunska 35, centar' WHEN 6 THEN 'Bulevar 7' END AS address
FROM documents WHERE {PETS_OK} AND {SIZE} > 55"""


def _seen(spark, d) -> DataFrame:
    return _posts(spark, d).filter("message_id % 3 = 0").select("channel", "message_id")


def unseen_posts(spark, d):
    return state.unseen_posts(_posts(spark, d), _seen(spark, d)).select("channel", "message_id")


def channel_counts(spark, d):
    posts = _posts(spark, d)
    tagged = text.has_hashtag(F.col("text"), "#аренда")
    return metrics.channel_counts(posts.withColumn("outcome", F.when(tagged, "tagged").otherwise("untagged")))


# --- caches and enrichment ---------------------------------------------------------------------


def _facts_cache(spark, d) -> DataFrame:
    """Stored facts: current for some rows, of an older text, without hash or corrupt for others."""
    docs = rigs.rig(spark, d, TITLES)
    n = F.col("seq") % 6
    payload = F.when(n == 0, '{"pets_allowed": "yes", "gone_field": 1, "max_lease_months": 3}').when(n == 1, "{broken")
    return docs.filter("seq % 6 < 5").select(
        "listing_key",
        F.coalesce(payload, F.lit('{"pets_allowed": "no"}')).alias("payload"),
        F.when(n == 2, F.sha1(F.lit("older"))).when(n == 3, F.lit(None)).otherwise(text.content_hash(F.col("description"))).alias("desc_hash"),
        (F.lit(AS_OF) - F.make_dt_interval(F.lit(5))).alias("extracted_at"),
    )


def cache_split(spark, d):
    hits, misses = state.cache_split(rigs.rig(spark, d, TITLES), _facts_cache(spark, d))
    return hits.select("listing_key", F.lit("hit").alias("side"), "extraction.pets_allowed", "extraction.max_lease_months").unionByName(
        misses.select("listing_key", F.lit("miss").alias("side"), F.lit(None).cast("string").alias("pets_allowed"), F.lit(None).cast("int").alias("max_lease_months"))
    )


SPLIT_SQL = """
SELECT CAST(doc_id AS STRING) AS listing_key, CASE WHEN doc_id % 6 IN (0, 4) THEN 'hit' ELSE 'miss' END AS side,
  CASE doc_id % 6 WHEN 0 THEN 'yes' WHEN 4 THEN 'no' END AS pets_allowed, CASE WHEN doc_id % 6 = 0 THEN 3 END AS max_lease_months FROM documents"""


@enrich.per_row
def count_words(text: str) -> str:
    """An enrichment function of one text: the summary is the word count; long texts fail."""
    if len(text) > 4000:
        raise ValueError("too long")
    return '{"summary_en": "%d words"}' % len(text.split())


def _enriched(spark, d, fn=count_words, budget=None):
    return enrich.incremental_enrich(rigs.rig(spark, d, TITLES), _facts_cache(spark, d), fn, AS_OF, budget)


def incremental_enrich(spark, d):
    rows, _, _ = _enriched(spark, d)
    return rows.select("listing_key", "extraction.pets_allowed", "extraction.summary_en")


ENRICH_SQL = r"""
SELECT CAST(doc_id AS STRING) AS listing_key, CASE doc_id % 6 WHEN 0 THEN 'yes' WHEN 4 THEN 'no' END AS pets_allowed,
  CASE WHEN doc_id % 6 NOT IN (0, 4) AND length(text) <= 4000 THEN len(regexp_split_to_array(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+')) || ' words' END AS summary_en
FROM documents"""


ENRICH_BUDGET = 150


def enrich_budget(spark, d):
    """Only the first misses in arrival order are tried."""
    rows, _, failures = _enriched(spark, d, budget=ENRICH_BUDGET)
    return rows.select("listing_key", "extraction.summary_en").join(failures, "listing_key", "left")


_MISSES = "SELECT *, row_number() OVER (ORDER BY doc_id) AS nth FROM documents WHERE doc_id % 6 NOT IN (0, 4)"
_WORDS = r"len(regexp_split_to_array(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+')) || ' words'"
BUDGET_SQL = f"""
SELECT CAST(doc_id AS STRING) AS listing_key, CAST(NULL AS STRING) AS summary_en, CAST(NULL AS STRING) AS error FROM documents WHERE doc_id % 6 IN (0, 4)
UNION ALL SELECT CAST(doc_id AS STRING), CASE WHEN nth <= {ENRICH_BUDGET} AND length(text) <= 4000 THEN {_WORDS} END,
  CASE WHEN nth > {ENRICH_BUDGET} THEN 'over budget' WHEN length(text) > 4000 THEN 'too long' END FROM ({_MISSES}) m"""


def _no_calls_left(rows: pd.DataFrame) -> pd.DataFrame:
    raise enrich.BudgetExhausted("no calls left")


def enrich_breaker(spark, d):
    """A service that stops at once: every miss fails and waits for the next run."""
    rows, _, failures = _enriched(spark, d, _no_calls_left)
    return rows.select("listing_key", "extraction.pets_allowed").join(failures, "listing_key", "left")


BREAKER_SQL = """
SELECT CAST(doc_id AS STRING) AS listing_key, CASE doc_id % 6 WHEN 0 THEN 'yes' WHEN 4 THEN 'no' END AS pets_allowed,
  CASE WHEN doc_id % 6 NOT IN (0, 4) THEN 'no calls left' END AS error FROM documents"""


def enrich_next_cache(spark, d):
    """The cache after the run: new answers over old entries, what failed left as it was."""
    _, cache, _ = _enriched(spark, d)
    age = F.datediff(F.lit(AS_OF), "extracted_at")
    return cache.select("listing_key", F.md5("payload").alias("payload"), age.alias("age"))


NEXT_CACHE_SQL = f"""
SELECT CAST(doc_id AS STRING) AS listing_key, CASE WHEN doc_id % 6 NOT IN (0, 4) AND length(text) <= 4000 THEN 0 ELSE 5 END AS age,
  md5(CASE WHEN doc_id % 6 NOT IN (0, 4) AND length(text) <= 4000 THEN '{{"summary_en": "' || {_WORDS} || '"}}'
      WHEN doc_id % 6 = 0 THEN '{{"pets_allowed": "yes", "gone_field": 1, "max_lease_months": 3}}' WHEN doc_id % 6 = 1 THEN '{{broken'
      ELSE '{{"pets_allowed": "no"}}' END) AS payload
FROM documents WHERE doc_id % 6 < 5 OR length(text) <= 4000"""


def enrich_failures(spark, d):
    _, _, failures = _enriched(spark, d)
    return failures


# The listings' phrases, and two of flags and of numbers with more digits.
FACT_PHRASES = [*rigs.PHRASES, "Depozit dva meseca, dugoročno.", "Minimum 120 meseci, bills 12000."]


def text_facts(spark, d):
    docs = rigs.rig(spark, d, f"SELECT doc_id, {pick(f'doc_id % {len(FACT_PHRASES)}', FACT_PHRASES)} || ' ' || text AS t FROM {{documents}}")
    f = enrich.text_facts(F.col("t"))
    return docs.withColumn("f", f).select(
        "doc_id", "f.pets_allowed", F.col("f.dishwasher").cast("int").alias("dishwasher"), "f.heating_type_confirmed", "f.furnishing_confirmed",
        "f.max_lease_months", "f.bills_estimate_eur", "f.agency_or_owner", F.array_join("f.red_flags", ",").alias("red_flags"),
    )


_PHRASE = f"doc_id % {len(FACT_PHRASES)}"


def _by_phrase(values: list) -> str:
    return pick(_PHRASE, values)


FACTS_TEXT_SQL = f"""
SELECT doc_id, {_by_phrase(['no', 'yes', 'unknown', 'unknown', 'unknown', 'unknown', 'unknown', 'yes', *['unknown'] * 4])} AS pets_allowed,
  CASE WHEN {_PHRASE} = 2 THEN 1 END AS dishwasher, {_by_phrase([None, None, None, 'centralno', 'etazno'])} AS heating_type_confirmed,
  {_by_phrase([None, None, None, 'furnished', 'semi-furnished', None, 'unfurnished'])} AS furnishing_confirmed,
  CASE {_PHRASE} WHEN 5 THEN 18 WHEN 11 THEN 120 END AS max_lease_months, CASE {_PHRASE} WHEN 5 THEN 250 WHEN 8 THEN 90 WHEN 11 THEN 12000 END AS bills_estimate_eur,
  {_by_phrase(['unknown'] * 7 + ['owner', 'agency'] + ['unknown'] * 3)} AS agency_or_owner,
  CASE {_PHRASE} WHEN 6 THEN 'students only' WHEN 10 THEN 'high deposit,long lease only' ELSE '' END AS red_flags
FROM documents"""


def vector_fingerprint(spark, d):
    return rigs.table(spark, d, "embeddings").select("vec_id", codes.vector_fingerprint(F.col("embedding")).alias("code"))


CODE_SQL = """SELECT vec_id, list_sum([CASE WHEN v[i]::DOUBLE > m THEN CASE WHEN i = 64 THEN -9223372036854775808::HUGEINT ELSE 1::HUGEINT << (i - 1) END ELSE 0 END FOR i IN range(1, 65)])::BIGINT AS code
FROM (SELECT vec_id, embedding AS v, list_median([x::DOUBLE FOR x IN embedding]) AS m FROM embeddings) e"""


# --- streams: each runs over all rows of the given table and stops --------------------------------


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A given table as a stream, be it one file or a folder of files: a stream takes either only by a pattern."""
    configure(spark)
    spark.conf.set("spark.sql.streaming.schemaInference", "false")
    schema = rigs.table(spark, d, name).schema
    return spark.readStream.schema(schema).parquet(f"{d}/{name}.parque[t]")


def _work(spark: SparkSession) -> str:
    """A new folder of the shared one for each run of a stream."""
    return work_folder(configure(spark), "stream")


def _click_rows(events: DataFrame) -> DataFrame:
    prefix = F.when(F.col("event_type") == "click", "skip:").when(F.col("event_type") == "signup", "fav:").when(F.col("event_type") == "error", "unfav:")
    return events.select(F.col("event_id").alias("update_id"), "ts", F.concat(F.coalesce(prefix, F.lit("look:")), "user_id").alias("data"))


def _drain(query) -> None:
    query.awaitTermination()


def click_stream(spark, d):
    out = _work(spark)
    _drain(feedback.click_stream(_click_rows(_stream(spark, d, "events")), f"{out}/clicks", f"{out}/cp", True))
    return spark.read.parquet(f"{out}/clicks").select("update_id", "kind", "key")


def skip_stream(spark, d):
    out = _work(spark)
    _drain(feedback.skip_stream(_click_rows(_stream(spark, d, "events")), f"{out}/skipped", f"{out}/cp", True))
    return spark.read.parquet(f"{out}/skipped").select("key")


def favorite_stream(spark, d):
    out = _work(spark)
    _drain(feedback.favorite_stream(_click_rows(_stream(spark, d, "events")), f"{out}/favorites", f"{out}/cp", True, seq="update_id"))
    changes = spark.read.option("basePath", f"{out}/favorites").parquet(f"{out}/favorites")
    return feedback.favorites_of(changes).select("key", F.date_format("since", FMT).alias("since"))


def post_stream(spark, d):
    out = _work(spark)
    docs = _stream(spark, d, "documents").select(F.col("source").alias("channel"), (F.col("doc_id") % 300).alias("message_id"))
    _drain(feedback.post_stream(docs, f"{out}/posts", f"{out}/cp", True))
    return spark.read.parquet(f"{out}/posts").select("channel", "message_id")


def instant_stream(spark, d):
    """Orders as pushes; every fifth customer was notified before the run."""
    out = _work(spark)
    old = rigs.table(spark, d, "customer").filter("c_custkey % 5 = 0")
    known = old.select(
        F.col("c_custkey").cast("string").alias("listing_key"), F.lit(AS_OF).cast("timestamp").alias("notified_at")
    )
    rows = _stream(spark, d, "orders").select(
        F.col("o_custkey").cast("string").alias("listing_key"), F.col("o_totalprice").alias("price_eur"), F.lit("match").alias("stage"), F.col("o_orderkey").alias("seq")
    )
    _drain(feedback.instant_stream(rows, known, f"{out}/outbox", f"{out}/cp", True))
    return feedback.read_outbox(spark, f"{out}/outbox").select("listing_key", "price_eur")


INSTANT_SQL = """
SELECT CAST(o_custkey AS STRING) AS listing_key, arg_min(o_totalprice, o_orderkey) AS price_eur FROM orders
WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 5 = 0) GROUP BY 1"""


def click_log(spark, d):
    """The clicks as captured update files, read by a stream with offsets of its own."""
    out = _work(spark)
    span = F.floor(F.col("update_id") / 1000.0).cast("bigint") * 1000
    rows = rigs.rig(spark, d, CLICKS).select("update_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), "user_id", "data")
    rows = rows.withColumn("updates", F.concat_ws("-", span, span + 999))
    rows.repartition("updates").write.partitionBy("updates").json(f"{out}/log")
    captured.register(spark)
    clicks = spark.readStream.format("click_log").option("path", f"{out}/log").load()
    query = feedback.click_stream(clicks, f"{out}/clicks", f"{out}/cp")
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.read.parquet(f"{out}/clicks").select("update_id", "kind", "key")


def walk_stream(spark, d):
    """The walk cache as a stream's state: the stored walks arrive, then every listing asks."""
    out = _work(spark)
    stored = _walk_cache(spark, d).select("grid_key", F.col("fetched_at").alias("at"), F.lit(None).cast("bigint").alias("ask_id"), F.col("walk_min").cast("int").alias("walk_min"))
    listed = rigs.listings(spark, d)
    key = F.concat(geo.coord_cell(F.col("lat"), F.col("lng"), 3), F.lit("@office"))
    asks = listed.select(key.alias("grid_key"), F.lit(AS_OF).cast("timestamp").alias("at"), F.col("seq").cast("bigint").alias("ask_id"), F.lit(None).cast("int").alias("walk_min"))
    for batch in (stored, asks):
        batch.write.mode("append").parquet(f"{out}/in")
        rows = spark.readStream.schema(asks.schema).parquet(f"{out}/in")
        _drain(walks.walk_stream(rows, f"{out}/looked", f"{out}/cp", True, 90))
    looked = spark.read.parquet(f"{out}/looked").withColumnRenamed("ask_id", "seq")
    return listed.select("seq", "listing_key").join(looked, "seq").select("listing_key", F.col("hit").cast("int").alias("hit"), "walk_min")


def write_digest(spark, d):
    """A run per listing source as its date, one date written twice; what is read back."""
    out = f"{_work(spark)}/digest"
    rows = rigs.listings(spark, d).select("listing_key", "price_eur", "source")
    for day, name in enumerate(rigs.SOURCES, start=1):
        state.write_digest(rows.filter(F.col("source") == name), out, f"2026-06-0{day}")
    state.write_digest(rows.filter("source = '4zida' and price_eur < 900"), out, "2026-06-01")
    return spark.read.parquet(out).select("listing_key", F.col("run_date").cast("string").alias("run_date"), "price_eur")


WRITE_SQL = f"""
SELECT listing_key, '2026-06-0' || list_position(['4zida','cityexpert','nekretnine','halooglasi'], source) AS run_date, price_eur
FROM {L} l WHERE source <> '4zida' OR price_eur < 900"""


QUERIES = {
    f.__name__: f
    for f in (
        click_dispatch, click_counts, first_seen_set, toggle_fold, skip_antijoin, skipped_profiles, hashtag_filter,
        post_filter, unseen_posts, channel_counts, cache_split, incremental_enrich, enrich_failures, enrich_budget, enrich_breaker, enrich_next_cache, text_facts,
        vector_fingerprint, click_stream, click_log, skip_stream, favorite_stream, post_stream, instant_stream, walk_stream, write_digest,
    )
}

ORACLE = {
    "click_dispatch": f"SELECT update_id, kind, key FROM ({CLICK_SQL}) c",
    "click_counts": f"SELECT kind, count(*) AS n FROM ({CLICK_SQL}) c GROUP BY 1",
    "first_seen_set": FIRST_SQL,
    "toggle_fold": TOGGLE_SQL,
    "skip_antijoin": f"SELECT listing_key FROM {L} l WHERE listing_key NOT IN ({SKIPPED_SQL})",
    "skipped_profiles": PROFILES_SQL,
    "hashtag_filter": f"SELECT source AS channel, doc_id AS message_id FROM documents WHERE {TAGGED}",
    "post_filter": POST_FILTER_SQL,
    "unseen_posts": "SELECT source AS channel, doc_id AS message_id FROM documents WHERE doc_id % 3 <> 0",
    "channel_counts": f"SELECT source AS channel, CASE WHEN {TAGGED} THEN 'tagged' ELSE 'untagged' END AS outcome, count(*) AS n FROM documents GROUP BY 1, 2",
    "cache_split": SPLIT_SQL,
    "incremental_enrich": ENRICH_SQL,
    "enrich_budget": BUDGET_SQL,
    "enrich_breaker": BREAKER_SQL,
    "enrich_next_cache": NEXT_CACHE_SQL,
    "enrich_failures": "SELECT CAST(doc_id AS STRING) AS listing_key, 'too long' AS error FROM documents WHERE doc_id % 6 NOT IN (0, 4) AND length(text) > 4000",
    "text_facts": FACTS_TEXT_SQL,
    "vector_fingerprint": CODE_SQL,
    "click_stream": f"SELECT update_id, kind, key FROM ({CLICK_SQL}) c",
    "click_log": f"SELECT update_id, kind, key FROM ({CLICK_SQL}) c",
    "walk_stream": TTL_SQL,
    "skip_stream": f"SELECT DISTINCT key FROM ({CLICK_SQL}) c WHERE kind = 'skip'",
    "favorite_stream": TOGGLE_SQL,
    "post_stream": "SELECT DISTINCT source AS channel, doc_id % 300 AS message_id FROM documents",
    "instant_stream": INSTANT_SQL,
    "write_digest": WRITE_SQL,
}

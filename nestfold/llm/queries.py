"""Registered queries of the training-data operators over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nestfold.llm import decontam, licenses, mixing, near_dup, pii, prefix_trie, quality, rules, sharding, token_counts, tokens, vector_codes, warc
from nestfold.session import configure, work_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), size=2)


HELD_OUT = 5  # of every five ids one, by checksum, is kept from training


def held_out(id_col: str = "doc_id"):
    """Whether an id is kept from training: crc32 of its text is a multiple of five. A null id is."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % HELD_OUT == 0


def quality_scores(spark: SparkSession, docs: DataFrame, sf_dir: str, name: str = "score") -> DataFrame:
    """``docs`` with their score; labels are learnt from the ids that aren't held out, over ``documents``."""
    labels = table(spark, sf_dir, "labels").filter(~held_out())
    weights = quality.train(table(spark, sf_dir, "documents"), labels, "quality")
    return quality.score(docs, weights, name=name)


KEEP_SCORE = 0.3


@query()
def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_scores(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), sf_dir)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= KEEP_SCORE).cast("int").alias("predicted"))


@query()
def op9_simple8b_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"))


def token_digests(docs: DataFrame) -> DataFrame:
    """Write the token ids of ``docs``, read the files back and return a digest of each document."""
    folder = work_folder(docs.sparkSession, "tokens")
    tokens.write_tokens(docs, folder)
    return tokens.read_tokens(docs.sparkSession, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query()
def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.col("hits.item_id").alias("item_ids"), F.col("hits.start").alias("starts"), F.col("hits.words").alias("words"), (F.size("hits") == 0).alias("kept"))


@query()
def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mixing.take(docs, mixing.plan_mix(docs))
    return mixed.select("doc_id", "mix.size", "mix.source_size", "mix.target", (F.col("mix.times") * F.col("mix.size")).alias("taken"))


@query()
def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("pii", lambda s: s["kind"].isin([k.name for k in pii.KINDS if k.base]))
    return found.select(
        "doc_id", *(count(k.name) for k in pii.KINDS), F.sha2(pii.written(base), 256).alias("base_sha256"), pii.written(F.col("pii")).alias("spans"), F.array_max("pii.score").alias("max_score")
    )


@query()
def op6_karmarkar_karp_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_by_bytes(table(spark, sf_dir, "documents"))
    return placed.withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))


@query(
    """
    WITH p AS (SELECT page_id, coalesce(html, '') AS payload, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
    d AS (SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha256(payload) AS payload_digest,
                 CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY payload) ELSE page_id END AS first FROM p)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> first THEN first END AS refers_to
    FROM d
    """
)
def op3_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_folder(configure(spark), "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), folder)
    return warc.resolve_revisits(spark, warc.read_archives(spark, folder))


@query()
def op8_adaptive_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.judge(rules.count_signals(table(spark, sf_dir, "documents")))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select(F.col("id").alias("doc_id"), *counts, "base_failed", "failed", "kept")


@query()
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.size("licenses").alias("n_licenses"), *(F.col(f"licenses.{c}").alias(f"{c}s") for c in ("license", "start", "containment")))


@query()
def op11_whole_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


@query(
    """
    WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
    d AS (SELECT conv_id, turn, md5(length(role) || ':' || role || text) AS digest, length(text) AS chars FROM t),
    p AS (SELECT conv_id, digest, chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS pos FROM d),
    bits AS (SELECT DISTINCT conv_id, flatten([[4294967295], flatten([[ascii(x), -1, -1, -1, -1, -1, -1, -1, -1] FOR x IN string_split(CAST(conv_id AS VARCHAR), '')])]) AS b FROM p),
    h AS (SELECT conv_id, conv_id - conv_id % 100 AS donor,
                 xor(4294967295, list_reduce(b, lambda x, y: CASE WHEN y >= 0 THEN xor(x, y) ELSE xor(x >> 1, (x & 1) * 3988292384) END)) % 6 AS h FROM bits),
    r AS (SELECT h.conv_id, p.pos, digest, chars FROM h JOIN p ON p.conv_id = h.donor AND p.pos <= h.h
          UNION ALL SELECT h.conv_id, p.pos, digest, chars FROM h JOIN p ON p.conv_id = h.conv_id AND p.pos > h.h),
    m AS (SELECT conv_id, 0 AS depth, '' AS path, 0 AS chars FROM h
          UNION ALL SELECT conv_id, row_number() OVER w, string_agg(digest, '') OVER w, chars FROM r
          WINDOW w AS (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
    n AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(chars) AS chars FROM m GROUP BY path, depth),
    c AS (SELECT substr(path, 1, 32 * (depth - 1)) AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
    v AS (SELECT n.path, n.depth, (n_convs - 1) * chars AS saved, CASE WHEN n_children IS NULL THEN 1 ELSE 0 END AS leaf FROM n LEFT JOIN c USING (path)),
    u AS (SELECT path, saved, leaf, unnest(range(depth + 1)) AS k FROM v),
    s AS (SELECT substr(path, 1, 32 * k) AS path, sum(saved) AS saved, sum(leaf) AS leaves FROM u GROUP BY 1),
    l AS (SELECT conv_id, max(depth) AS depth FROM m GROUP BY conv_id),
    e AS (SELECT path, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM m JOIN l USING (conv_id, depth) GROUP BY path)
    SELECT n.conv_id, n.depth, q.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, CAST(leaves AS BIGINT) AS n_leaves,
           CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
    FROM n JOIN s USING (path) LEFT JOIN c USING (path) LEFT JOIN e USING (path)
    LEFT JOIN n AS q ON n.depth > 0 AND q.path = substr(n.path, 1, 32 * (n.depth - 1)) AND q.depth = n.depth - 1
    """
)
def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    rebuilt = prefix_trie.share_heads(prefix_trie.sequences(table(spark, sf_dir, "conversations")))
    return prefix_trie.prefix_trie(rebuilt)


_VECTOR_ROUND = """,
    o{k} AS MATERIALIZED (SELECT r, part, min(away * 256 + entry) AS best FROM (SELECT r, part, entry, sum((x - c) * (x - c)) AS away FROM x JOIN c{k} USING (part, place) GROUP BY r, part, entry) GROUP BY r, part),
    u{k} AS (SELECT part, best % 256 AS entry, place, sum(x) AS total, count(*) AS n FROM x JOIN o{k} USING (r, part) GROUP BY ALL),
    c{next} AS MATERIALIZED (SELECT part, entry, place, coalesce((total - ((total % n) + n) % n) // n, c) AS c FROM c{k} LEFT JOIN u{k} USING (part, entry, place))"""


@query(
    """
    WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, [CAST(floor(1024 * CAST(e AS DOUBLE)) AS BIGINT) FOR e IN embedding] AS v
                  FROM embeddings WHERE embedding IS NOT NULL AND len([1 FOR e IN embedding IF e IS NULL OR NOT isfinite(e)]) = 0),
    i AS (SELECT r, unnest(range(len(v))) AS k, unnest(v) AS x, len(v) // 4 AS d FROM kept),
    x AS MATERIALIZED (SELECT r, k // d AS part, k % d AS place, x FROM i),
    c0 AS MATERIALIZED (SELECT part, r - 1 AS entry, place, x AS c FROM x WHERE r <= 256)"""
    + "".join(_VECTOR_ROUND.format(k=k, next=k + 1) for k in range(vector_codes.ROUNDS + 1))
    + f""",
    g AS (SELECT r, string_agg(printf('%02x', best % 256), '' ORDER BY part) AS code, CAST(sum(best // 256) AS BIGINT) AS error FROM o{vector_codes.ROUNDS} GROUP BY r),
    b AS (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, place)) AS codebooks_sha256 FROM c{vector_codes.ROUNDS})
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept JOIN g USING (r), b
    """
)
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(vector_codes.codebooks_digest(books)).alias("codebooks_sha256"))

"""The digest pipeline: listings and state in; cards, rejections, health and next state out.

One lazy plan up to the two places where outside answers must be kept exactly once
(facts from text, walking times) and the cluster labels; those are materialised, everything else is
fused by the optimizer. Cheap rules come before text work, text work before distances, and
only rows that survive are matched with each other. Texts and links leave once the facts are known, and the
run's counters are observed on the tables that it writes anyway.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from nestfold.config import Destination, DigestConfig
from nestfold.functions import present, vocab
from nestfold.operators import cluster, distance, enrich, metrics, notify, rank, rules, similarity, state
from nestfold.session import cut
from nestfold.sources import feed, json_ads

# Listing columns a run overwrites in the snapshot; first sight, code and stamps are kept.
LISTING_STATE = [
    "source", "id", "url", "price_eur", "m2", "rooms", "floor", "total_floors", "last_floor",
    "elevator", "furnished", "heating_type", "pets_allowed", "title", "description", "address",
    "place_names", "image_url", "is_agency", "created_at",
]

# Not needed for matching, ranking or cards once the facts are known.
WIDE = ["description", "desc_hash", "url", "image_url"]

BADGES = {
    "price_drop": "price drop",
    "price_change": "price changed",
    "upgraded": "upgraded from near-miss",
    "relisted": "re-surfaced",
}


@dataclass
class DigestInputs:
    """``listings`` has the LISTING columns plus ``seq, listing_key, code``."""

    listings: DataFrame
    snapshot: DataFrame
    skipped: DataFrame
    extraction_cache: DataFrame
    walk_cache: DataFrame
    walk_provider: "DataFrame | Callable[[DataFrame], DataFrame]"
    destinations: list[Destination]
    enrich_fn: "enrich.EnrichFn | Callable[[Column], Column]" = enrich.text_facts
    enrich_is_column: bool = True
    detail_texts: DataFrame | None = None
    sources: tuple[str, ...] = tuple(vocab.SOURCE_RANK)
    source_errors: dict[str, str] | None = None


@dataclass
class DigestOutputs:
    cards: DataFrame
    rejected: DataFrame
    rejected_tally: DataFrame
    rejected_shown: DataFrame
    funnel: DataFrame
    health: DataFrame
    dedup: DataFrame
    overflow: DataFrame
    clustered: DataFrame
    snapshot: DataFrame
    extraction_cache: DataFrame
    walk_cache: DataFrame
    failures: DataFrame


@dataclass
class Gated:
    """Rows after the rule, facts and distance stages, before matching."""

    candidates: DataFrame
    rejected: DataFrame
    extraction_cache: DataFrame
    walk_cache: DataFrame
    failures: DataFrame
    counts: dict[str, int] = field(default_factory=dict)  # rejected rows by stage
    arrived: dict[str, int] = field(default_factory=dict)  # listings by source


def gate_candidates(inputs: DigestInputs, cfg: DigestConfig, as_of: datetime, budget: int | None = None, narrow: bool = False) -> Gated:
    """Hidden rows out, structural rules, facts from text, facts rules, walking times, gate. ``narrow`` leaves texts
    and links behind once the facts are known."""
    arrived, counts = Observation(), [Observation() for _ in range(3)]
    seen = inputs.listings.observe(arrived, *(F.count_if(F.col("source") == s).alias(s) for s in inputs.sources))
    visible = state.skip_antijoin(seen, inputs.skipped)
    ruled = rules.structural_filter(visible, cfg.filters, as_of)
    ruled = ruled.observe(counts[0], F.count_if(F.col("rule_id").isNotNull()).alias("structural"))
    dropped = ruled.filter("rule_id is not null").select(
        "listing_key", "seq", F.lit("structural").alias("stage"), F.lit(0).alias("stage_no"), "rule_id", F.col("reject_reason").alias("reason")
    )
    alive = ruled.filter("rule_id is null").drop("rule_id", "reject_reason")
    if inputs.detail_texts is not None:
        # Only rows of source A that say nothing about pets need their full text.
        wanted = inputs.detail_texts.join(
            alive.filter("source = '4zida' and pets_allowed is null").select("listing_key"),
            "listing_key",
            "left_semi",
        )
        alive = json_ads.with_detail_text(alive, wanted, "listing_key").drop("upgraded")
    rows, extraction_cache, failures = enrich.incremental_enrich(
        alive,
        inputs.extraction_cache,
        inputs.enrich_fn,
        as_of,
        budget,
        as_column=inputs.enrich_is_column,
    )
    judged = rules.facts_filter(rows, cfg.filters).drop(*(WIDE if narrow else []))
    judged = cut(judged.observe(counts[1], F.count_if(F.col("verdict") == "rejected").alias("facts")))
    no = judged.filter("verdict = 'rejected'").select(
        "listing_key", "seq", F.lit("facts").alias("stage"), F.lit(1).alias("stage_no"), F.col("fact_rule").alias("rule_id"), F.element_at("hard", 1).alias("reason")
    )
    maybe = judged.filter("verdict <> 'rejected'")
    walk_cache = inputs.walk_cache
    gating = [d.name for d in inputs.destinations if d.gates]
    if inputs.destinations:
        walks, walk_cache = distance.resolve_walk(
            maybe, inputs.destinations, inputs.walk_cache, inputs.walk_provider, as_of, cfg.walk
        )
        maybe = maybe.join(distance.commute_map(walks), "listing_key", "left")
    else:
        maybe = maybe.withColumn("commute", F.lit(None).cast("map<string,int>"))
    gated = rules.commute_gate(maybe, gating, cfg.filters.walk_min_max)
    gated = cut(gated.observe(counts[2], F.count_if(F.col("gate_reason").isNotNull()).alias("commute")))
    far = gated.filter("gate_reason is not null").select(
        "listing_key", "seq", F.lit("commute").alias("stage"), F.when(F.col("verdict") == "passed", 2).otherwise(3).alias("stage_no"), F.lit("commute").alias("rule_id"), F.col("gate_reason").alias("reason")
    )
    candidates = gated.filter("gate_reason is null").withColumn(
        "stage", F.when(F.col("verdict") == "passed", "match").otherwise("near_miss")
    )
    return Gated(
        candidates.drop("gate_reason", "verdict", "fact_rule", "hard"),
        dropped.unionByName(no).unionByName(far),
        extraction_cache,
        walk_cache,
        failures,
        {k: v for o in counts for k, v in o.get.items()},
        arrived.get,
    )


def run_digest(
    inputs: DigestInputs,
    cfg: DigestConfig,
    as_of: datetime,
    mode: str = "digest",
    force: bool = False,
    budget: int | None = None,
) -> DigestOutputs:
    """One run. ``mode`` is 'digest' (only rows with a reason to be sent) or 'instant' (only
    rows never sent before)."""
    before = inputs.snapshot
    seen = state.upsert_snapshot(before, inputs.listings, "listing_key", LISTING_STATE, "seq", as_of)
    gated = gate_candidates(inputs, cfg, as_of, budget, narrow=True)

    # Hidden rows with what this batch says of them; only hidden keys are merged for it.
    profiles = state.upsert_snapshot(
        state.skipped_profiles(inputs.skipped, before),
        inputs.listings.join(inputs.skipped.select("listing_key").distinct(), "listing_key", "left_semi"),
        "listing_key",
        LISTING_STATE,
        "seq",
    )
    hidden = profiles.select("code", "title", "price_eur", F.lit(0).cast("bigint").alias("seq"))
    unhidden = cut(similarity.skipped_dup_antijoin(gated.candidates, hidden, cfg.match))
    matches = unhidden.filter("stage = 'match'")
    clustered = cluster.cluster_flats(matches, similarity.same_flat_edges(matches, cfg.match))
    canonical = rank.pick_canonical(
        clustered, "cluster_id", vocab.source_rank(F.col("source")), cols=matches.columns
    )
    near = unhidden.filter("stage = 'near_miss'").select(
        F.col("seq").alias("cluster_id"), F.lit(1).cast("bigint").alias("cluster_size"), *matches.columns
    )
    reasoned = notify.notify_reason(canonical.unionByName(near), before, as_of, cfg.notify)
    chosen = notify.renotify_gate(reasoned, mode, force)
    if mode == "instant":
        chosen = state.fresh_only(chosen, before)
    sent = Observation()
    ranked = rank.rank_listings(chosen, inputs.destinations, cfg.filters.freshness_days, as_of, cfg.score)
    ranked = cut(ranked.observe(sent, *(F.count_if(F.col("stage") == s).alias(s) for s in ("match", "near_miss"))))
    # In instant mode every canonical match is stamped, as its 14 days start anew; near misses
    # only when they were sent.
    stamps = ranked if mode == "digest" else canonical.select("listing_key", "price_eur", "stage").unionByName(
        ranked.filter("stage = 'near_miss'").select("listing_key", "price_eur", "stage")
    )
    rejected = gated.rejected
    tally, first_rejected, _ = rank.rejection_tally(rejected, cfg.rejected_shown, ["stage_no", "seq"])
    # The row of each cluster that stands for it, with its reason.
    standing = reasoned.filter("stage = 'match'").select("seq", F.lit(True).alias("is_canonical"), "notify_reason")
    marked = clustered.select("seq", "cluster_id", "code").join(standing, "seq", "left")
    counted = {f"rejected_{k}": n for k, n in gated.counts.items()} | sent.get
    shown = {"match": cfg.top_matches, "near_miss": cfg.top_near}
    frame = inputs.listings.sparkSession.createDataFrame
    return DigestOutputs(
        cards=digest_rows(ranked, cfg, as_of, mode),
        rejected=rejected,
        rejected_tally=tally,
        rejected_shown=first_rejected,
        funnel=frame([(k, n) for k, n in counted.items() if n], "stage string, n bigint"),
        health=feed.counted_health(frame(list(gated.arrived.items()), "source string, n bigint"), list(inputs.sources), inputs.source_errors),
        dedup=metrics.dedup_stats(marked),
        overflow=frame([(k, max(0, sent.get[k] - n)) for k, n in shown.items() if sent.get[k]], "section string, overflow bigint"),
        clustered=clustered,
        snapshot=notify.mark_notified(
            state.upsert_snapshot(seen, gated.candidates.filter("code is not null"), "listing_key", ["code"], "seq", insert=False),
            stamps,
            as_of,
        ),
        extraction_cache=gated.extraction_cache,
        walk_cache=gated.walk_cache,
        failures=gated.failures,
    )


STORED = ("snapshot", "extraction_cache", "walk_cache")


def store_run(outputs: DigestOutputs, folder: str, run_date: str) -> None:
    """Write what the next run starts from, each table as a new version, and the cards of this date.

    The cards are written last: a run that dies before leaves them out, and its date is written again by the next try.
    """
    spark = outputs.cards.sparkSession
    for name in STORED:
        state.VersionedTable(spark, f"{folder}/{name}").write(getattr(outputs, name))
    state.write_digest(outputs.cards, f"{folder}/cards", run_date)


def stored_state(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The newest version of each table that ``store_run`` wrote; nothing before the first run."""
    found = {name: state.VersionedTable(spark, f"{folder}/{name}").read() for name in STORED}
    return {name: df for name, df in found.items() if df is not None}


def digest_rows(ranked: DataFrame, cfg: DigestConfig, as_of: datetime, mode: str = "digest") -> DataFrame:
    """Card data of the sections: rank, badge, facts. Digest sections are top-k lists (the
    limit is the feature); an instant push sends every fresh row and has no rank."""
    now = F.lit(as_of).cast("timestamp")
    e = F.col("extraction")
    columns = [
        F.col("stage").alias("section"),
        "rank",
        "listing_key",
        F.try_element_at(vocab.literal_map(BADGES), F.col("notify_reason")).alias("badge"),
        "price_eur",
        "rooms",
        "m2",
        "tier",
        "score",
        vocab.pets_state(F.col("pets_allowed"), e["pets_allowed"], "card").alias("pets"),
        present.short_address(F.col("address"), F.col("place_names")).alias("place"),
        present.relative_time(F.col("created_at"), now).alias("posted"),
        present.bills_flag(e["bills_estimate_eur"]).alias("bills"),
        F.coalesce(F.nullif(e["heating_type_confirmed"], F.lit("")), "heating_type").alias("heating"),
        (F.coalesce("dishwasher", F.lit(False)) | F.coalesce(e["dishwasher"], F.lit(False))).alias("dishwasher"),
        "elevator",
        "floor",
        "total_floors",
        "is_agency",
        F.array_join(e["red_flags"], "; ").alias("red_flags"),
        F.coalesce(F.nullif(e["description_en"], F.lit("")), e["summary_en"]).alias("summary"),
        F.array_join("soft", "; ").alias("unconfirmed"),
        present.maps_url(F.col("lat"), F.col("lng"), F.col("address"), F.col("place_names")).alias("map_url"),
    ]
    if mode == "instant":
        return ranked.withColumn("rank", F.lit(None).cast("int")).select(*columns)
    best, _ = rank.digest_topk(ranked.filter("stage = 'match'"), cfg.top_matches)
    almost, _ = rank.digest_topk(ranked.filter("stage = 'near_miss'"), cfg.top_near)
    return best.unionByName(almost).select(*columns)

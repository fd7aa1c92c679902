"""The digest pipeline on the listing rig against plain Python over the same rows."""

import os
from collections import Counter
from dataclasses import replace
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from nestfold.catalog import match_queries
from nestfold.catalog.rigs import AS_OF, DESTINATIONS
from nestfold.functions.vocab import SOURCE_RANK
from nestfold.plans import digest
from tests.test_cluster import first_fit, same_flat

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def run(spark):
    inputs = match_queries._inputs(spark, SF)
    # A wide gate, so that enough rows reach the matching.
    cfg = digest.DigestConfig(
        filters=digest.DigestConfig().filters.__class__(
            price_eur_max=1600, rooms_min=0.5, rooms_max=4, surface_m2_min=25, freshness_days=10, walk_min_max=400,
            photo_required=False, pets_required=False, max_lease_months=0,
        )
    )
    return inputs, cfg, digest.run_digest(inputs, cfg, AS_OF)


def reason(row, state):
    at, price, stage = state.get(row.listing_key, (None, None, None))
    if at is None:
        return "new"
    if price is not None and row.price_eur < price * 0.95:
        return "price_drop"
    if price is not None and row.price_eur != price:
        return "price_change"
    if row.stage == "match" and stage == "near_miss":
        return "upgraded"
    return "relisted" if AS_OF - at > timedelta(days=14) else None


def score(row):
    total = 0.0
    for d in DESTINATIONS:
        walk = (row.commute or {}).get(d.name)
        total += d.score_weight * (0 if walk is None else max(0, 1 - walk / 40))
    age = (AS_OF - row.created_at).total_seconds() / 3600
    return total + 0.1 * min(1, row.m2 / 80) + 0.1 * max(0, 1 - age / 240) + 0.1 * bool(row.elevator)


def test_clusters_cards_and_stamps(run):
    inputs, cfg, out = run
    clustered = out.clustered.collect()
    assert len(clustered) > 100
    as_row = lambda r: (r.seq, r.code, r.lat, r.lng, r.m2, r.price_eur, r.title)
    assert {r.seq: r.cluster_id for r in clustered} == first_fit([as_row(r) for r in clustered])
    assert len({r.cluster_id for r in clustered}) < len(clustered)

    hidden_keys = {r.listing_key for r in inputs.skipped.collect()}
    hidden = [as_row(r) for r in inputs.listings.collect() if r.listing_key in hidden_keys and r.seq % 7]
    blind = lambda r: (r[0], r[1], None, None, *r[4:])
    assert not any(same_flat(as_row(r), blind(x)) for r in clustered for x in hidden)

    best = canonical_rows(clustered)
    known = {r.listing_key: (r.notified_at, r.notified_price, r.notified_stage) for r in inputs.snapshot.collect()}
    sent = [r for r in best if reason(r, known) is not None]
    tier = lambda r: 1 if r.pets_allowed or (r.extraction and r.extraction.pets_allowed == "yes") else 0
    order = sorted(sent, key=lambda r: (-tier(r), -score(r), r.seq))
    cards = [c for c in out.cards.orderBy("rank").collect() if c.section == "match"]
    assert [c.listing_key for c in cards] == [r.listing_key for r in order[:10]]
    assert [c.score for c in cards] == pytest.approx([score(r) for r in order[:10]])

    stamped = {r.listing_key for r in out.snapshot.filter(f"notified_at = timestamp '{AS_OF}' and notified_stage = 'match'").collect()}
    assert {r.listing_key for r in sent} <= stamped
    funnel = {r.stage: r.n for r in out.funnel.collect()}
    assert funnel["match"] == len(sent)


def canonical_rows(clustered):
    groups = {}
    for r in clustered:
        groups.setdefault(r.cluster_id, []).append(r)
    return [min(g, key=lambda r: (SOURCE_RANK[r.source], -r.created_at.timestamp(), r.seq)) for g in groups.values()]


def test_health_copies_and_overflow(run):
    inputs, cfg, out = run
    listed = Counter(r.source for r in inputs.listings.select("source").collect())
    assert {r.source: (r.n, r.error) for r in out.health.collect()} == {s: (listed[s], None) for s in inputs.sources}
    clustered = out.clustered.collect()
    best = canonical_rows(clustered)
    state = {r.listing_key: (r.notified_at, r.notified_price, r.notified_stage) for r in inputs.snapshot.collect()}
    dedup = out.dedup.first()
    assert dedup.phashed == sum(r.code is not None for r in clustered) and dedup.clusters == len(best)
    assert dedup.suppressed == sum(reason(r, state) is None for r in best)
    sent = {r.stage: r.n for r in out.funnel.collect()}
    assert {r.section: r.overflow for r in out.overflow.collect()} == {
        s: max(0, sent[s] - k) for s, k in (("match", cfg.top_matches), ("near_miss", cfg.top_near)) if s in sent
    }


def test_detail_texts_reach_the_facts(spark, run):
    """Rows of one source that say nothing about pets take their full text; others keep theirs."""
    inputs, cfg, _ = run
    details = inputs.listings.select("listing_key", F.lit("x" * 500 + " samo studenti").alias("detail"))
    gated = digest.gate_candidates(replace(inputs, detail_texts=details), cfg, AS_OF)
    rows = gated.candidates.select("source", "pets_allowed", F.array_contains("extraction.red_flags", "students only").alias("flag")).collect()
    upgraded = [r.flag for r in rows if r.source == "4zida" and r.pets_allowed is None]
    assert upgraded and all(upgraded)
    plain = digest.gate_candidates(inputs, cfg, AS_OF).candidates
    flags = {r.listing_key: r.description for r in plain.filter("source <> '4zida'").select("listing_key", "description").collect()}
    kept = {r.listing_key: r.description for r in gated.candidates.filter("source <> '4zida'").select("listing_key", "description").collect()}
    assert kept == flags


def test_instant_mode_sends_only_rows_never_sent(run):
    inputs, cfg, out = run
    best = canonical_rows(out.clustered.collect())
    known = {r.listing_key for r in inputs.snapshot.filter("notified_at is not null").collect()}
    instant = digest.run_digest(inputs, cfg, AS_OF, mode="instant")
    cards = instant.cards.collect()
    sent = {c.listing_key for c in cards if c.section == "match"}
    assert sent == {r.listing_key for r in best} - known and sent
    assert not {c.listing_key for c in cards if c.section == "near_miss"} & known
    stamped = instant.snapshot.filter(f"notified_at = timestamp '{AS_OF}' and notified_stage = 'match'")
    assert {r.listing_key for r in stamped.collect()} >= {r.listing_key for r in best}


def test_second_run_calls_nothing_and_sends_nothing(spark, run):
    inputs, cfg, out = run
    def never(rows):
        assert len(rows) == 0, "cached rows must not be asked again"
        return rows

    def no_walks(requests):
        assert requests.filter("lat is not null").isEmpty()
        return requests.selectExpr("grid_key", "1 as walk_min").limit(0)

    again = digest.DigestInputs(
        inputs.listings, out.snapshot, inputs.skipped, out.extraction_cache, out.walk_cache, no_walks, DESTINATIONS,
        enrich_fn=never, enrich_is_column=False,
    )
    second = digest.run_digest(again, cfg, AS_OF)
    assert second.failures.isEmpty()
    resent = {r.listing_key for r in second.cards.filter("section = 'match'").collect()}
    first = {r.listing_key for r in out.cards.filter("section = 'match'").collect()}
    assert not resent & first


def test_a_run_starts_from_what_the_last_one_stored(spark, run, tmp_path):
    """What was sent isn't sent again; a version that a writer left unfinished is not read."""
    inputs, cfg, out = run
    folder = str(tmp_path / "state")
    assert digest.stored_state(spark, folder) == {}
    digest.store_run(out, folder, "2026-06-01")
    held = digest.stored_state(spark, folder)
    assert held.keys() == set(digest.STORED) and held["snapshot"].count() == out.snapshot.count()
    (tmp_path / "state" / "snapshot" / "version=9").mkdir()
    again = replace(inputs, **digest.stored_state(spark, folder))
    second = digest.run_digest(again, cfg, AS_OF)
    assert out.cards.count() > 0 and second.cards.count() == 0
    digest.store_run(second, folder, "2026-06-02")
    dates = {r.run_date for r in spark.read.parquet(f"{folder}/cards").selectExpr("cast(run_date as string) as run_date").distinct().collect()}
    assert dates == {"2026-06-01"} and digest.stored_state(spark, folder)["snapshot"].count() == held["snapshot"].count()

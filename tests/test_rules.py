"""Boundary cases of the rule cascades, ranking and notification."""

from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from nestfold import schema
from nestfold.config import Destination, FilterConfig
from nestfold.operators import distance, notify, rank, rules, state
from tests.conftest import AS_OF

CFG = FilterConfig(
    price_eur_max=1000, surface_m2_min=55, elevator_required=True, dishwasher_required=True,
)

BASE = dict(
    seq=1, listing_key="4zida:x", source="4zida", price_eur=900.0, m2=60.0, rooms=2.0, floor=3, elevator=True,
    furnished="yes", heating_type="district", pets_allowed=None, dishwasher=True, image_url="http://x/1.jpg",
    created_at=AS_OF - timedelta(days=1), extraction=None, commute={}, lat=None, lng=None, address=None, place_names=[],
)
SCHEMA = (
    "seq long, listing_key string, source string, price_eur double, m2 double, rooms double, floor int, elevator boolean,"
    "furnished string, heating_type string, pets_allowed boolean, dishwasher boolean, image_url string, created_at timestamp,"
    f"extraction {schema.EXTRACTION.simpleString()}, commute map<string,int>, lat double, lng double, address string, place_names array<string>"
)
FACTS = dict.fromkeys(f.name for f in schema.EXTRACTION.fields)


def rows(spark, *changes):
    data = [{**BASE, "seq": i, "listing_key": f"4zida:{i}", **c} for i, c in enumerate(changes)]
    return spark.createDataFrame([tuple(r[f] for f in BASE) for r in data], SCHEMA)


def column(df, name):
    return [r[0] for r in df.orderBy("seq").select(name).collect()]


def test_structural_boundaries(spark):
    cases = [
        ({}, None),
        ({"price_eur": 1000.0}, None),
        ({"price_eur": 1000.5}, "price"),
        ({"price_eur": 0.0}, "price"),
        ({"rooms": 1.5}, None),
        ({"rooms": 3.5}, "rooms"),
        ({"m2": 54.9}, "surface"),
        ({"floor": None}, "floor_unknown"),
        ({"floor": -1}, "basement"),
        ({"floor": 0, "elevator": False}, None),
        ({"floor": 1, "elevator": False}, "elevator"),
        ({"elevator": None}, None),
        ({"created_at": AS_OF - timedelta(days=7)}, None),
        ({"created_at": AS_OF - timedelta(days=7, seconds=1)}, "age"),
        ({"image_url": " \t"}, "photo"),
        ({"image_url": None}, "photo"),
        ({"price_eur": 0.0, "rooms": 9.0}, "price"),
    ]
    out = rules.structural_filter(rows(spark, *[c for c, _ in cases]), CFG, AS_OF)
    assert column(out, "rule_id") == [want for _, want in cases]


def test_facts_verdicts(spark):
    said = lambda **kw: tuple({**FACTS, **kw}.values())
    cases = [
        ({}, "passed"),
        ({"pets_allowed": False}, "rejected"),
        ({"pets_allowed": True, "extraction": said(pets_allowed="no")}, "passed"),
        ({"extraction": said(pets_allowed="no")}, "rejected"),
        ({"dishwasher": False}, "near_miss"),
        ({"dishwasher": False, "extraction": said(dishwasher=False)}, "rejected"),
        ({"heating_type": "TAPEC"}, "rejected"),
        ({"heating_type": "?"}, "near_miss"),
        ({"heating_type": None, "extraction": said(heating_type_confirmed="ta")}, "rejected"),
        ({"furnished": None, "extraction": said(furnishing_confirmed="semi-furnished")}, "passed"),
        ({"furnished": "prazan"}, "rejected"),
        ({"extraction": said(max_lease_months=12)}, "passed"),
        ({"extraction": said(max_lease_months=13)}, "rejected"),
    ]
    out = rules.facts_filter(rows(spark, *[c for c, _ in cases]), CFG)
    assert column(out, "verdict") == [want for _, want in cases]
    both = rules.facts_filter(rows(spark, {"dishwasher": None, "heating_type": None, "furnished": ""}), CFG)
    assert column(both, "soft") == [["dishwasher unclear", "heating unclear", "furnishing unclear"]]


def test_commute_gate_boundaries(spark):
    cases = [
        ({"office": 40}, None),
        ({"office": 41}, "office 41m > 40m walk"),
        ({"office": None}, "no walking route to office"),
        ({}, "no walking route to office"),
        ({"office": 10, "park": 90}, None),
    ]
    df = rows(spark, *[{"commute": c} for c, _ in cases])
    assert column(rules.commute_gate(df, ["office"], 40), "gate_reason") == [w for _, w in cases]
    assert column(rules.commute_gate(df, [], 40), "gate_reason") == [None] * len(cases)


def test_score_invariants(spark):
    dests = [Destination("office", 0, 0, True, 0.45), Destination("park", 0, 0, False, 0.25)]
    df = rows(
        spark,
        {"commute": {"office": 45}},
        {"commute": {"office": 60}},
        {"commute": {"office": 45}, "elevator": False},
        {"commute": {"office": 45}, "elevator": None},
        {"commute": {"office": 45}, "price_eur": 1.0},
        {"commute": {"office": 0, "park": 0}, "m2": 500.0, "created_at": AS_OF},
        {"commute": {}, "pets_allowed": True, "elevator": None},
    )
    ranked = rank.rank_listings(df, dests, 7, AS_OF)
    s = column(ranked, "score")
    assert s[0] == s[1] == s[4] and s[2] == s[3] < s[0]
    assert s[5] == pytest.approx(1.0)
    best, rest = rank.digest_topk(ranked, 3)
    assert [r.seq for r in best.orderBy("rank").collect()] == [6, 5, 0]
    assert rest.first().overflow == 4


def test_notify_reasons(spark):
    df = rows(spark, *[{"price_eur": p} for p in (900.0, 800.0, 970.0, 1010.0, 1000.0, 1000.0, 1000.0, 1000.0)])
    df = df.withColumn("stage", F.lit("match"))
    day = timedelta(days=1)
    stored = [
        ("4zida:1", AS_OF - day, 1000.0, "match"),
        ("4zida:2", AS_OF - day, 1000.0, "match"),
        ("4zida:3", AS_OF - day, 1000.0, "match"),
        ("4zida:4", AS_OF - day, 1000.0, "near_miss"),
        ("4zida:5", AS_OF - 15 * day, 1000.0, "match"),
        ("4zida:6", AS_OF - 14 * day, 1000.0, "match"),
        ("4zida:7", AS_OF - 20 * day, None, "match"),
    ]
    known = spark.createDataFrame(
        stored, "listing_key string, notified_at timestamp, notified_price double, notified_stage string"
    )
    out = notify.notify_reason(df, known, AS_OF)
    assert column(out, "notify_reason") == [
        "new", "price_drop", "price_change", "price_change", "upgraded", "relisted", None, "relisted",
    ]
    assert notify.renotify_gate(out).count() == 7
    assert notify.renotify_gate(out, force=True).count() == 8


def test_walks_share_a_cell_and_negative_answers_are_kept(spark):
    office = Destination("office", 44.80, 20.46, True, 1.0)
    df = rows(
        spark,
        {"lat": 44.8101, "lng": 20.4601},
        {"lat": 44.81012, "lng": 20.46012},
        {"lat": 45.9, "lng": 20.46},
        {"lat": 44.8131, "lng": 20.4601},
        {"address": "Ulica 1"},
        {"lat": 44.79, "lng": 20.45},
    )
    cache = spark.createDataFrame(
        [("44.79,20.45@office", None, AS_OF - timedelta(days=89)), ("44.81,20.46@office", 3, AS_OF - timedelta(days=90))],
        "grid_key string, walk_min int, fetched_at timestamp",
    )
    asked = []

    def provider(requests):
        asked.append(requests.count())
        return requests.filter("lat is not null").select("grid_key", F.lit(12).alias("walk_min"))

    walks, kept = distance.resolve_walk(df, [office], cache, provider, AS_OF)
    got = {int(r.listing_key[6:]): (r.walk_min, r.walk_source) for r in walks.collect()}
    assert asked == [3]
    assert got == {
        0: (12, "provider"), 1: (12, "provider"), 2: (None, "too_far"), 3: (12, "provider"), 4: (None, None), 5: (None, "cache"),
    }
    stored = {r.grid_key: r.walk_min for r in kept.collect()}
    assert stored["45.9,20.46@office"] is None and stored["44.81,20.46@office"] == 12
    assert not any(k.startswith("addr:") for k in stored)
    commute = {r.listing_key: r.commute for r in distance.commute_map(walks).collect()}
    assert commute["4zida:4"] == {} and commute["4zida:5"] == {"office": None}


def test_snapshot_merge_keeps_and_overwrites(spark):
    snap = spark.createDataFrame(
        [("a", 1.0, AS_OF - timedelta(days=9), AS_OF - timedelta(days=9), 5.0), ("b", 2.0, AS_OF, AS_OF, None)],
        "k string, price double, first_seen_at timestamp, last_seen_at timestamp, notified_price double",
    )
    batch = spark.createDataFrame([("a", 3.0, 1), ("a", 4.0, 2), ("c", 9.0, 3)], "k string, price double, seq int")
    later = AS_OF + timedelta(days=1)
    out = {r.k: r for r in state.upsert_snapshot(snap, batch, "k", ["price"], "seq", later).collect()}
    assert (out["a"].price, out["a"].notified_price, out["a"].first_seen_at) == (4.0, 5.0, AS_OF - timedelta(days=9))
    assert out["a"].last_seen_at == later and out["b"].last_seen_at == AS_OF
    assert out["c"].first_seen_at == later
    assert set(r.k for r in state.upsert_snapshot(snap, batch, "k", ["price"], "seq", insert=False).collect()) == {"a", "b"}


def test_versions_never_touch_what_is_read(spark, tmp_path):
    store = state.VersionedTable(spark, str(tmp_path / "t"))
    assert store.read() is None
    one = store.write(spark.range(3).toDF("k"))
    two = store.write(one.filter("k > 0"))
    (tmp_path / "t" / "version=3").mkdir()
    assert one.count() == 3 and two.count() == 2 and store.read().count() == 2
    assert store.write(spark.range(1)).count() == 1 and store._versions(True)[-1] == 4


def test_digest_write_replaces_only_its_date(spark, tmp_path):
    path = str(tmp_path / "digest")
    state.write_digest(spark.range(3), path, "2026-06-01")
    state.write_digest(spark.range(5), path, "2026-06-02")
    state.write_digest(spark.range(1), path, "2026-06-02")
    got = {r.d: r.n for r in spark.read.parquet(path).groupBy(F.col("run_date").cast("string").alias("d")).agg(F.count("*").alias("n")).collect()}
    assert got == {"2026-06-01": 3, "2026-06-02": 1}


def test_config_defaults_of_a_sparse_document():
    cfg = FilterConfig.from_dict(
        {"filters": {"price_eur_max": 1000, "rooms_min": 1, "rooms_max": 3, "surface_m2_min": 50, "elevator_required": False, "freshness_days": 7}}
    )
    assert cfg.photo_required and not cfg.pets_required and cfg.heating_allowed == () and cfg.walk_min_max == 40


def test_destination_tables_are_read_like_configuration(spark, monkeypatch):
    rows = spark.createDataFrame(
        [("park", 1.0, 2.0, False, 0.1), ("office", 3.0, 4.0, True, 0.5), ("gym", 1.5, 2.0, False, 0.0)],
        "name string, lat double, lng double, gates boolean, score_weight double",
    )
    found = distance.load_destinations(rows)
    assert found[1:] == [Destination("office", 3.0, 4.0, True, 0.5), Destination("park", 1.0, 2.0, False, 0.1)]
    listing = spark.createDataFrame([("a", 1.0, 2.0)], "listing_key string, lat double, lng double")
    whole = distance.per_destination(listing, found).collect()
    monkeypatch.setattr(distance, "LITERAL_DESTINATIONS", 2)
    assert sorted(distance.per_destination(listing, found).collect()) == sorted(whole)
    assert [r.dest for r in sorted(whole, key=lambda r: r.dest_ord)] == ["gym", "office", "park"]
    assert distance.per_destination(listing, []).collect() == []

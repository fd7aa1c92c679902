"""Captured pages, click logs, the outbox, the walk cache and the bucketed snapshot: whole results over restarts."""

import json
import time
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from nestfold.operators import enrich, snapshot, state
from nestfold.session import cut
from nestfold.sources import captured, feed
from nestfold.streaming import feedback, outbox, walks

T0 = datetime(2026, 5, 1)


# Pages.


def capture(folder, pages):
    """``pages``: (source, page) -> rows."""
    for (source, page), rows in pages.items():
        at = folder / f"source={source}" / f"page={page}"
        at.mkdir(parents=True)
        half = len(rows) // 2
        for k, part in enumerate((rows[:half], rows[half:])):
            (at / f"part-{k}.json").write_text("".join(json.dumps(r) + "\n" for r in part))


def page_rows(source, page, n, stale=False, last=False):
    return [{"id": f"{source}{page}{k}", "posted": "2026-04-0%d" % (1 + k % 9) if stale or k % 3 else "2026-05-10", "last": last} for k in range(n)]


PAGES = {("a", p): page_rows("a", p, 6, stale=p == 3) for p in range(1, 7)}
PAGES |= {("b", p): page_rows("b", p, 4, last=p == 2) for p in range(1, 5)}
PAGES |= {("c", p): page_rows("c", p, 5) for p in (1, 2, 4)} | {("d", 2): page_rows("d", 2, 3), ("e", 1): []}


def test_pages_equal_the_early_stop(spark, tmp_path):
    capture(tmp_path, PAGES)
    captured.register(spark)
    read = lambda **more: spark.read.format("captured_pages").options(path=str(tmp_path), fresh_field="posted", fresh_since="2026-05-01", last_field="last", **more).load()
    rows = [(s, p, r["id"], r["posted"], r["last"]) for (s, p), rs in PAGES.items() for r in rs]
    df = spark.createDataFrame(rows, "source string, page int, id string, posted string, last boolean")
    for most in (None, 1):
        want = feed.page_early_stop(df, "source", "page", F.col("posted") >= "2026-05-01", F.col("last"), most)
        got = read(**({"max_page": str(most)} if most else {})).select("source", "page", F.get_json_object("payload", "$.id").alias("id"))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select("source", "page", "id").collect()))
    assert read().rdd.getNumPartitions() == 5


def test_no_page_behind_the_stop_is_opened(tmp_path, monkeypatch):
    capture(tmp_path, PAGES)
    opened = []
    lines = captured._lines
    monkeypatch.setattr(captured, "_lines", lambda files, path: opened.append(path) or lines(files, path))
    reader = captured.PagesReader({"path": str(tmp_path), "fresh_field": "posted", "fresh_since": "2026-05-01", "last_field": "last"})
    for part in reader.partitions():
        list(reader.read(part))
    pages = {tuple(p.split("/")[-3:-1]) for p in opened}
    assert pages == {(f"source={s}", f"page={p}") for s, p in [("a", 1), ("a", 2), ("a", 3), ("b", 1), ("b", 2), ("c", 1), ("c", 2), ("e", 1)]}


def test_pages_may_share_folders(spark, tmp_path):
    capture(tmp_path / "single", PAGES)
    rows = [(s, p, json.dumps(r)) for (s, p), rs in PAGES.items() for r in rs]
    for (s, p), rs in PAGES.items():
        folder = tmp_path / "shared" / f"source={s}" / f"pages={p - (p - 1) % 3}-{p - (p - 1) % 3 + 2}"
        folder.mkdir(parents=True, exist_ok=True)
        for k, r in enumerate(rs):
            with open(folder / f"part-{k % 2}.json", "a") as out:
                out.write(json.dumps(r | {"page": p}) + "\n")
    options = {"fresh_field": "posted", "fresh_since": "2026-05-01", "last_field": "last"}
    for more in ({}, {"max_page": "1"}):
        read = [captured.PagesReader(options | more | {"path": str(tmp_path / n), "span": span}) for n, span in (("single", "1"), ("shared", "3"))]
        one, other = ([(s, p, json.loads(line)["id"]) for part in r.partitions() for s, p, line in r.read(part)] for r in read)
        assert sorted(one) == sorted(other) and one
    assert len(rows) > len(one)


def test_captured_pages_are_few_files_in_page_order(spark, tmp_path, monkeypatch):
    from nestfold.catalog import listing_queries

    spark.range(0, 60_000).selectExpr("id as o_orderkey").coalesce(2).write.parquet(str(tmp_path / "orders.parquet"))
    folder = tmp_path / "pages"
    monkeypatch.setattr(listing_queries, "work_folder", lambda spark, name: str(folder))
    found = listing_queries.captured_pages(spark, str(tmp_path)).collect()
    assert found and len(found) == len({r.seq for r in found})
    files = list(folder.rglob("part-*.json"))
    assert len(files) == 8  # two spans of 1,000 pages for each of four sources
    for f in files:
        pages = [json.loads(line)["page"] for line in f.read_text().splitlines()]
        assert pages == sorted(pages) and len(pages) >= 1_000


def test_a_task_widens_a_bounded_number_of_rows(spark, tmp_path, monkeypatch):
    from nestfold.catalog import rigs

    spark.range(0, 20_000).selectExpr("id as o_orderkey").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    monkeypatch.setattr(rigs, "ROWS_A_TASK", 1_000)
    table = rigs.table(spark, str(tmp_path), "orders")
    assert table.rdd.getNumPartitions() == 20 and table.distinct().count() == 20_000


# Click logs.


def log(folder, first, last):
    folder.mkdir(exist_ok=True)
    lines = [json.dumps({"update_id": k, "ts": f"2026-05-01T00:{k % 60:02d}:00Z", "user_id": k % 7, "data": f"skip:{k % 5}"}) for k in range(first, last + 1)]
    (folder / f"updates-{first:06d}-{last:06d}.json").write_text("\n".join(lines) + "\n")


def test_a_click_log_goes_on_where_it_was_committed(spark, tmp_path):
    src, out, cp = tmp_path / "log", str(tmp_path / "out"), str(tmp_path / "cp")
    captured.register(spark)
    clicks = lambda: spark.readStream.format("click_log").option("path", str(src)).load()

    def drain():
        query = clicks().select("update_id", "data").writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).start()
        query.processAllAvailable()
        query.stop()
        return sorted(r.update_id for r in spark.read.parquet(out).collect())

    log(src, 0, 9)
    log(src, 10, 14)
    assert drain() == list(range(15))
    log(src, 12, 30)  # sent again in part, as an unconfirmed answer is
    assert drain() == list(range(31))
    assert drain() == list(range(31))
    assert captured.confirmed(str(src)) in (15, 31)  # an offset is confirmed when the next batch starts


def test_offsets_of_a_click_log(tmp_path):
    log(tmp_path / "log", 5, 9)
    log(tmp_path / "log", 10, 20)
    reader = captured.ClickLogReader({"path": str(tmp_path / "log")})
    assert reader.initialOffset() == {"next": 0} and reader.latestOffset() == {"next": 21}
    parts = reader.partitions({"next": 8}, {"next": 10})
    assert [r[0] for p in parts for r in reader.read(p)] == [8, 9] and len(parts) == 1
    reader.commit({"next": 10})
    assert captured.confirmed(str(tmp_path / "log")) == 10 and captured.confirmed(str(tmp_path)) == 0


# The outbox.


def test_a_batch_killed_between_tasks_shows_nothing(spark, tmp_path):
    import pyarrow as pa

    writer = outbox.OutboxWriter({"path": str(tmp_path)})
    batch = lambda *keys: iter([pa.RecordBatch.from_pydict({"listing_key": list(keys), "price_eur": [1.0] * len(keys), "stage": ["match"] * len(keys)})])
    read = lambda: sorted((r.listing_key, r.batch_id) for r in feedback.read_outbox(spark, str(tmp_path)).collect())
    one = [writer.write(batch("a", "b")), writer.write(iter([])), None]
    assert read() == []  # tasks wrote, the batch isn't committed
    writer.commit(one, 0)
    assert read() == [("a", 0), ("b", 0)]
    lost = writer.write(batch("c"))  # a task's file of a batch that dies here
    assert read() == [("a", 0), ("b", 0)] and lost.rows == 1
    again = [writer.write(batch("c", "d"))]
    writer.commit(again, 1)
    assert read() == [("a", 0), ("b", 0), ("c", 1), ("d", 1)]
    writer.commit([writer.write(batch("c", "d"))], 1)  # a replay of a committed batch
    writer.abort([writer.write(batch("e"))], 2)
    assert read() == [("a", 0), ("b", 0), ("c", 1), ("d", 1)]
    assert len(list((tmp_path / "parts").iterdir())) == 3


# The walk cache.

ASKED = "grid_key string, at timestamp, ask_id long, walk_min int"


def test_the_walk_cache_expires_as_the_table_does(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    answers = [("g1", T0, None, 7), ("g2", T0 - timedelta(days=80), None, 9), ("g3", T0 - timedelta(days=90), None, 3), ("g4", T0, None, None), ("g1", T0 - timedelta(days=100), None, 1)]
    later = [("g2", T0 + timedelta(days=1), None, 10)]
    asks = [(f"g{k}", T0 + timedelta(days=d), 100 * n + k, None) for n, d in enumerate((0, 5, 9, 10, 11, 89, 90, 95)) for k in range(1, 6)]

    def batch(rows):
        spark.createDataFrame(rows, ASKED).coalesce(1).write.mode("append").parquet(src)
        walks.walk_stream(spark.readStream.schema(ASKED).parquet(src), out, cp, True).awaitTermination()

    def looked(ids):
        return {r.ask_id: (r.hit, r.walk_min) for r in spark.read.parquet(out).collect() if r.ask_id in ids}

    def by_table(rows, cache):
        cache = spark.createDataFrame([(k, w, at) for k, at, _, w in cache], "grid_key string, walk_min int, fetched_at timestamp")
        newest = state.last_per_key(cache, "grid_key", "fetched_at", ["walk_min", "fetched_at"])
        want = {}
        for at in {r[1] for r in rows}:
            some = spark.createDataFrame([r for r in rows if r[1] == at], ASKED).drop("walk_min")
            want |= {r.ask_id: (r.hit, r.walk_min) for r in state.ttl_cache_lookup(some, newest, "grid_key", "walk_min", "fetched_at", 90, at).collect()}
        return want

    batch(answers)
    batch(asks)  # each batch is a restart of the query
    assert looked({a[2] for a in asks}) == by_table(asks, answers)
    batch(later)
    again = [(k, at, 10_000 + n, w) for k, at, n, w in asks if at >= T0 + timedelta(days=5)]
    batch(again)
    assert looked({a[2] for a in again}) == by_table(again, [a for a in answers if a[0] != "g2"] + later)


def test_the_state_store_drops_old_walks(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))

    def batch(rows):
        spark.createDataFrame(rows, ASKED).coalesce(1).write.mode("append").parquet(src)
        walks.walk_stream(spark.readStream.schema(ASKED).parquet(src), out, cp, True, state_ttl_ms=60_000 if rows[0][0] == "g1" else 1).awaitTermination()

    batch([("g2", T0, None, 4)])
    time.sleep(0.1)
    batch([("g2", T0, 1, None)])
    assert [(r.ask_id, r.hit) for r in spark.read.parquet(out).collect()] == [(1, False)]


# The bucketed snapshot.

ROWS = "k string, price double, code long, first_seen_at timestamp, last_seen_at timestamp"


def test_a_small_batch_writes_its_buckets_only(spark, tmp_path):
    table = snapshot.BucketedSnapshot(spark, str(tmp_path / "t"), "k", ROWS, buckets=16)
    plain = spark.createDataFrame([], ROWS)
    frame = lambda rows: spark.createDataFrame(rows, "k string, price double, code long, seq long")
    first = frame([(f"k{n}", float(n), None, n) for n in range(200)])
    batches = [(first, ["price"], True), (frame([("k3", 1.5, None, 1), ("k3", 2.5, None, 2), ("new", 9.0, None, 3), (None, 1.0, None, 4)]), ["price"], True), (frame([("k7", 0.0, 77, 1), ("gone", 0.0, 78, 2)]), ["code"], False)]
    for n, (batch, cols, insert) in enumerate(batches):
        at = T0 + timedelta(days=n)
        version = table.merge(batch, cols, "seq", at, insert)
        plain = cut(state.upsert_snapshot(plain, batch.filter("k is not null"), "k", cols, "seq", at, insert))
        assert version == n + 1 == table.version()
        assert sorted(map(str, table.read().collect())) == sorted(map(str, plain.collect()))
    written = lambda v: {p.name for p in (tmp_path / "t" / "data" / f"version={v}").iterdir() if p.name.startswith("bucket=")}
    assert len(written(1)) == 16 and 1 <= len(written(2)) <= 2 and 1 <= len(written(3)) <= 2
    old = {r.k: r.price for r in table.read(1).collect()}
    assert old["k3"] == 3.0 and "new" not in old


def test_a_writer_that_dies_leaves_the_snapshot(spark, tmp_path):
    table = snapshot.BucketedSnapshot(spark, str(tmp_path / "t"), "k", "k string, price double", buckets=4)
    frame = lambda rows: spark.createDataFrame(rows, "k string, price double, seq long")
    assert table.read().collect() == []
    table.merge(frame([("a", 1.0, 1), ("b", 2.0, 1)]), ["price"], "seq")
    (tmp_path / "t" / "data" / "version=2" / "bucket=1").mkdir(parents=True)
    assert {r.k for r in table.read().collect()} == {"a", "b"}
    assert table.merge(frame([("a", 5.0, 1)]), ["price"], "seq") == 3
    assert {(r.k, r.price) for r in table.read().collect()} == {("a", 5.0), ("b", 2.0)}
    assert table.merge(frame([]), ["price"], "seq") == 4 and table.read().count() == 2


# One stop for the whole run.


def test_a_stop_in_one_task_holds_for_all(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def fn(rows: pd.DataFrame) -> pd.DataFrame:
        (calls / f"{time.time_ns()}-{len(rows)}").write_text("")
        time.sleep(0.05)
        if len(list(calls.iterdir())) >= 6:
            raise enrich.BudgetExhausted("no calls left")
        return pd.DataFrame({"key": rows["key"], "payload": '{"summary_en": "x"}'})

    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        df = spark.range(0, 800, 1, 8).select(F.col("id").cast("string").alias("listing_key"), F.concat(F.lit("text "), "id").alias("description"), F.col("id").alias("seq"))
        empty = spark.createDataFrame([], "listing_key string, payload string, desc_hash string, extracted_at timestamp")
        rows, _, failures = enrich.incremental_enrich(df, empty, fn, T0)
        answered = rows.filter("extraction is not null").count()
        made = len(list(calls.iterdir()))
        assert made <= 6 + 8  # at most the batch that each other task was at
        assert answered + failures.count() == 800 and {r.error for r in failures.collect()} == {"no calls left"}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


@pytest.mark.parametrize("text, months, bills", [("minimum 12000 meseci", 12000, None), ("računi 12000 din", None, 12000), ("bills: 1.200 eur", None, 1200), ("minimum 18 meseci, računi oko 90", 18, 90)])
def test_whole_numbers(spark, text, months, bills):
    f = spark.createDataFrame([(text,)], "t string").select(enrich.text_facts(F.col("t")).alias("f")).first().f
    assert (f.max_lease_months, f.bills_estimate_eur) == (months, bills)

"""Streams continue from their checkpoint and agree with their batch twins."""

import shutil
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F

from nestfold.catalog import state_queries
from nestfold.operators.state import toggle_fold
from nestfold.streaming import feedback

SCHEMA = "update_id long, ts timestamp, data string"
T0 = datetime(2026, 5, 1)


def clicks(spark, path, rows):
    data = [(i, T0 + timedelta(minutes=m), d) for i, m, d in rows]
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_skips_are_written_once_over_restarts(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    clicks(spark, src, [(1, 0, "skip:a"), (2, 1, "skip:a"), (3, 2, "what"), (4, 3, "fav:b"), (5, 4, "skip:c:d")])
    stream = lambda: spark.readStream.schema(SCHEMA).parquet(src)
    feedback.skip_stream(stream(), out, cp, True).awaitTermination()
    clicks(spark, src, [(6, 5, "skip:a"), (7, 6, "skip:e")])
    feedback.skip_stream(stream(), out, cp, True).awaitTermination()
    feedback.skip_stream(stream(), out, cp, True).awaitTermination()
    assert sorted(r.key for r in spark.read.parquet(out).collect()) == ["a", "c:d", "e"]


def test_favorites_over_restarts_equal_the_fold(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    first = [(1, 0, "fav:a"), (2, 5, "fav:a"), (3, 9, "unfav:b"), (4, 10, "fav:b"), (5, 11, "fav:c"), (6, 12, "unfav:c")]
    second = [(7, 100, "fav:a"), (8, 101, "unfav:b"), (9, 102, "fav:b"), (10, 103, "fav:b"), (11, 104, "fav:c"), (12, 4000, "fav:c")]
    stream = lambda: spark.readStream.schema(SCHEMA).parquet(src)
    for part in (first, second):
        clicks(spark, src, part)
        feedback.favorite_stream(stream(), out, cp, True, seq="update_id").awaitTermination()
    got = feedback.favorites_of(spark.read.parquet(out))
    want = toggle_fold(feedback.dispatched(spark.read.parquet(src)), "key", "kind", "ts", "update_id")
    have = {r.key: r.since for r in got.collect()}
    assert have == {r.key: r.since for r in want.collect()}
    assert have["a"] == T0 and have["b"] == T0 + timedelta(minutes=102) and have["c"] == T0 + timedelta(minutes=104)


def test_toggles_reduce_to_changes():
    rows = pd.DataFrame({"kind": list("fffuuufu"), "ts": range(8), "seq": range(8)})
    rows["kind"] = rows["kind"].map({"f": "fav", "u": "unfav"})
    assert feedback.reduce_toggles(rows)["ts"].tolist() == [0, 5, 6, 7]


def test_instant_rows_leave_once(spark, tmp_path):
    src, box, cp = (str(tmp_path / n) for n in ("in", "box", "cp"))
    stamps = "listing_key string, notified_at timestamp, notified_price double, notified_stage string"
    known = spark.createDataFrame([("old", T0, 1.0, "match"), ("n1", None, None, None), ("n2", None, None, None)], stamps)
    schema = "listing_key string, price_eur double, stage string, seq long"
    for rows in ([("old", 5.0, "match", 1), ("n1", 6.0, "match", 2), ("n1", 7.0, "match", 3)], [("n1", 6.0, "match", 4), ("n2", 8.0, "near_miss", 5)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        feedback.instant_stream(stream, known, box, cp, True).awaitTermination()
    sent = feedback.read_outbox(spark, box)
    assert {(r.listing_key, r.price_eur, r.batch_id) for r in sent.collect()} == {("n1", 6.0, 0), ("n2", 8.0, 1)}
    folded = {r.listing_key: (r.notified_price, r.notified_stage) for r in feedback.fold_outbox(known, sent, T0).collect()}
    assert folded == {"old": (1.0, "match"), "n1": (6.0, "match"), "n2": (8.0, "near_miss")}


def instants(spark, tmp_path, box, cp, rows=(), known=(("old",),)):
    """Runs the stream over the rows so far and ``rows``; its query, and what left in which batch."""
    schema, src = "listing_key string, price_eur double, stage string, seq long", str(tmp_path / "in")
    if rows:
        spark.createDataFrame(list(rows), schema).repartition(3).coalesce(1).write.mode("append").parquet(src)
    old = spark.createDataFrame(list(known), "listing_key string").withColumn("notified_at", F.lit(T0))
    query = feedback.instant_stream(spark.readStream.schema(schema).parquet(src), old, box, cp, True)
    query.awaitTermination()
    return query, sorted(tuple(r) for r in feedback.read_outbox(spark, box).select("batch_id", "listing_key", "price_eur", "stage").fillna("-", ["listing_key"]).collect())


def test_instant_state_calls_no_function_for_a_key(spark, tmp_path):
    rows = [(f"k{n % 5000}", float(n), "match", n) for n in reversed(range(15000))] + [("old", 1.0, "match", -1)]
    query, sent = instants(spark, tmp_path, str(tmp_path / "box"), str(tmp_path / "cp"), rows)
    assert sent == sorted((0, f"k{n}", float(n), "match") for n in range(5000))
    assert [s["operatorName"] for p in query.recentProgress for s in p["stateOperators"]] == ["stateStoreSave"]


def test_instant_rows_leave_once_whatever_their_number(spark, tmp_path):
    box, cp = str(tmp_path / "box"), str(tmp_path / "cp")
    first = [("a", 5.0, "match", 9), ("a", 4.0, "match", 12), ("b", 6.0, "match", None), ("b", 7.0, "near_miss", 8), ("c", None, "match", 1), ("c", 3.0, "match", 2), (None, 2.0, "match", 4), ("old", 1.0, "match", 1), ("u", 8.0, None, None)]
    sent = [(0, "-", 2.0, "match"), (0, "a", 5.0, "match"), (0, "b", 7.0, "near_miss"), (0, "c", None, "match"), (0, "u", 8.0, None)]
    assert instants(spark, tmp_path, box, cp, first)[1] == sent
    # Numbers below those that left, and keys that left again, in two more batches.
    for batch, new in ((1, "d"), (2, "e")):
        sent.append((batch, new, 1.0, "match"))
        again = [(k, 0.5, "match", -batch) for k in ("a", "b", "c", "d", None, "old", "u") if k != new]
        assert instants(spark, tmp_path, box, cp, again[: 3 if batch == 1 else None] + [(new, 1.0, "match", 3)])[1] == sent


def test_a_batch_whose_end_was_not_noted_leaves_once(spark, tmp_path):
    box, cp, kept = (str(tmp_path / n) for n in ("box", "cp", "kept"))
    instants(spark, tmp_path, box, cp, [("a", 1.0, "match", 1)])
    _, sent = instants(spark, tmp_path, box, cp, [("a", 0.0, "match", 0), ("b", 2.0, "match", 2)])
    shutil.copytree(cp, kept, ignore=lambda folder, names: [n for n in names if folder.endswith("commits") and n.strip(".").split(".")[0] == "1"])
    query, again = instants(spark, tmp_path, box, kept)
    assert [p["batchId"] for p in query.recentProgress] == [1]
    assert again == sent == [(0, "a", 1.0, "match"), (1, "b", 2.0, "match")]
    _, later = instants(spark, tmp_path, box, kept, [("a", 0.0, "match", 0), ("b", 0.0, "match", 0), ("c", 3.0, "match", 3)])
    assert later == [*sent, (2, "c", 3.0, "match")]
    assert len(list((tmp_path / "box" / "manifests").iterdir())) == 3


def test_posts_once_within_a_delay(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    schema = "channel string, message_id long, posted_at timestamp"
    rows = [("a", 1, T0), ("a", 1, T0), ("b", 1, T0), ("a", 2, T0)]
    spark.createDataFrame(rows, schema).write.parquet(src)
    stream = spark.readStream.schema(schema).parquet(src)
    feedback.post_stream(stream, out, cp, True, within="1 day").awaitTermination()
    assert spark.read.parquet(out).groupBy("channel").agg(F.count("*").alias("n")).count() == 2
    assert spark.read.parquet(out).count() == 3


def test_a_table_of_several_files_is_streamed(spark, tmp_path):
    rows = spark.createDataFrame([(k, "s%d" % (k % 3)) for k in range(900)], "doc_id long, source string")
    rows.repartition(3).write.parquet(str(tmp_path / "folder" / "documents.parquet"))
    rows.toPandas().to_parquet(tmp_path / "documents.parquet")
    want = sorted({("s%d" % (k % 3), k % 300) for k in range(900)})
    for d in (tmp_path / "folder", tmp_path):
        assert sorted(map(tuple, state_queries.post_stream(spark, str(d)).collect())) == want

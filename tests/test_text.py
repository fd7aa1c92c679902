"""Text, parsers and page readers on golden values."""

import html as stdlib_html
import json
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nestfold.functions import codes, geo, parse, text, vocab
from nestfold.operators.enrich import BudgetExhausted, answering, per_row
from nestfold.sources import html, json_ads
import pyarrow as pa


def over(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in df.select("i", fn(F.col("v"))).orderBy("i").collect()]


def test_floors(spark):
    got = over(spark, ["10 / -", "3/5", "PR / 4", "SU / 4", "", None], lambda c: parse.parse_floor(c, "listed"))
    assert [tuple(x) for x in got] == [(10, None), (3, 5), (0, 4), (-1, 4), (None, None), (None, None)]
    got = over(spark, ["VI/7", "XII/15", "PR/4", "SUT/4", "", "XXI/2"], lambda c: parse.parse_floor(c, "roman"))
    assert [tuple(x) for x in got] == [(6, 7), (12, 15), (0, 4), (-1, 4), (None, None), (None, 2)]
    got = over(spark, ["2_4", "PR", "SU", "10", "2_x", "5.0", None], lambda c: parse.parse_floor(c, "coded"))
    assert [tuple(x) for x in got] == [(2, 4), (0, None), (-1, None), (10, None), (None, None), (5, None), (None, None)]


def test_prices_rooms_durations(spark):
    assert over(spark, ["900", "1.000", "2.500", None, "x", "1 200"], parse.parse_price) == [900, 1000, 2500, 0, 0, 1200]
    assert over(spark, ["Dvosoban stan", "Trosoban", "Garsonjera", "kuća"], parse.rooms_from_text) == [2.0, 3.0, 0.5, None]
    assert over(spark, ["1800s", "90s", "150s", "x", None, "-30s"], parse.duration_minutes) == [30, 2, 2, None, None, 0]


def test_code_arrays(spark):
    heat = lambda c: vocab.priority_pick(c, vocab.HEATING_CODES, vocab.HEATING_PRIORITY)
    values = [["1"], ["4"], ["10"], ["21"], ["26"], ["99"], ["1", "4"], ["4", "4", "99"], ["12345"], ["bogus"], [], None]
    assert over(spark, values, heat, "array<string>") == [
        "centralno", "elektricni", "TA", "podno", "klima", "etazno", "centralno", "etazno", None, None, None, None,
    ]
    values = [["1", "2"], ["1"], [], None, ["bogus"]]
    assert over(spark, values, lambda c: vocab.code_present(c, 2), "array<string>") == [True, False, False, None, None]


def test_hashtags_are_whole_and_caseless(spark):
    values = ["x #аренда", "#АРЕНДА!", "#арендаквартиры", "аренда", "", None, "#аренда2"]
    assert over(spark, values, lambda c: text.has_hashtag(c, "#аренда")) == [True, True, False, False, False, False, False]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aZž 9²_-!&;#x\n\t é中😀", max_size=30), min_size=1, max_size=30))
def test_text_functions_equal_python(spark, values):
    def title(t):
        return re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", t.lower())).strip()

    assert over(spark, values, text.normalize_title) == [title(v) for v in values]
    assert over(spark, values, text.full_strip) == [v.strip() for v in values]


def test_references_are_resolved_once(spark):
    values = ["&amp;lt; &#269; &#x10D; &euro; &bogus; &#38;amp; a & b", "no reference", None, "&copy;&nbsp;&quot;"]
    assert over(spark, values, text.unescape) == [None if v is None else stdlib_html.unescape(v) for v in values]


def test_place_cells(spark):
    df = spark.createDataFrame(
        [(44.81001, 20.46, None), (44.81009, 20.46, None), (44.8131, 20.46, None), (None, 20.0, "Ulica 5"), (None, None, None)],
        "lat double, lng double, address string",
    )
    empty = F.array().cast("array<string>")
    key = geo.grid_key(F.col("lat"), F.col("lng"), F.col("address"), empty, F.lit("s:1"), F.lit("office"))
    got = [r[0] for r in df.select(key).collect()]
    assert got[0] == got[1] == "44.81,20.46@office" and got[2] != got[0]
    assert got[3].startswith("addr:") and len(got[3]) == len("addr:") + 16 + len("@office") and got[4] == "id:s:1@office"
    km = geo.haversine(F.lit(44.8125), F.lit(20.4612), F.lit(44.7866), F.lit(20.4489))
    assert 2.0 < df.select(km).first()[0] < 3.5


def test_hex_codes(spark):
    assert over(spark, ["ffffffffffffffff", "0000000000000001", "8000000000000000", "zz", None, "1"], codes.hex_to_code) == [
        -1, 1, -(2**63), None, None, None,
    ]


CHANNEL = """
<div class="wrap"><div class="tgme_widget_message" data-post="stan/101">
<a class="p" href="x" style="background-image:url('https://cdn.example/a.jpg')"></a>
<div class="tgme_widget_message_text js" dir="auto">Vra&#269;ar, 65m2, 800&euro;.<br/>Kontakt</div>
<time datetime="2026-05-17T09:30:00+00:00">9:30</time></div>
<div class="tgme_widget_message service_message" data-post="stan/102"><div class="f"></div></div>
<div class="tgme_widget_message" data-post="stan/103"><div class="tgme_widget_message_text">Text only</div></div>
<div class="tgme_widget_message" data-post="other/999"><div class="tgme_widget_message_text">No</div></div></div>"""


def test_channel_page(spark):
    df = spark.createDataFrame([("stan", CHANNEL)], "channel string, html string")
    posts = html.extract_posts(df).orderBy("message_id").collect()
    assert [p.message_id for p in posts] == [101, 103]
    assert posts[0].text == "Vračar, 65m2, 800€.\nKontakt" and posts[0].photo_urls == ["https://cdn.example/a.jpg"]
    assert str(posts[0].posted_at) == "2026-05-17 09:30:00" and posts[1].posted_at is None


def test_one_malformed_advert_leaves_the_others(spark):
    good = {"id": "1", "createdAt": "2026-05-16T11:32:07+00:00", "price": 900, "m2": 56, "roomCount": 2.5, "elevator": 2}
    ads = [good, {**good, "id": "2", "createdAt": "?"}, {**good, "id": "3", "price": "abc"}, {**good, "id": "4", "elevator": None}, {"id": "5"}]
    df = spark.createDataFrame([(json.dumps({"ads": ads, "total": 5}),), ("{broken",)], "payload string")
    out = {r.id: r for r in json_ads.normalize_json_a(df).collect()}
    assert set(out) == {"1", "4"} and out["1"].elevator and not out["4"].elevator
    assert out["1"].rooms == 2.5 and out["1"].title == "" and out["1"].place_names == []


def test_exhausted_budget_stops_calls_and_bad_rows_fail_alone():
    calls = []

    def call(text):
        calls.append(text)
        if text == "b":
            raise ValueError("bad")
        if text == "d":
            raise BudgetExhausted("cap")
        return "{}"

    batch = lambda ks: pa.RecordBatch.from_pydict({"id": list(ks), "t": list(ks), "more": [1] * len(ks)})
    out = list(answering(per_row(call), "id", "t")(iter([batch("abcde"), batch(""), batch("fg")])))
    assert out[0].schema.names == ["id", "t", "more", "payload", "error"]
    found = {k: e for b in out for k, e in zip(b.column("id").to_pylist(), b.column("error").to_pylist())}
    assert found == {"a": None, "b": "bad", "c": None, "d": "cap", "e": "cap", "f": "cap", "g": "cap"}
    assert calls == ["a", "b", "c", "d"]


def test_a_failing_batch_is_not_called_again():
    calls = []

    def fn(rows):
        calls.append(len(rows))
        raise RuntimeError("down")

    batch = pa.RecordBatch.from_pydict({"id": ["a", "b"], "t": ["x", "y"]})
    out = list(answering(fn, "id", "t")(iter([batch, batch])))
    assert [b.column("error").to_pylist() for b in out] == [["down"] * 2] * 2 and calls == [2, 2]

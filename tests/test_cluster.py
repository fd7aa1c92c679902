"""Matching and clustering against plain Python written from the definition."""

import random
import re
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pytest

from nestfold.operators import keyed, similarity
from nestfold.operators.cluster import cluster_flats, connected_components, first_fit_labels
from nestfold.operators.ratio import ratios

SCHEMA = "seq long, code long, lat double, lng double, m2 double, price_eur double, title string"


def norm(t):
    t = re.sub(r"[^\w\s]", " ", (t or "").lower())
    return re.sub(r"\s+", " ", t).strip()


def bits(a, b):
    return bin((a ^ b) & (2**64 - 1)).count("1")


def same_flat(a, b):
    """a arrives after b."""
    _, ca, la, ga, ma, pa, ta = a
    _, cb, lb, gb, mb, pb, tb = b
    if ca is not None and cb is not None and bits(ca, cb) <= 6:
        return True
    if la is not None and lb is not None and (round(la, 4), round(ga, 4)) == (round(lb, 4), round(gb, 4)):
        if abs(ma - mb) < 1 and pa // 50 == pb // 50:
            return True
    if pa > 0 and pb > 0 and abs(pa - pb) / max(pa, pb) <= 0.05:
        return SequenceMatcher(None, norm(ta), norm(tb)).ratio() >= 0.8
    return False


def first_fit(rows):
    clusters = []
    for r in sorted(rows):
        for c in clusters:
            if any(same_flat(r, m) for m in c):
                c.append(r)
                break
        else:
            clusters.append([r])
    return {r[0]: c[0][0] for c in clusters for r in c}


def random_rows(n, seed, copies=0.35):
    rng = random.Random(seed)
    words = ["dvosoban", "stan", "lux", "centar", "vračar", "nov", "uknjižen", "terasa", "60m²", "hitno!"]
    base_code = rng.getrandbits(64) - 2**63
    rows = []
    for seq in rng.sample(range(10 * n), n):
        if rows and rng.random() < copies:
            _, code, lat, lng, m2, price, title = rng.choice(rows)
            if rng.random() < 0.4:
                price = round(price * rng.uniform(0.93, 1.07))
            if rng.random() < 0.4 and title:
                title = title.replace(rng.choice(title), rng.choice("aeiou"), 1)
        else:
            code = rng.choice([None, rng.getrandbits(64) - 2**63, base_code])
            lat = rng.choice([None, 44.8 + rng.randrange(3) * 0.0004])
            lng = 20.4 + rng.randrange(2) * 0.0004
            m2 = rng.choice([40.0, 40.5, 41.2, 60.0, 60.9])
            price = float(rng.choice([0, 500, 510, 549, 551, 800, 830]))
            title = " ".join(rng.sample(words, rng.randrange(0, 6)))
        if code is not None and rng.random() < 0.6:
            for _ in range(rng.randrange(0, 5)):
                code = code ^ (1 << rng.randrange(63))
        rows.append((seq, code, lat, lng, m2, float(price), title))
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_cluster_flats_equals_first_fit(spark, seed):
    rows = random_rows(80, seed)
    df = spark.createDataFrame(rows, SCHEMA)
    edges = similarity.same_flat_edges(df)
    got = {r.seq: r.cluster_id for r in cluster_flats(df, edges).select("seq", "cluster_id").collect()}
    assert got == first_fit(rows)


def test_every_edge_is_a_match_and_layers_are_the_lowest(spark):
    rows = random_rows(60, 99)
    by_seq = {r[0]: r for r in rows}
    for e in similarity.same_flat_edges(spark.createDataFrame(rows, SCHEMA)).collect():
        assert e.later > e.earlier
        assert same_flat(by_seq[e.later], by_seq[e.earlier])


def test_bridge_joins_the_oldest_cluster_without_merging(spark):
    edges = spark.createDataFrame([(3, 1), (3, 2), (5, 2), (6, 5)], "later long, earlier long")
    got = {r.node: r.cluster_id for r in first_fit_labels(edges).collect()}
    assert got == {3: 1, 5: 2, 6: 2}
    parts = {r.node: r.component_id for r in connected_components(edges).collect()}
    assert parts == {n: 1 for n in (1, 2, 3, 5, 6)}


def test_copies_of_one_row_give_a_linear_number_of_edges(spark):
    n = 1500
    rows = [(i, 7, 44.8, 20.4, 50.0, 900.0, "isti stan") for i in range(n)]
    rows += [(n + i, 6, None, None, 50.0, 100.0, f"{i}") for i in range(5)]
    edges = similarity.same_flat_edges(spark.createDataFrame(rows, SCHEMA))
    assert edges.count() <= 2 * n
    labels = first_fit_labels(edges)
    assert labels.filter("cluster_id <> 0").count() == 0


def test_threads_cross_spans(spark, monkeypatch):
    monkeypatch.setattr(similarity, "SPAN", 4)
    rows = random_rows(70, 7)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.seq: r.cluster_id for r in cluster_flats(df, similarity.same_flat_edges(df)).collect()}
    assert got == first_fit(rows)


def test_small_tiles_find_the_same_titles(spark):
    df = spark.createDataFrame(random_rows(120, 5), SCHEMA)
    cols = ["later_title", "later_price", "earlier_title", "earlier_price"]
    whole = {tuple(r) for r in similarity.fuzzy_title_join(df).select(cols).collect()}
    tiled = {tuple(r) for r in similarity.fuzzy_title_join(df, tile_rows=3).select(cols).collect()}
    assert whole == tiled and whole


def led_to(rows, pairs):
    """Row -> all rows that it reaches through ever earlier matches; ``pairs`` says which entries match, later first."""
    entry = {r[0]: (norm(r[6]), r[5]) for r in rows if r[5] > 0}
    reach = {}
    for x in sorted(entry):
        reach[x] = set()
        for y in sorted(reach, reverse=True):
            if y < x and (entry[x] == entry[y] or (entry[x], entry[y]) in pairs):
                reach[x] |= {y} | reach[y]
    return reach


def title_pairs(df, **options):
    found = similarity.fuzzy_title_join(df, **options).collect()
    return {((r.later_title, r.later_price), (r.earlier_title, r.earlier_price)) for r in found}


@pytest.mark.parametrize("tile_rows", [3, 20, 4096])
def test_thin_links_lead_to_the_same_rows(spark, tile_rows):
    rows = random_rows(150, 12, copies=0.6)
    df = spark.createDataFrame(rows, SCHEMA)
    whole, thin = title_pairs(df), title_pairs(df, thin=True, tile_rows=tile_rows)
    assert thin <= whole
    assert led_to(rows, thin) == led_to(rows, whole)


@pytest.mark.parametrize("tile_rows", [60, 4096])
def test_a_clique_of_titles_leaves_a_linear_number_of_links(spark, tile_rows):
    rng = random.Random(8)
    base = "lep dvosoban stan na vračaru blizu parka sa terasom"
    n = 600
    titles = {base.replace(*rng.sample("abcdeijklnoprstuvz", 2), 1) + rng.choice("xyz") + str(k) for k in range(n)}
    df = spark.createDataFrame([(k, None, None, None, 50.0, 900.0, t) for k, t in enumerate(titles)], SCHEMA)
    chunks = -(-n // tile_rows)
    thin = similarity.fuzzy_title_join(df, thin=True, tile_rows=tile_rows).count()
    assert n - 1 <= thin <= 3 * n * chunks < n * n / 4
    edges = similarity.same_flat_edges(df)
    assert first_fit_labels(edges).filter("cluster_id <> 0").count() == 0


@pytest.mark.parametrize("tile_rows", [4, 4096])
def test_title_hits_equal_the_later_titles_of_all_pairs(spark, tile_rows):
    rows = random_rows(200, 21, copies=0.5)
    a, b = (spark.createDataFrame(rows[k::2], SCHEMA) for k in (0, 1))
    want = {x for x, _ in title_pairs(a, b=b)}
    got = similarity.fuzzy_title_hits(a, b, tile_rows=tile_rows).collect()
    assert {(r.title, r.price) for r in got} == want and want
    assert len(similarity.fuzzy_title_hits(a, b).collect()) == len(want)
    assert similarity.fuzzy_title_hits(a, b.limit(0)).collect() == [] == similarity.fuzzy_title_hits(a.limit(0), b).collect()


def test_a_hit_title_is_not_asked_for_again(monkeypatch):
    """All titles of a band alike: each left one is compared once, and nothing but hits comes back."""
    asked = []
    monkeypatch.setattr(similarity, "ratios", lambda a, b: asked.append(len(a)) or ratios(a, b))
    frame = lambda m, k: pd.DataFrame({"title": [f"isti stan na trgu {k} {i}" for i in range(m)], "price": 900.0, "first": 0, "last": 0})
    out = similarity.hit_titles(frame(1000, "a"), frame(800, "b"), 0.8, 0.05)
    assert len(out) == 1000 and sum(asked) == 1000


@pytest.mark.parametrize("limit", [4096, 2])
def test_hamming_join_equals_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(similarity, "BUCKET_LIMIT", limit)
    rng = random.Random(3)
    seeds = [rng.getrandbits(64) - 2**63 for _ in range(25)]
    codes = set(seeds)
    for s in seeds:
        for k in range(1, 9):
            c = s
            for b in rng.sample(range(63), k):
                c ^= 1 << b
            codes.add(c)
    want = {(a, b) for a in codes for b in codes if a < b and bits(a, b) <= 6}
    got = similarity.hamming_join(spark.createDataFrame([(c,) for c in codes], "code long"))
    assert {(r.code_a, r.code_b) for r in got.collect()} == want
    two = similarity.hamming_join(
        spark.createDataFrame([(c,) for c in seeds], "code long"),
        spark.createDataFrame([(c,) for c in codes], "code long"),
    )
    assert {(r.code_a, r.code_b) for r in two.collect()} == {
        (a, b) for a in seeds for b in codes if bits(a, b) <= 6
    }


def test_hot_buckets_of_either_side_are_divided(spark, monkeypatch):
    """Many codes on the left and few on the right, all alike in their high bits, then in more of them."""
    monkeypatch.setattr(similarity, "BUCKET_LIMIT", 32)
    rng = random.Random(4)
    lefts = {rng.getrandbits(20) for _ in range(150)} | {(7 << 40) | rng.getrandbits(12) for _ in range(100)}
    rights = set(rng.sample(sorted(lefts), 5)) | {rng.getrandbits(12) for _ in range(3)}
    frame = lambda cs: spark.createDataFrame([(c,) for c in cs], "code long")
    got = similarity.hamming_join(frame(lefts), frame(rights))
    assert {(r.code_a, r.code_b) for r in got.collect()} == {(a, b) for a in lefts for b in rights if bits(a, b) <= 6}
    both = similarity.hamming_join(frame(lefts), max_dist=3)
    assert {(r.code_a, r.code_b) for r in both.collect()} == {(a, b) for a in lefts for b in lefts if a < b and bits(a, b) <= 3}


def test_common_subsequence_bound_equals_the_table():
    def table(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            diagonal = 0
            for k, y in enumerate(b, 1):
                diagonal, row[k] = row[k], diagonal + 1 if x == y else max(row[k], row[k - 1])
        return row[-1]

    rng = random.Random(1)
    texts = ["".join(rng.choice("abcč 😀") for _ in range(rng.randrange(0, 300))) for _ in range(25)]
    points = [np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in texts]
    i, j = (x.ravel() for x in np.meshgrid(range(25), range(25)))
    real = np.array([table(texts[a], texts[b]) for a, b in zip(i, j)])
    for off in (-1, 0, 1):
        got = similarity._share_subsequence(points, points, i, j, real + off)
        assert (got == (off <= 0)).all()


def subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for k, y in enumerate(b, 1):
            diagonal, row[k] = row[k], diagonal + 1 if x == y else max(row[k], row[k - 1])
    return row[-1]


@pytest.mark.parametrize("sizes, need, letters", [([12], 9, "abcd"), ([10, 14], 9, "abc"), ([9], 7, "ab"), ([11], 9, "čé😀x"), ([10], 10, "ab"), ([8], 2, "abc")])
def test_keys_find_all_pairs_of_a_long_common_subsequence(monkeypatch, sizes, need, letters):
    monkeypatch.setattr(keyed, "ALL_PAIRS", 0)
    monkeypatch.setattr(keyed, "KEPT", 500)
    monkeypatch.setattr(keyed, "PAIRS_HELD", 300)
    rng = random.Random(len(sizes) + need)
    sides = [sorted({"x y " + "".join(rng.choice(letters) for _ in range(n)) + "q" for _ in range(80)}) for n in sizes]
    texts, first = sum(sides, []), len(sides[0])
    want = {
        (i, j) for j in range(len(texts)) for i in range(j)
        if (len(sizes) == 1 or i < first <= j) and subsequence(texts[i], texts[j]) >= need + 5
    }
    got = set()
    for side in (0, 1):
        for part in range(4):
            for x, y in keyed.near_pairs(sides, [n + 5 for n in sizes], need + 5, side, (part, 4)):
                got |= set(zip(x.tolist(), y.tolist(), strict=True))
    assert got == want


def short_titles(n, seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(13, 17))).strip() for _ in range(n // 2)]
    for k in range(n):
        t = list(rng.choice(base))
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(t))
            t[at : at + 1] = [] if rng.random() < 0.5 else rng.choice("abcdefgh")
        yield k, None, None, None, 50.0, rng.choice([500.0, 510.0, 520.0, 540.0, 600.0, 640.0, 0.0]), "St " + "".join(t)


def test_titles_found_by_keys_are_those_found_in_tiles(spark):
    rows = list(short_titles(4000, 9))
    df = spark.createDataFrame(rows, SCHEMA)
    a, b = df.filter("seq % 3 = 0"), df.filter("seq % 3 > 0")
    never = 1 << 60
    for x, y in ((df, None), (a, b)):
        tiled, found = (similarity.fuzzy_title_join(x, y, keyed_from=k).collect() for k in (never, 0))
        assert len(found) == len(tiled) and set(found) == set(tiled) and found
    tiled, found = (similarity.fuzzy_title_hits(a, b, keyed_from=k).collect() for k in (never, 0))
    assert len(found) == len(tiled) and set(found) == set(tiled) and found


def test_thin_links_by_keys_lead_to_the_same_rows(spark):
    rows = list(short_titles(900, 10))
    df = spark.createDataFrame(rows, SCHEMA)
    whole, thin = title_pairs(df, keyed_from=1 << 60), title_pairs(df, thin=True, keyed_from=0)
    assert thin <= whole
    assert led_to(rows, thin) == led_to(rows, whole)


def test_keys_take_the_place_of_pairs_in_crowded_bands_of_short_titles(spark):
    """The work that is planned follows the titles: with pairs it would grow by their square."""
    made = lambda n, size: spark.createDataFrame([(k, 8, size, n) for k in range(180, 200)], "pb long, lb long, size int, n long")
    units, done = similarity._keyed_units(made(300_000, 29), None, False, 0.8, similarity.KEYED_FROM)
    assert done == {(8, 8)} and {u[2:5] for u in units} == {(29, 29, 24)}
    more, _ = similarity._keyed_units(made(3_000_000, 29), None, False, 0.8, similarity.KEYED_FROM)
    assert len(units) < len(more) < 40 * len(units)  # of 100 times the pairs
    assert similarity._keyed_units(made(200, 29), None, False, 0.8, similarity.KEYED_FROM) == ([], set())
    assert similarity._keyed_units(made(300_000, 60), None, False, 0.8, similarity.KEYED_FROM) == ([], set())


def test_a_title_is_written_once_however_many_tiles_read_it(spark, tmp_path, monkeypatch):
    folder = tmp_path / "titles"
    monkeypatch.setattr(similarity, "work_folder", lambda session, name: str(folder))
    rows = [(k, f"stan broj {k:04d} u centru", 500.0) for k in range(60)]
    df = spark.createDataFrame(rows, "seq long, title string, price_eur double")
    out = similarity.fuzzy_title_join(df, tile_rows=3)
    assert spark.read.parquet(str(folder)).count() == 60
    assert len(list(folder.rglob("chunk=*"))) > 10
    assert out.count() == 60 * 59 // 2  # each later title with each earlier one

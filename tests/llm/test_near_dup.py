"""MinHash near-duplicates against all pairs."""

import random

import pytest

from nestfold.llm import near_dup
from nestfold.llm.near_dup import deduplicate, least_matches, near_duplicates

COLUMNS = "doc_id long, text string, key string, node int, bucket long, kept boolean, comp string"


def shingles(text, size):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))) if words else frozenset()


def by_all_pairs(rows, size, percent=80):
    sets = [(i, shingles(t, size)) for i, t in rows]
    comp = {i: i for i, _ in sets if i is not None}
    changed = True
    while changed:
        changed = False
        for i, a in sets:
            for j, b in sets:
                if a and b and i is not None and j is not None and comp[i] > comp[j] and 100 * len(a & b) >= percent * len(a | b):
                    comp[i], changed = comp[j], True
    return comp


def check(spark, rows, size=2):
    df = spark.createDataFrame([(i, t, "k", 1, 2, True, "c") for i, t in rows], COLUMNS)
    out = near_duplicates(df, size=size).collect()
    want = by_all_pairs(rows, size)
    assert len(out) == len(rows)
    texts = dict(rows)
    for r in out:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
            continue
        assert r.component_id == want[r.doc_id], (r, want[r.doc_id])
        assert r.kept == (r.doc_id == r.component_id)
        assert r.n_shingles == len(shingles(texts[r.doc_id], size))
    return out


def varied(rng, base, changes):
    words = list(base)
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("tile", [near_dup.TILE, 2000])
def test_groups_of_near_copies_and_outliers(spark, monkeypatch, tile):
    """Members that reach the group only through others, and some that stay just outside; tiles of any size."""
    monkeypatch.setattr(near_dup, "TILE", tile)
    rng = random.Random(5)
    rows = []
    for _ in range(3):
        base = [f"a{rng.randrange(10**6)}" for _ in range(100)]
        rows += [varied(rng, base, rng.choice([0, 1, 3, 5, 8, 12])) for _ in range(60)]
    rows += [" ".join(f"b{rng.randrange(10**6)}" for _ in range(rng.choice([1, 2, 3, 40]))) for _ in range(60)]
    rng.shuffle(rows)
    check(spark, list(enumerate(rows)))


def test_chain_of_links(spark):
    words = [f"c{k}" for k in range(200)]
    check(spark, [(90 - k, " ".join(words[k * 5 : k * 5 + 100])) for k in range(20)])


def test_nulls_empties_long_texts_and_repeats(spark):
    long = " ".join(f"l{k}" for k in range(30_000))
    rows = [(9, None), (8, ""), (7, " \n\t"), (6, "One"), (5, "oNE"), (4, "one two"), (3, "ONE\x0btwo"), (2, long), (1, long + " end"), (None, "one two"), (None, None), (20, "é É"), (21, "É É")]
    out = check(spark, rows)
    assert {r.doc_id: r.n_shingles for r in out if r.doc_id in (9, 8, 7, 6)} == {9: 0, 8: 0, 7: 0, 6: 1}
    again = near_duplicates(spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, "a b c"), (1, "x y z")], "doc_id long, text string"), size=2)
    assert sorted((r.doc_id, r.component_id, r.kept) for r in again.collect()) == [(1, 1, True)] * 3 + [(2, 1, False)]


def words(name, n=40):
    return " ".join(f"{name}{k}" for k in range(n))


def test_different_texts_under_one_id(spark):
    """Each row follows its own text; nothing is lost with a row that shares an id."""
    a, b, c = words("a"), words("b"), words("c")
    rows = [(1, a), (5, a), (5, b), (7, b), (9, c), (9, c), (8, b + " end")]
    df = spark.createDataFrame([(i, t, "k", 1, 2, True, "c") for i, t in rows], COLUMNS)
    got = sorted((r.doc_id, r.component_id, r.kept) for r in near_duplicates(df).collect())
    assert got == [(1, 1, True), (5, 1, False), (5, 5, True), (7, 5, False), (8, 5, False), (9, 9, True), (9, 9, True)]
    left = deduplicate(df)
    assert left.columns == df.columns
    assert sorted((r.doc_id, r.text) for r in left.collect()) == [(1, a), (5, b), (9, c)]


def test_one_id_and_one_row_of_very_many(spark):
    rng = random.Random(9)
    texts = [" ".join(f"x{rng.randrange(10**6)}" for _ in range(20)) for _ in range(300)]
    rows = [(4, t) for t in texts] + [(6, texts[0])] * 300 + [(3, texts[1].upper()), (2, texts[2] + " more")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.component_id, r.kept) for r in near_duplicates(df).collect()}
    assert got == {(4, 4, True), (4, 3, False), (4, 2, False), (6, 4, False), (3, 3, True), (2, 2, True)}
    left = deduplicate(df).collect()
    assert sorted(r.doc_id for r in left) == [2, 3] + [4] * 298


def test_one_row_of_each_component_stays(spark):
    rng = random.Random(10)
    base = [f"a{k}" for k in range(60)]
    rows = [(rng.randrange(40), varied(rng, base, rng.choice([0, 0, 1, 2, 30])) if rng.random() < 0.7 else rng.choice([None, "", "One two", "one TWO"])) for _ in range(120)]
    rows += [(None, "one two"), (None, "one two"), (None, None)]
    df = spark.createDataFrame([(*r, "s", k % 2) for k, r in enumerate(rows)], "doc_id long, text string, id string, near_id int")
    left = [(r.doc_id, r.text) for r in deduplicate(df, size=2).collect()]
    texts = sorted({t.lower() for _, t in rows if t}, key=str)
    comp = by_all_pairs(list(enumerate(texts)), 2)
    ids = {}
    for i, t in rows:
        if t and i is not None:
            ids[comp[texts.index(t.lower())]] = min(i, ids.get(comp[texts.index(t.lower())], i))
    bare = [r for r in rows if r[0] is None or not r[1]]
    assert sorted((comp[texts.index(t.lower())], i) for i, t in left if t and i is not None) == sorted(ids.items())
    assert sorted((r for r in left if r[0] is None or not r[1]), key=str) == sorted(bare, key=str)


def test_empty_table(spark):
    assert deduplicate(spark.createDataFrame([], "doc_id long, text string, x int")).collect() == []
    out = near_duplicates(spark.createDataFrame([], "doc_id long, text string"))
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"] and out.collect() == []


def test_five_word_shingles_are_the_default(spark):
    base = [f"d{k}" for k in range(60)]
    one = " ".join(base)
    rows = [(1, one), (2, " ".join([*base[:30], "new", *base[31:]])), (3, " ".join([*base[:10], "a", *base[11:40], "b", *base[41:]]))]
    check(spark, rows, size=5)
    assert {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {1: 1, 2: 1, 3: 3}


def test_bound_prunes_at_the_chosen_probability():
    steps = least_matches(80, 1e-6)
    assert [n for n, _ in steps] == list(range(16, 129, 16))
    assert all(0 < m < 0.8 * n for n, m in steps)
    assert all(a <= b for (_, a), (_, b) in zip(steps, steps[1:], strict=False))
    assert all(m >= k for (_, m), (_, k) in zip(least_matches(80, 1e-3), steps, strict=True))

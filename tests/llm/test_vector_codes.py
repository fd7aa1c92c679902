"""Equal-average search and the codes against brute force in Python's integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from nestfold.llm import vector_codes
from nestfold.llm.vector_codes import Codebook, codebooks_digest, compress

COLUMNS = "vec_id long, embedding array<float>, label int, code string, error long, vector string, size int"


def nearest(part, entries):
    return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), k) for k, e in enumerate(entries))


def by_brute_force(rows, parts=4, rounds=4):
    kept = [(i, v, c) for i, v, c in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    whole = [(i, [math.floor(1024 * float(np.float32(x))) for x in v], c) for i, v, c in kept]
    d = len(whole[0][1]) // parts
    cut = [(i, [v[p * d : (p + 1) * d] for p in range(parts)], c) for i, v, c in whole]
    first = sorted(cut, key=lambda r: (r[0] is None, r[0] or 0, sum(r[1], [])))[:256]
    books = [[list(r[1][p]) for r in first] for p in range(parts)]
    for _ in range(rounds):
        for p, book in enumerate(books):
            held = {}
            for _, v, _ in cut:
                held.setdefault(nearest(v[p], book)[1], []).append(v[p])
            for k, found in held.items():
                book[k] = [sum(xs) // len(found) for xs in zip(*found, strict=True)]
    coded = [(i, c, [nearest(v[p], books[p]) for p in range(parts)]) for i, v, c in cut]
    total = {}
    for _, c, found in coded:
        total[c] = total.get(c, 0) + sum(e for e, _ in found)
    out = [(i, c, bytes(k for _, k in found).hex(), sum(e for e, _ in found), total[c]) for i, c, found in coded]
    return out, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def check(spark, rows):
    df = spark.createDataFrame([(*r, "c", 1, "v", 2) for r in rows], COLUMNS).repartition(5)
    coded, books = compress(df)
    want, digest = by_brute_force(rows)
    key = lambda r: tuple((x is None, x) for x in r)
    assert coded.columns == ["vec_id", "label", "code", "error", "label_error"]
    assert sorted(map(tuple, coded.collect()), key=key) == sorted(want, key=key)
    assert codebooks_digest(books) == digest


@pytest.mark.parametrize("spread", [2, 50, 5000, 2**35])
def test_nearest_entry_of_any_size(spread):
    rng = random.Random(spread)
    entries = [[rng.randrange(-spread, spread) for _ in range(5)] for _ in range(256)]
    entries[9], entries[200] = entries[100], entries[3]
    parts = [[rng.randrange(-spread, spread) for _ in range(5)] for _ in range(600)] + entries[:20] + [[7] * 5] * 50
    index, away = Codebook(entries).nearest(np.array(parts, float))
    assert [(int(a), int(k)) for a, k in zip(away, index, strict=True)] == [nearest(p, entries) for p in parts]


def test_search_leaves_out_entries_beyond_the_gap(monkeypatch):
    """Where sums differ much, few entries are compared."""
    seen = []
    book = Codebook([[1000 * k] * 4 for k in range(256)])
    dot = vector_codes.Codebook.table(book, float)[0]

    class Counted(np.ndarray):
        def __getitem__(self, at):
            got = super().__getitem__(at)
            if isinstance(at, slice):
                seen.append(len(got))
            return got

    book.tables[float] = (dot.view(Counted), *book.tables[float][1:])
    index, _ = book.nearest(np.array([[1000.0 * k + 1] * 4 for k in range(40)]))
    assert index.tolist() == list(range(40)) and sum(seen) <= 40 + 4 * vector_codes.RUN


def test_many_vectors(spark):
    rng = random.Random(2)
    rows = [(k, [rng.gauss(0, 0.2) for _ in range(8)], rng.choice([None, 1, 2])) for k in rng.sample(range(-500, 9000), 600)]
    rows += [(20_000 + k, rows[3][1], 1) for k in range(300)]  # one vector holds a third of all rows
    check(spark, rows)


def test_few_vectors_nulls_repeats_and_large_numbers(spark):
    rows = [
        (1, [1.0, 2.0, -0.5, 0.25], 1), (1, [1.0, 2.0, -0.5, 0.25], 1), (1, [0.0, 2.0, -0.5, 0.25], None), (None, [9.0, 9.0, 9.0, 9.0], None), (2, None, 1), (3, [1.0, None, 1.0, 1.0], 1),
        (4, [1.0, float("nan"), 1.0, 1.0], 1), (5, [1.0, float("inf"), 1.0, 1.0], 1), (6, [-0.0001, 1e5, -1e5, 3e5], 7), (7, [1e6, 0.0, 0.0, 0.0], 7),
    ]
    check(spark, rows)


def test_errors_beyond_a_long_are_null(spark):
    rows = [(k, [0.0, 0.0, 0.0, 0.0], 1) for k in range(256)] + [(999, [1e12, 0.0, 0.0, 0.0], 2), (998, [-3e12, 0.0, 0.0, 0.0], 2), (1000, [1e30, 0.0, 0.0, 0.0], 2)]
    coded, _ = compress(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), rounds=0)
    got = {r.vec_id: r for r in coded.collect()}
    assert 1000 not in got and len(got) == 258 and got[3].error == 0
    assert got[998].error is None and got[998].label_error is None


def test_lengths(spark):
    """Most vectors' length holds; it is filled up to a multiple of the parts."""
    df = spark.createDataFrame([(1, [1.0] * 5, 1), (2, [2.0] * 5, 1), (3, [1.0] * 4, 1), (4, [], 1)], "vec_id long, embedding array<double>, label int")
    coded, books = compress(df)
    assert sorted((r.vec_id, r.code, r.error) for r in coded.collect()) == [(1, "00000000", 0), (2, "01010101" if books[3][1] != books[3][0] else "01010100", 0)]
    assert [len(b[0]) for b in books] == [2, 2, 2, 2]


def test_no_vectors(spark):
    for rows in ([], [(1, None, 1)], [(1, [], 1)]):
        coded, books = compress(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
        assert [r.error for r in coded.collect()] == [0] * (rows[:1] == [(1, [], 1)])
        assert codebooks_digest(books) == hashlib.sha256(b"").hexdigest()

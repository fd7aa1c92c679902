"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over neighbouring words; positions it doesn't look at may differ. Tasks hash the masked windows
of tests and of training texts, and the hashes are joined. Around each hit the two texts are laid over each other:
the longest stretch that agrees well enough, substituted words included, is the overlap.

A bitmap of the tests' hashes, of bounded size, keeps windows that no test has from leaving their task. Equal windows of a text
are one row with their places, and so are those of a test, so that repetitive texts don't multiply
each other. What holds for a text holds for its copies: texts are known by their md5 from there on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nestfold.llm.membership import bitmap, inside
from nestfold.llm.words import U64, binary, fresh, hashes_of, mix, words_of
from nestfold.session import broadcast_if_small, cut

# Weight 5 of spans 5 to 9: the first is five words in a row, the others pass over a changed word. Every way to change a
# fifth of 8 to 15 words leaves one of them whole.
SEEDS = ("11111", "1101011", "1110011", "110010101")
PERCENT = 80  # of the words of the overlap must agree
LEAST = 8  # words of a test that must lie in the overlap, or all of a shorter one

HITS = "array<struct<item_id:bigint,start:int,words:int,agreeing:int>>"


def masked(h: np.ndarray, seed: str) -> np.ndarray:
    """The hash of the window at each place, of the words under the mask's ones."""
    n = len(h) - len(seed) + 1
    if n <= 0:
        return np.empty(0, U64)
    out = np.full(n, len(seed), U64)
    for k, bit in enumerate(seed):
        if bit == "1":
            out = mix(out + h[k : k + n])
    return out


def _seeds_of(words: int) -> tuple[str, ...]:
    """A test with fewer words than a seed is looked for word by word."""
    return SEEDS if words >= len(SEEDS[0]) else ("1" * words,) if words else ()


def _grouped(hashes: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Different hashes, and the places of each."""
    if not len(hashes):
        return hashes, []
    order = np.argsort(hashes, kind="stable")
    hashes, places = hashes[order], places[order]
    heads = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
    return hashes[heads], np.split(places, heads[1:])


def _windows(h: np.ndarray, seeds: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    made = [masked(h, s) for s in seeds]
    return np.concatenate([np.empty(0, U64), *made]), np.concatenate([np.empty(0, np.int32), *(np.arange(len(m), dtype=np.int32) for m in made)])


def _lists(places: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, places)])
    flat = np.concatenate([np.empty(0, np.int32), *places]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))


def _test_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for nth, text in zip(batch.column("nth").to_pylist(), batch.column("text").to_pylist(), strict=True):
            h = hashes_of(words_of(text, lower=True))
            found, places = _grouped(*_windows(h, _seeds_of(len(h))))
            yield pa.RecordBatch.from_arrays(
                [pa.array(found.view(np.int64)), pa.array(np.full(len(found), nth)), pa.array(np.full(len(found), min(len(h), len(SEEDS[0])), np.int32)), _lists(places)],
                ["hash", "nth", "size", "places"],
            )


def _text_windows(shared, seeds: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            keys, hashes, lists = [], [], []
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                h = hashes_of(words_of(text, lower=True))
                mine, places = _windows(h, seeds)
                some = inside(held, mine)
                found, at = _grouped(mine[some], places[some])
                keys += [key] * len(found)
                hashes.append(found)
                lists += at
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, U64), *hashes]).view(np.int64)), pa.array(keys, pa.string()), _lists(lists)], ["hash", "key", "at"])

    return run


def stretch(agree: np.ndarray, percent: int) -> tuple[int, int]:
    """The longest stretch of which ``percent`` of a hundred agree; of equally long ones the most agreeing, then the first."""
    gain = np.concatenate([[0], np.cumsum(np.where(agree, 100 - percent, -percent))])
    least = np.minimum.accumulate(gain)
    # The first place whose running minimum is no higher is the first whose own sum isn't.
    lo = np.searchsorted(-least, -gain, "left")
    size = np.arange(len(gain)) - lo
    ends = np.flatnonzero(size == size.max())
    hi = int(ends[np.argmax(gain[ends] - gain[lo[ends]])])
    return int(lo[hi]), hi


def best_overlap(h: np.ndarray, w: np.ndarray, starts: np.ndarray, percent: int, least: int) -> tuple[int, int, int] | None:
    """``(start, words, agreeing)`` of the best overlap of a test's words with a text's, over the places where
    the test would start: the longest, then the most agreeing, then the first one."""
    best = None
    for start in starts.tolist():
        a, b = max(0, start), min(len(h), start + len(w))
        if best and b - a < best[0]:
            continue
        agree = h[a:b] == w[a - start : b - start]
        lo, hi = stretch(agree, percent)
        if hi - lo >= min(least, len(w)):
            agreeing = int(agree[lo:hi].sum())
            found = (hi - lo, agreeing, -(a + lo))
            best = max(best or found, found)
            if agreeing == len(w):  # nothing is better, and all that is as good starts later
                break
    return best and (-best[2], best[0], best[1])


def _starts(at: list[np.ndarray], places: list[np.ndarray]) -> np.ndarray:
    """The different places where the test would start, ascending, from the places of equal windows in either text."""
    lo = min(int(a.min() - p.max()) for a, p in zip(at, places, strict=True))
    hi = max(int(a.max() - p.min()) for a, p in zip(at, places, strict=True))
    there = np.zeros(hi - lo + 1, bool)
    for a, p in zip(at, places, strict=True):
        few, many = (a, -p) if len(a) < len(p) else (-p, a)
        for x in few.tolist():
            there[many + (x - lo)] = True
    return np.flatnonzero(there) + lo


def _overlaps(percent: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (key, nth), a text before the windows that hit it -> its overlap with each test."""
        key = nth = words = text = None
        item, at, places = None, [], []
        out: list[tuple] = []

        def ended() -> None:
            if at:
                found = best_overlap(text, words, _starts(at, places), percent, least)
                if found:
                    out.append((key, item, *found))
            at.clear()
            places.clear()

        for batch in batches:
            columns = (batch.column(c) for c in ("key", "nth", "item_id", "held", "at", "places"))
            for k, t, i, held, a, p in zip(*columns, strict=True):
                k, t = k.as_py(), t.as_py()
                if (k, t) != (key, nth):
                    ended()
                    key, nth, item = k, t, i.as_py()
                    if t is None:
                        text = hashes_of(words_of(held.as_py().decode("utf-8", "surrogatepass"), lower=True))
                    else:
                        words = np.frombuffer(held.as_py(), U64)
                if t is not None:
                    at.append(a.values.to_numpy())
                    places.append(p.values.to_numpy())
            yield _found(out)
            out.clear()
        ended()
        yield _found(out)

    return run


def _found(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["key", "item_id", "start", "words", "agreeing"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        held = [hashes_of(words_of(t, lower=True)).tobytes() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("nth"), batch.column("item_id"), binary(held)], ["nth", "item_id", "held"])


def find_contamination(
    docs: DataFrame,
    tests: DataFrame,
    text_col: str = "text",
    test_id: str = "item_id",
    test_text: str = "text",
    percent: int = PERCENT,
    least: int = LEAST,
    name: str = "hits",
) -> DataFrame:
    """``docs`` with ``hits``: an array of (item_id, start, words, agreeing), the best overlap with each test.

    ``start`` and ``words`` tell the longest stretch, in words of the text, of which ``percent`` of a hundred agree; at
    least ``least`` words of the test lie in it (all, of a shorter test). A test of fewer words than a seed
    must stand there word by word. Words are lower-cased in A-Z only. Hits are in order of their ids, then starts.

    Null and empty texts and tests hit nothing. Rows that repeat are each told; tests that repeat each
    hit. No tests leave every array empty. Other columns are carried along; one called ``name`` is replaced.
    """
    docs = docs.drop(*(c for c in docs.columns if c.lower() == name.lower()))
    digest = F.md5(F.col(text_col).cast("string").cast("binary"))
    texts = docs.select(digest.alias("key"), F.col(text_col).cast("string").alias("text")).filter("text is not null")
    items = tests.select(F.col(test_id).cast("long").alias("item_id"), F.col(test_text).cast("string").alias("text")).filter("text is not null")
    items = cut(items.withColumn("nth", F.monotonically_increasing_id()))  # written, as the numbers must not change any more

    windows = cut(items.select("nth", "text").mapInArrow(_test_windows, "hash long, nth long, size int, places array<int>"))
    sizes = [r.size for r in windows.select("size").distinct().collect()]  # at most the length of the first seed
    seeds = tuple(s for n in sizes for s in _seeds_of(n))
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(windows))
    mine = texts.mapInArrow(_text_windows(shared, seeds), "hash long, key string, at array<int>")
    # Equal texts hit alike: one of each is laid over the tests.
    hits = cut(mine.join(broadcast_if_small(windows), "hash").select("key", "nth", "at", "places").distinct())

    words = cut(items.mapInArrow(_hashed, "nth long, item_id long, held binary"))
    laid = hits.join(broadcast_if_small(words), "nth").select("key", "nth", "item_id", "held", "at", "places")
    wanted = broadcast_if_small(hits.select("key").distinct())
    none = F.lit(None)
    whole = texts.join(wanted, "key", "left_semi").dropDuplicates(["key"]).select(
        "key", none.cast("long").alias("nth"), none.cast("long").alias("item_id"), F.col("text").cast("binary").alias("held"), none.cast("array<int>").alias("at"), none.cast("array<int>").alias("places")
    )
    rows = whole.unionByName(laid).repartition("key").sortWithinPartitions("key", F.col("nth").asc_nulls_first())
    found = rows.mapInArrow(_overlaps(percent, least), "key string, item_id long, start int, words int, agreeing int")
    each = F.sort_array(F.collect_list(F.struct("item_id", "start", "words", "agreeing")))
    found = cut(found.groupBy("key").agg(each.alias("found")))

    key, got = fresh(docs.columns, "key"), fresh([*docs.columns, name], "found")
    out = docs.withColumn(key, digest).join(broadcast_if_small(found).withColumnsRenamed({"key": key, "found": got}), key, "left")
    return out.select(*docs.columns, F.coalesce(got, F.array()).cast(HITS).alias(name))

"""Which rows are the same flat: image codes, grid cells, titles.

All three joins work on *signatures* (distinct codes, distinct cell/price/size, distinct
title/price), never on rows. However many rows share a signature, they are one entry here;
``same_flat_edges`` brings the rows back with a number of edges linear in the rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nestfold.config import MatchConfig
from nestfold.functions import codes as code_fn
from nestfold.functions import geo, text
from nestfold.operators import keyed
from nestfold.operators.ratio import ratios
from nestfold.session import BROADCAST_ROWS, cut, work_folder
from nestfold.sources.captured import file_system

CODE_BITS = 64
# A bucket of more pairs than this squared is divided again before its codes are compared.
BUCKET_LIMIT = 4_096
# Titles compared with each other inside one task, per side; and of these, rows looked at together.
TILE_ROWS = 4_096
BLOCK_ROWS = 256


# --- image codes ---------------------------------------------------------------------------


def _spans(bits: list[int], parts: int) -> list[int]:
    """Masks of ``parts`` groups of the given bit positions, as even as possible."""
    size, extra = divmod(len(bits), parts)
    masks, at = [], 0
    for i in range(parts):
        width = size + (1 if i < extra else 0)
        masks.append(sum(1 << b for b in bits[at : at + width]))
        at += width
    return masks


def _signed(mask: int) -> int:
    return mask - (1 << CODE_BITS) if mask >> (CODE_BITS - 1) else mask


def _equal_masks(bits: list[int], parts: int, max_dist: int) -> list[int]:
    """Masks of every choice of ``parts - max_dist`` groups.

    Two codes that differ in at most ``max_dist`` bits differ in at most that many groups,
    so they agree on at least one of these masks.
    """
    groups = _spans(bits, parts)
    return [sum(pick) for pick in combinations(groups, parts - max_dist)]


def choose_parts(n: int, width: int, max_dist: int) -> int:
    """Number of groups with the least work for ``n`` codes: keys written plus pairs compared."""

    def work(parts: int) -> float:
        keys = math.comb(parts, max_dist)
        key_bits = width * (parts - max_dist) / parts
        return n * keys * 4 + n * n / 2 * keys / 2**key_bits

    return min(range(max_dist + 1, min(2 * max_dist, width) + 1), key=work)


def _divided(rows: DataFrame, col: str, masks: dict[int, list[int]]) -> DataFrame:
    """Each code once for every mask of the bits it doesn't share with its bucket yet: it goes into the
    bucket of its bits under the mask. ``masks`` is keyed by the bits shared so far; buckets are
    hashes, so two may fall together, which the distance sorts out."""
    table = rows.sparkSession.createDataFrame([(_signed(u), [_signed(m) for m in ms]) for u, ms in masks.items()], "used bigint, masks array<bigint>")
    deeper = rows.join(F.broadcast(table), "used").select(col, "bucket", "used", F.explode("masks").alias("mask"))
    bucket = F.xxhash64("bucket", "mask", F.col(col).bitwiseAND(F.col("mask")))
    return deeper.select(col, bucket.alias("bucket"), F.col("used").bitwiseOR(F.col("mask")).alias("used"))


def hamming_join(
    a: DataFrame, b: DataFrame | None = None, code: str = "code", max_dist: int = 6
) -> DataFrame:
    """Distinct code pairs within ``max_dist`` bits: ``(code_a, code_b, dist)``.

    With one input, each pair of different codes once (``code_a < code_b``); equal codes are
    one code. With two, every matching pair of a code of ``a`` and one of ``b``.

    Exact. Keys are choices of equal bit groups (Manku, Jain, Das Sarma, "Detecting
    near-duplicates for web crawling", 2007); their number follows the counted size of the
    input. A bucket with more pairs than BUCKET_LIMIT squared, counted on both sides, is divided by
    its remaining bits: its codes agree on the others, so all they differ in lies there. What is
    still larger after that is dense, and is compared in tiles of at most BUCKET_LIMIT codes a side.
    """
    left = cut(a.select(F.col(code).alias("code_a")).filter("code_a is not null").distinct())
    if b is None:
        right = left.withColumnRenamed("code_a", "code_b")
    else:
        right = cut(b.select(F.col(code).alias("code_b")).filter("code_b is not null").distinct())

    def masks_of(used: int, size: int) -> list[int]:
        rest = [k for k in range(CODE_BITS) if not used >> k & 1]
        return _equal_masks(rest, choose_parts(size, len(rest), max_dist), max_dist)

    def large_of(keys_a: DataFrame, keys_b: DataFrame) -> DataFrame:
        """Buckets with too many pairs, and the tiles of either side."""
        sides = keys_a.select("bucket", F.lit(1).alias("x"), F.lit(0).alias("y"))
        sides = sides.unionByName(keys_b.select("bucket", F.lit(0).alias("x"), F.lit(1).alias("y"))) if b is not None else sides.withColumn("y", F.lit(1))
        fill = sides.groupBy("bucket").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
        tiles = lambda c: F.ceil(F.col(c) / F.lit(BUCKET_LIMIT)).cast("int")
        return cut(fill.filter(F.col("x") * F.col("y") > BUCKET_LIMIT**2).select("bucket", "x", "y", tiles("x").alias("p"), tiles("y").alias("q")))

    start = {0: masks_of(0, max(left.count(), right.count() if b is not None else 0, 1))}
    whole = lambda rows, col: rows.select(col, F.lit(0).cast("bigint").alias("bucket"), F.lit(0).cast("bigint").alias("used"))
    keys_a, keys_b = _divided(whole(left, "code_a"), "code_a", start), _divided(whole(right, "code_b"), "code_b", start)
    pairs = []

    def join(x: DataFrame, y: DataFrame, on: list[str]) -> None:
        pairs.append(x.join(y.drop("used"), on).select("code_a", "code_b"))

    def split(large: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Join what is in no large bucket; return the keys of the others."""
        spot = large.select("bucket")  # a written table: Spark broadcasts it by its size, or shuffles
        join(keys_a.join(spot, "bucket", "left_anti"), keys_b.join(spot, "bucket", "left_anti"), ["bucket"])
        return keys_a.join(spot, "bucket", "left_semi"), keys_b.join(spot, "bucket", "left_semi")

    large = large_of(keys_a, keys_b)
    top = large.agg(F.max(F.greatest("x", "y"))).first()[0]
    if top is None:
        join(keys_a, keys_b, ["bucket"])
    else:
        keys_a, keys_b = split(large)
        # Of the choices of bit groups those that lead to a large bucket; a choice that leaves few bits isn't divided.
        used = {r.used % (1 << CODE_BITS) for r in keys_a.select("used").distinct().collect()}
        masks = {u: masks_of(u, top) if CODE_BITS - u.bit_count() > max_dist else [u] for u in used}
        keys_a, keys_b = cut(_divided(keys_a, "code_a", masks)), cut(_divided(keys_b, "code_b", masks))
        large = large_of(keys_a, keys_b).select("bucket", "p", "q")
        keys_a, keys_b = split(large)
        part = lambda col, n: F.pmod(F.xxhash64(col), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        tiled_a = keys_a.join(large, "bucket").withColumn("i", part("code_a", "p")).withColumn("j", every("q"))
        tiled_b = keys_b.join(large, "bucket").withColumn("j", part("code_b", "q")).withColumn("i", every("p"))
        join(tiled_a, tiled_b.drop("p", "q"), ["bucket", "i", "j"])
    near = code_fn.hamming(F.col("code_a"), F.col("code_b")) <= max_dist
    if b is None:
        near = near & (F.col("code_a") < F.col("code_b"))
    return (
        reduce(DataFrame.unionByName, pairs)
        .filter(near)
        .distinct()
        .withColumn("dist", code_fn.hamming(F.col("code_a"), F.col("code_b")).cast("int"))
    )


# --- grid cells ----------------------------------------------------------------------------


def grid_signature(df: DataFrame, cfg: MatchConfig = MatchConfig()) -> DataFrame:
    """Adds ``cell``, ``price_cell``; null cell for rows without coordinates."""
    return df.withColumn("cell", geo.coord_cell(F.col("lat"), F.col("lng"), cfg.coord_decimals)).withColumn(
        "price_cell", geo.price_bucket(F.col("price_eur"), cfg.price_bucket_eur)
    )


def grid_bucket_join(a: DataFrame, b: DataFrame | None = None, cfg: MatchConfig = MatchConfig()) -> DataFrame:
    """Different sizes in one cell and price bucket that are less than the tolerance apart:
    ``(cell, price_cell, m2_a, m2_b)``.

    Sizes fall into bins one tolerance wide; only a bin and its successor are joined, so a
    crowded cell is divided by size. The output is bounded by how finely sizes are stated, not
    by the rows. With one input, ``m2_a < m2_b``; with two, all pairs, equal sizes included.
    """
    tol = cfg.m2_tolerance
    keys = ["cell", "price_cell", "m2"]

    def sizes(df: DataFrame, name: str) -> DataFrame:
        rows = grid_signature(df, cfg).filter("cell is not null").select(*keys).distinct()
        return rows.select("cell", "price_cell", F.col("m2").alias(name), F.floor(F.col("m2") / tol).alias("bin"))

    left = sizes(a, "m2_a")
    right = left.withColumnRenamed("m2_a", "m2_b") if b is None else sizes(b, "m2_b")
    reach = [0, 1] if b is None else [-1, 0, 1]
    spread = left.withColumn("bin", F.explode(F.array(*[F.col("bin") + d for d in reach])))
    near = F.abs(F.col("m2_a") - F.col("m2_b")) < tol
    if b is None:
        near = near & (F.col("m2_a") < F.col("m2_b"))
    return spread.join(right, ["cell", "price_cell", "bin"]).filter(near).drop("bin")


# --- titles --------------------------------------------------------------------------------


def title_entries(df: DataFrame, title: str = "title", price: str = "price_eur", seq: str = "seq") -> DataFrame:
    """Distinct (normalised title, price) with the span of arrivals; priced rows only."""
    rows = df.filter(F.col(price) > 0).select(
        text.normalize_title(F.col(title)).alias("title"),
        F.col(price).alias("price"),
        F.col(seq).alias("seq"),
    )
    return rows.groupBy("title", "price").agg(F.min("seq").alias("first"), F.max("seq").alias("last"))


def _char_bits(left: list[np.ndarray], right: list[np.ndarray], words: int = 2, columns: int = 64) -> tuple[tuple, tuple]:
    """For either side (bit rows, characters not told by them): a bit says that a text has a hashed character more than
    k times. Of all such bits those are told that split the texts most evenly. Two texts share at most their
    common bits and the smaller of what is untold, so a bound built on it drops nothing that could match."""
    every = [*left, *right]
    sizes = np.array([len(p) for p in every], np.int64)
    counts = np.zeros((columns, len(every)), np.int32)
    if sizes.sum():
        np.add.at(counts, (np.concatenate(every) % columns, np.repeat(np.arange(len(every)), sizes)), 1)
    told = [(c, k, (counts[c] > k).mean()) for c in range(columns) for k in range(min(8, int(counts[c].max(initial=0))))]
    told = sorted(told, key=lambda t: abs(t[2] - 0.5))[: 64 * words]
    bits = np.zeros((words, len(every)), np.uint64)
    for n, (c, k, _) in enumerate(told):
        bits[n // 64] |= (counts[c] > k).astype(np.uint64) << np.uint64(n % 64)
    rest = sizes - np.bitwise_count(bits).sum(0, dtype=np.int64)
    rest = rest.astype(np.uint8 if sizes.max(initial=0) < 256 else np.int32)
    n = len(left)
    return (bits[:, :n], rest[:n]), (bits[:, n:], rest[n:])


def _shared_chars(left: tuple, right: tuple, block: slice) -> np.ndarray:
    """An upper bound of the characters that each pair shares."""
    (a, rest_a), (b, rest_b) = left, right
    out = np.minimum(rest_a[block, None], rest_b[None, :])
    for x, y in zip(a, b, strict=True):
        out += np.bitwise_count(x[block, None] & y[None, :])
    return out


def _share_subsequence(
    left: list[np.ndarray], right: list[np.ndarray], i: np.ndarray, j: np.ndarray, need: np.ndarray
) -> np.ndarray:
    """Whether the longest common subsequence of each pair (left[i], right[j]) reaches ``need``.

    Bit-parallel over the right string (Hyyro, "Bit-parallel LCS-length computation revisited",
    2004), with all pairs advanced together one left character at a time. Pairs that can no
    longer get there are let go every 64 characters.
    """
    used = np.unique(j)
    alphabet = np.unique(np.concatenate([right[k] for k in used] or [np.zeros(0, np.uint32)]))
    words = max(1, -(-max((len(right[k]) for k in used), default=1) // 64))
    # One row per right string and character; the last character row stays empty.
    masks = np.zeros((len(used), len(alphabet) + 1, words), dtype=np.uint64)
    for row, k in enumerate(used):
        at = np.arange(len(right[k]))
        bit = np.left_shift(np.uint64(1), (at % 64).astype(np.uint64))
        np.bitwise_or.at(masks, (row, np.searchsorted(alphabet, right[k]), at // 64), bit)
    steps = max((len(left[k]) for k in np.unique(i)), default=0)
    text_of = np.full((len(left), steps), len(alphabet), dtype=np.int64)
    for k in np.unique(i):
        at = np.searchsorted(alphabet, left[k])
        at[at == len(alphabet)] = 0
        known = alphabet[at] == left[k] if len(alphabet) else np.zeros(len(at), bool)
        text_of[k, : len(at)] = np.where(known, at, len(alphabet))
    row_of = np.searchsorted(used, j)
    size = np.array([len(p) for p in left])[i]
    reached = np.zeros(len(i), dtype=bool)
    slot = np.arange(len(i))
    v = np.full((words, len(i)), np.uint64(0xFFFFFFFFFFFFFFFF))
    for step in range(steps + 1):
        if step % 64 == 0 or step == steps:
            common = np.bitwise_count(~v).sum(axis=0, dtype=np.int64)
            done = common >= need
            reached[slot[done]] = True
            going = ~done & (common + size - step >= need)
            if not going.any() or step == steps:
                break
            if not going.all():
                i, row_of, size, need, slot = (x[going] for x in (i, row_of, size, need, slot))
                v = v[:, going]
        m = masks[row_of, text_of[i, step]]
        carry = np.zeros(len(i), dtype=np.uint64)
        for w in range(words):
            u = v[w] & m[:, w]
            total = v[w] + u
            over = total < v[w]
            bumped = total + carry
            over |= bumped < total
            v[w] = bumped | (v[w] & ~u)
            carry = over.astype(np.uint64)
    return reached


# Pairs advanced together, which bounds the arrays of a tile.
PAIR_BATCH = 65_536
# Candidates of an entry up to which all are looked at together.
FEW = 64


Pairs = tuple[np.ndarray, np.ndarray]


class TitleTile:
    """Two sets of title entries, and what can be said of their pairs; of ``pairs`` only, where some are given."""

    def __init__(self, left: pd.DataFrame, right: pd.DataFrame, ratio: float, pct: float, pairs: Pairs | None = None):
        self.ratio, self.pct, self.pairs = ratio, pct, pairs
        self.titles = [side["title"].tolist() for side in (left, right)]
        self.prices = [side["price"].to_numpy(float) for side in (left, right)]
        self.points = [[np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in ts] for ts in self.titles]
        self.sizes = [np.array([len(p) for p in ps], dtype=np.int64) for ps in self.points]
        self.bits = _char_bits(*self.points) if pairs is None else ()

    def required(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Matched characters that a pair needs."""
        return np.ceil(self.ratio * (self.sizes[0][i] + self.sizes[1][j]) / 2 - 1e-9)

    def bounded(self, block: slice) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a block of the left side that price, length and shared characters allow."""
        (la, lb), (pa, pb) = self.sizes, self.prices
        need = np.ceil(self.ratio * np.arange(int(la.max(initial=0) + lb.max(initial=0)) + 1) / 2 - 1e-9)
        need = need.astype(np.uint8 if need[-1] < 256 else np.int32)
        i, j = np.nonzero(_shared_chars(*self.bits, block) >= need[la[block, None] + lb[None, :]])
        i += block.start
        near = (np.minimum(la[i], lb[j]) >= self.required(i, j)) & (np.abs(pa[i] - pb[j]) / np.maximum(pa[i], pb[j]) <= self.pct)
        return i[near], j[near]

    def blocks(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if self.pairs is not None:
            yield self.pairs
            return
        for at in range(0, len(self.titles[0]), BLOCK_ROWS):
            yield self.bounded(slice(at, min(at + BLOCK_ROWS, len(self.titles[0]))))

    def candidates(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The pairs of all blocks. Few in a block are mostly chance, which the common subsequence tells away; such blocks
        are looked at together."""
        few: list[tuple[np.ndarray, np.ndarray]] = []

        def told() -> tuple[np.ndarray, np.ndarray]:
            i, j = (np.concatenate([np.empty(0, np.int64), *(f[k] for f in few)]) for k in (0, 1))
            few.clear()
            some = _share_subsequence(*self.points, i, j, self.required(i, j))
            return i[some], j[some]

        for i, j in self.blocks():
            if len(i) >= FEW * BLOCK_ROWS:
                yield i, j
                continue
            few.append((i, j))
            if sum(len(x) for x, _ in few) >= PAIR_BATCH:
                yield told()
        yield told()

    def matching(self, i: np.ndarray, j: np.ndarray, turned: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The places among the pairs of those that match, and their ratios; ``turned`` takes the right title as the later one.

        The ratio is twice the matched characters over both lengths, and matched blocks keep their order, so no ratio
        exceeds what the common subsequence allows. The exact ratio runs on what is left.
        """
        at, found = [np.empty(0, np.int64)], [np.empty(0)]
        for start in range(0, len(i), PAIR_BATCH):
            x, y = i[start : start + PAIR_BATCH], j[start : start + PAIR_BATCH]
            keep = np.flatnonzero(_share_subsequence(*self.points, x, y, self.required(x, y)))
            texts = [[side[k] for k in rows[keep].tolist()] for side, rows in zip(self.points, (x, y), strict=True)]
            r = ratios(*(reversed(texts) if turned else texts))
            at.append(start + keep[r >= self.ratio])
            found.append(r[r >= self.ratio])
        return np.concatenate(at), np.concatenate(found)


def _entry_rows(tile: TitleTile, later: int, i: np.ndarray, j: np.ndarray, found: np.ndarray) -> pd.DataFrame:
    """``(later, earlier, ratio)`` rows of pairs; ``later`` is the side of the later title."""
    rows = (i, j)
    side = lambda k: (np.array(tile.titles[k], object)[rows[k]], tile.prices[k][rows[k]])
    (lt, lp), (et, ep) = side(later), side(1 - later)
    return pd.DataFrame({"later_title": lt, "later_price": lp, "earlier_title": et, "earlier_price": ep, "ratio": found})


def compare_titles(
    left: pd.DataFrame, right: pd.DataFrame, same: bool, both_ways: bool, ratio: float, pct: float, pairs: Pairs | None = None
) -> pd.DataFrame:
    """Title pairs of one tile that match, as ``(later, earlier, ratio)`` entry rows: lossless bounds
    first (price, length, shared characters, common subsequence), then the exact ratio."""
    tile = TitleTile(left, right, ratio, pct, pairs)
    found = [tuple(np.array(x, np.int64) for x in p) for p in tile.blocks()]
    i, j = (np.concatenate([np.empty(0, np.int64), *(p[k] for p in found)]) for k in (0, 1))
    if same:
        i, j = i[i >= j], j[i >= j]
    first, last = ([side[c].to_numpy() for side in (left, right)] for c in ("first", "last"))
    out = []
    for turned in (False, True) if both_ways else (False,):
        possible = np.ones(len(i), bool) if not both_ways else (last[1][j] > first[0][i] if turned else last[0][i] > first[1][j])
        if same:
            possible &= i != j  # an entry and itself are equal
        x, y = i[possible], j[possible]
        at, found = tile.matching(x, y, turned)
        out.append(_entry_rows(tile, int(turned), x[at], y[at], found))
    return pd.concat(out)


def _bits_of(flags: np.ndarray) -> int:
    return int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")


def link_titles(
    left: pd.DataFrame, right: pd.DataFrame, same: bool, ratio: float, pct: float, pairs: Pairs | None = None
) -> pd.DataFrame:
    """Of the matching pairs of one tile as many as reachability through ever earlier rows needs.

    An entry all of whose rows arrive after those of another, and that is led to it by links already found (each again
    between entries that don't overlap in time), needs no link to it, matching or not. So the
    entries go in order of arrival, each asks for its nearest candidates first and only for those it isn't led
    to yet, and a group of n titles that are all alike asks for and leaves about n pairs. Entries that
    overlap in time are always asked for, both ways.
    """
    tile = TitleTile(left, right, ratio, pct, pairs)
    nl, nr = len(left), 0 if same else len(right)
    first = np.concatenate([left["first"].to_numpy(), right["first"].to_numpy()[:nr]])
    last = np.concatenate([left["last"].to_numpy(), right["last"].to_numpy()[:nr]])
    place = np.empty(nl + nr, np.int64)  # of an entry in the order of arrival
    order = np.lexsort((last, first))
    place[order] = np.arange(nl + nr)
    right_place = place[:nl] if same else place[nl:]
    asks: dict[int, int] = {}  # entry -> candidates that lie wholly before it, as bits
    over: list[tuple[np.ndarray, np.ndarray]] = []
    for i, j in tile.candidates():
        if same:
            i, j = i[i > j], j[i > j]
        fi, li, fj, lj = first[i], last[i], first[nl * (not same) + j], last[nl * (not same) + j]
        apart = (fi > lj) | (fj > li)
        over.append((i[~apart], j[~apart]))
        if not apart.any():
            continue
        pi, pj = place[i[apart]], right_place[j[apart]]
        upper, lower = np.maximum(pi, pj), np.minimum(pi, pj)
        by = np.argsort(upper, kind="stable")
        upper, lower = upper[by], lower[by]
        heads = np.flatnonzero(np.diff(upper, prepend=-1))
        for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(upper)], strict=True):
            flags = np.zeros(nl + nr, bool)
            flags[lower[a:b]] = True
            asks[int(upper[a])] = asks.get(int(upper[a]), 0) | _bits_of(flags)

    reach: dict[int, int] = {}
    links: dict[int, list[int]] = {}
    matches: dict[tuple[int, int], float] = {}
    out, most = [], 1
    while asks:
        turn: list[tuple[int, int]] = []
        for x in sorted(asks):
            led = 0
            for z in links.get(x, ()):
                led |= reach.get(z, 0) | 1 << z
            reach[x] = led
            left_over = asks[x] & ~led
            for _ in range(most):
                if not left_over:
                    break
                y = left_over.bit_length() - 1
                left_over ^= 1 << y
                turn.append((x, y))
            asks[x] &= ~led
        if not turn:
            break
        x, y = np.array(turn).T
        ex, ey = order[x], order[y]
        # The tile compares left with right: say which of the two is which, and which arrives later.
        flip = ex >= nl if not same else np.zeros(len(ex), bool)
        for turned in (False, True):
            some = np.flatnonzero(flip == turned)
            i, j = (ey[some], ex[some] - nl) if turned else (ex[some], ey[some] - (0 if same else nl))
            at, found = tile.matching(i, j, turned)
            for k, r in zip(some[at].tolist(), found.tolist(), strict=True):
                links.setdefault(turn[k][0], []).append(turn[k][1])
                matches[turn[k]] = r
        for a, b in turn:
            asks[a] &= ~(1 << b)
        # An entry that asks for nothing more still passes on what it leads to.
        for x in [x for x, left_over in asks.items() if not left_over and x not in links]:
            del asks[x]
        most *= 2
    # Several asked for at once may lead to each other: the nearest stay.
    needed = []
    for x, found in links.items():
        led = 0
        for z in sorted(found, reverse=True):
            if not led >> z & 1:
                needed.append((x, z))
                led |= reach.get(z, 0) | 1 << z
    if needed:
        x, y = np.array(needed).T
        ex, ey, r = order[x], order[y], np.array([matches[n] for n in needed])
        flip = ex >= nl if not same else np.zeros(len(ex), bool)
        for turned in (False, True):
            some = flip == turned
            i, j = (ey[some], ex[some] - nl) if turned else (ex[some], ey[some] - (0 if same else nl))
            out.append(_entry_rows(tile, int(turned), i, j, r[some]))
    i, j = (np.concatenate([np.empty(0, np.int64), *(o[k] for o in over)]) for k in (0, 1))
    right_of = nl * (not same)
    for turned in (False, True):
        later = last[right_of + j] > first[i] if turned else last[i] > first[right_of + j]
        at, found = tile.matching(i[later], j[later], turned)
        out.append(_entry_rows(tile, int(turned), i[later][at], j[later][at], found))
    return pd.concat(out)


def hit_titles(left: pd.DataFrame, right: pd.DataFrame, ratio: float, pct: float, pairs: Pairs | None = None) -> pd.DataFrame:
    """The left entries of one tile that match some right one, each asked for until its first match."""
    tile = TitleTile(left, right, ratio, pct, pairs)
    hit = np.zeros(len(left), bool)
    for i, j in tile.blocks():
        most = 1
        while len(i):
            # The next candidates of each entry; their number doubles.
            nth = np.arange(len(i)) - np.searchsorted(i, i)
            now = nth < most
            at, _ = tile.matching(i[now], j[now])
            hit[i[now][at]] = True
            rest = ~now & ~hit[i]
            i, j, most = i[rest], j[rest], most * 2
    return left.loc[hit, ["title", "price"]]


def _bands(df: DataFrame, cfg: MatchConfig, title: str, price: str, seq: str, tile_rows: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entries with their price and length band, the number of chunks of each block of bands, and the entries of each
    price band and length."""
    price_width = -math.log(1 - cfg.price_pct) * 1.0001
    length_width = math.log((2 - cfg.title_ratio) / cfg.title_ratio) * 1.0001
    size = F.length("title")
    rows = cut(title_entries(df, title, price, seq)).withColumn("pb", F.floor(F.ln("price") / price_width)).withColumn(
        "lb", F.when(size > 0, F.floor(F.ln(size) / length_width)).otherwise(F.lit(-2))
    )
    # Longer titles, smaller tiles: a tile's memory stays about the same.
    longest = F.exp((F.col("lb") + 1) * F.lit(length_width))
    per_tile = F.greatest(F.lit(1.0), F.lit(float(tile_rows)) * F.least(F.lit(1.0), F.lit(128.0) / longest))
    sizes = cut(rows.groupBy("pb", "lb", size.alias("size")).agg(F.count("*").alias("n")))
    blocks = sizes.groupBy("pb", "lb").agg(F.sum("n").alias("n"))
    return rows, blocks.select("pb", "lb", F.ceil(F.col("n") / per_tile).cast("int").alias("chunks")), sizes


_TILE = ["pb", "lb", "pb2", "lb2", "i", "j"]


def _chunk(n: str) -> Column:
    return F.pmod(F.xxhash64("title", "price"), F.col(n)).cast("int")


def _tile_links(
    left_blocks: DataFrame, right_blocks: DataFrame, offsets: list[tuple[int, int]], done: set[tuple[int, int]] = frozenset()
) -> tuple[DataFrame, int, int]:
    """Blocks whose entries can match, at the given offsets of bands; the number of tiles; the most chunks on the right.
    Pairs of length bands that are ``done`` are left out."""
    reach = F.explode(F.array(*[F.struct(F.lit(p).alias("dp"), F.lit(l).alias("dl")) for p, l in offsets]))
    there = left_blocks.select("pb", "lb", F.col("chunks").alias("lc"), reach.alias("o"))
    links = there.select("pb", "lb", "lc", (F.col("pb") + F.col("o.dp")).alias("pb2"), (F.col("lb") + F.col("o.dl")).alias("lb2")).join(
        right_blocks.select(F.col("pb").alias("pb2"), F.col("lb").alias("lb2"), F.col("chunks").alias("rc")), ["pb2", "lb2"]
    )
    for lb, lb2 in sorted(done):
        links = links.filter((F.col("lb") != lb) | (F.col("lb2") != lb2))
    # Bands are few, whatever the number of entries; counted all the same before a broadcast.
    links = cut(links)
    n_links, tiles, most = links.agg(F.count("*"), F.sum(F.col("lc") * F.col("rc")), F.max("rc")).first()
    return (F.broadcast(links) if n_links <= BROADCAST_ROWS else links), tiles or 0, most or 0


def _write_chunks(rows: DataFrame, blocks: DataFrame) -> str:
    """Entries written once, a file for each chunk, in a new folder of the shared one."""
    folder = work_folder(rows.sparkSession, "titles")
    kept = rows.join(blocks, ["pb", "lb"]).select("pb", "lb", _chunk("chunks").alias("chunk"), "title", "price", "first", "last")
    kept.repartition("pb", "lb", "chunk").write.partitionBy("pb", "lb", "chunk").parquet(folder)
    return folder


def read_chunk(folder: str, pb: int, lb: int, chunk: int) -> pd.DataFrame | None:
    """One chunk of ``_write_chunks``; no entry may have come to it."""
    files, root = file_system(folder)
    found = files.get_file_info(fs.FileSelector(f"{root}/pb={pb}/lb={lb}/chunk={chunk}", allow_not_found=True))
    parts = [pq.ParquetFile(files.open_input_file(f.path)).read().to_pandas() for f in found if f.base_name.endswith(".parquet")]
    return pd.concat(parts, ignore_index=True) if parts else None


# Tasks of a comparison: enough of them, however many tiles each of them has.
TILE_TASKS = 20_000


def _in_tiles(tiles: DataFrame, n: int, folders: tuple[str, str], compare: Callable, schema: str) -> DataFrame:
    """``compare(left chunk, right chunk, both are the same)`` of each tile. A tile is six numbers and its task reads the two
    chunks, so an entry is written once and not for each chunk that it is compared with."""
    left, right = folders

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for t in batch[_TILE].itertuples(index=False):
                same = left == right and (t.pb, t.lb, t.i) == (t.pb2, t.lb2, t.j)
                lhs = read_chunk(left, t.pb, t.lb, t.i)
                rhs = lhs if same or lhs is None else read_chunk(right, t.pb2, t.lb2, t.j)
                if lhs is not None and rhs is not None:
                    yield compare(lhs, rhs, same)

    # Tiles are a few numbers but heavy in work: an explicit count keeps the engine from
    # packing them into few tasks.
    floor = int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tiles.select(*_TILE).repartition(max(floor, min(n // 4, TILE_TASKS))).mapInPandas(read, schema)


# Keys are made in place of comparing all pairs where that is less work: a title has no more of them than this, a pair of length
# bands has this many pairs or more, and a key takes as long as this many pairs.
MOST_KEYS = 1 << 16
KEYED_FROM = 1 << 31
KEY_WORK = 1.0
# Entries of a group of price bands, and keys of a task.
GROUP_ROWS = 1_000_000
TASK_KEYS = 1 << 31
# Pairs of entries that are compared together.
BATCH_PAIRS = 1 << 15
# Lengths in price bands up to which they are looked at in one place.
MOST_SIZES = 200_000


def _needed(a: int, b: int, ratio: float) -> int:
    return math.ceil(ratio * (a + b) / 2 - 1e-9)


def _keyed_units(left: DataFrame, right: DataFrame, two: bool, ratio: float, keyed_from: int) -> tuple[list[tuple], set[tuple[int, int]]]:
    """The tasks of the keyed comparison, and the pairs of length bands that it covers.

    A task is ``(core bands, all bands, left length, right length, shared characters, side of the keys, part, parts)``. A group
    of price bands, its core, reads the next band too (with two inputs, of the right one those on either side).
    """
    sides = [x.filter("size > 0 and pb is not null").limit(MOST_SIZES + 1).toPandas() for x in ((left, right) if two else (left,))]
    if any(len(x) > MOST_SIZES or x.empty for x in sides):
        return [], set()
    lhs, rhs = sides[0], sides[-1]
    units, done = [], set()
    for lb, lb2 in sorted({(a, a + d) for a in lhs["lb"].unique().tolist() for d in ((-1, 0, 1) if two else (0, 1))}):
        a, b = lhs[lhs["lb"] == lb], rhs[rhs["lb"] == lb2]
        if a.empty or b.empty:
            continue
        at_a, at_b = (x.groupby("pb")["n"].sum() for x in (a, b))
        pairs = sum(float((at_a * at_b.rename(lambda p, d=d: p - d)).sum()) for d in (-1, 0, 1))
        size_a, size_b = (x.groupby("size")["n"].sum() for x in (a, b))
        lengths = [(x, y, _needed(x, y, ratio)) for x in size_a.index.tolist() for y in size_b.index.tolist() if two or lb != lb2 or x <= y]
        lengths = [(x, y, need) for x, y, need in lengths if need <= min(x, y)]
        count = {(x, y): keyed.key_count(x, y, need) for x, y, need in lengths}
        work = sum(count[x, y] * float(size_a[x] + size_b[y] * (two or x != y)) for x, y, _ in lengths)
        if max(count.values(), default=0) > MOST_KEYS or max(size_a.index.max(), size_b.index.max()) > 64 or pairs < keyed_from or (keyed_from and pairs < KEY_WORK * work):
            continue
        done |= {(lb, lb2), (lb, lb2) if two else (lb2, lb)}
        for x, y, need in lengths:
            n = a[a["size"] == x].groupby("pb")["n"].sum()
            n = n.add(b[b["size"] == y].groupby("pb")["n"].sum(), fill_value=0) if two or x != y else n
            bands, core, held = sorted(n.index.tolist()), [], 0
            for k, pb in enumerate(bands):
                core.append(pb)
                held += int(n[pb])
                if held < GROUP_ROWS and k < len(bands) - 1:
                    continue
                every = sorted({p + d for p in core for d in ((-1, 0, 1) if two else (0, 1))} & set(bands))
                rows = sum(int(n[p]) for p in every)
                parts = 1 << (max(1, int(rows * count[x, y] / 2 // TASK_KEYS)) - 1).bit_length()
                units += [(rows / parts, (core, every, x, y, need, side, part, parts)) for side in (0, 1) for part in range(parts)]
                core, held = [], 0
    return [u for _, u in sorted(units, key=lambda u: -u[0])], done


def _write_sizes(rows: DataFrame, sizes: set[int]) -> str:
    """Entries of the lengths written once, a folder for each price band and length."""
    folder = work_folder(rows.sparkSession, "sizes")
    kept = rows.withColumn("size", F.length("title")).filter(F.col("size").isin(sorted(sizes)) & F.col("pb").isNotNull())
    kept = kept.select("pb", "size", "title", "price", "first", "last")
    kept.repartition("pb", "size", F.pmod(F.xxhash64("title", "price"), F.lit(4))).write.partitionBy("pb", "size").parquet(folder)
    return folder


def _read_sizes(folder: str, bands: list[int], size: int) -> pa.Table:
    """Entries of one length in some price bands, with ``pb``, always in the same order."""
    files, root = file_system(folder)
    parts = [pa.table({"title": pa.array([], pa.string()), "price": np.empty(0), "first": np.empty(0, int), "last": np.empty(0, int), "pb": np.empty(0, int)})]
    for pb in bands:
        found = files.get_file_info(fs.FileSelector(f"{root}/pb={pb}/size={size}", allow_not_found=True))
        for f in sorted((f for f in found if f.base_name.endswith(".parquet")), key=lambda f: f.base_name):
            part = pq.ParquetFile(files.open_input_file(f.path)).read()
            part = part.append_column("pb", pa.array(np.full(len(part), pb)))
            parts.append(part.select(parts[0].column_names).cast(parts[0].schema))
    return pa.concat_tables(parts)


def _entry_pairs(x: np.ndarray, y: np.ndarray, left: tuple, right: tuple) -> Iterator[Pairs]:
    """Entries of the titles ``x[k]`` and ``y[k]``, a bounded number at a time. A side is its entries by title and where each
    title's start."""
    (rows, starts), (others, bounds) = left, right
    sizes = (starts[x + 1] - starts[x]) * (bounds[y + 1] - bounds[y])
    for some in np.array_split(np.arange(len(x)), max(1, int(sizes.sum()) // keyed.PAIRS_HELD)):
        for i, k in keyed.expand(some, starts[x[some]], starts[x[some] + 1], rows):
            for e, j in keyed.expand(np.arange(len(i)), bounds[y[i]], bounds[y[i] + 1], others):
                yield k[e], j


def _grouped(i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each pair the least entry that its entries are joined to."""
    ids, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    a, b = at[: len(i)], at[len(i) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[a], label[b])
        now = label.copy()
        np.minimum.at(now, a, low)
        np.minimum.at(now, b, low)
        now = now[now]
        if (now == label).all():
            return label[a]
        label = now


def keyed_titles(
    lhs: pa.Table, rhs: pa.Table | None, sizes: tuple[int, int], need: int, core: list[int], side: int, share: tuple[int, int], pct: float, compare: Callable
) -> Iterator[pd.DataFrame]:
    """``compare`` over the pairs of entries that some keys lead to, a batch of pairs that hang together at a time.

    With one input (``rhs`` is none) both lengths are in ``lhs``; a pair has an entry in the core bands.
    """
    own = rhs is None
    rows = lhs if own else pa.concat_tables([lhs, rhs])
    if not len(rows):
        return
    left = np.arange(len(rows)) < len(lhs)
    edge = ~np.isin(rows["pb"].to_numpy(), core)
    title, titles = pd.factorize(np.array(rows["title"].to_pylist(), object))
    titles = titles.tolist()
    kinds = sorted(set(sizes))
    texts = [titles]
    if len(kinds) > 1:  # places are those of the shorter titles first
        longer = np.array([len(t) for t in titles]) == kinds[1]
        order = np.argsort(longer, kind="stable")
        title = np.argsort(order)[title]
        titles = [titles[k] for k in order.tolist()]
        texts = [titles[: int((~longer).sum())], titles[int((~longer).sum()) :]]
    n = len(titles)
    part, of = share

    found = [low * n + high for low, high in keyed.near_pairs(texts, kinds, need, side, share)]
    x, y = np.divmod(np.unique(np.concatenate([np.empty(0, np.int64), *found])), n)
    equal = np.arange(part, n, of) if side == 0 and len(kinds) == 1 else np.empty(0, np.int64)

    def by_title(some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        entries = np.flatnonzero(some)
        entries = entries[np.argsort(title[entries], kind="stable")]
        return entries, np.searchsorted(title[entries], np.arange(n + 1))

    price = rows["price"].to_numpy()
    if own:
        entries = by_title(np.ones(len(rows), bool))
        asks = [(x, y, entries, entries), (equal, equal, entries, entries)]
    else:
        entries, others = by_title(left), by_title(~left)
        asks = [(x, y, entries, others), (y, x, entries, others), (equal, equal, entries, others)]
    pairs = []
    for x, y, a, b in asks:
        for i, j in _entry_pairs(x, y, a, b):
            some = np.abs(price[i] - price[j]) / np.maximum(price[i], price[j]) <= pct
            if own:  # entries of one title meet both ways
                some &= ~(edge[i] & edge[j]) & ((title[i] != title[j]) | (i > j))
            pairs.append((i[some], j[some]))
    i, j = (np.concatenate([np.empty(0, np.int64), *(p[k] for p in pairs)]) for k in (0, 1))
    if not len(i):
        return
    label = _grouped(i, j)
    by = np.lexsort((j, i, label))
    i, j, label = i[by], j[by], label[by]
    heads = np.flatnonzero(np.diff(label, prepend=-1))
    at = 0
    while at < len(i):
        ends = np.searchsorted(heads, at + BATCH_PAIRS)
        to = min(int(heads[ends]) if ends < len(heads) else len(i), at + 64 * BATCH_PAIRS)
        a, b = i[at:to], j[at:to]
        if own:
            ids, k = np.unique(np.concatenate([a, b]), return_inverse=True)
            u, v = k[: len(a)], k[len(a) :]
            some = rows.take(ids).to_pandas()
            yield compare(some, some, True, (np.maximum(u, v), np.minimum(u, v)))
        else:
            (ids, u), (others, v) = (np.unique(z, return_inverse=True) for z in (a, b))
            by = np.lexsort((v, u))
            yield compare(rows.take(ids).to_pandas(), rows.take(others).to_pandas(), False, (u[by], v[by]))
        at = to


def _in_units(spark: SparkSession, units: list[tuple], folders: tuple[str, str], two: bool, pct: float, compare: Callable, schema: str) -> DataFrame:
    """The keyed comparison, a task for each unit."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in batch["id"].tolist():
                core, every, x, y, need, side, part, parts = units[k]
                if two:
                    lhs, rhs = _read_sizes(folders[0], core, x), _read_sizes(folders[1], every, y)
                else:
                    lhs, rhs = pa.concat_tables([_read_sizes(folders[0], every, size) for size in sorted({x, y})]), None
                yield from keyed_titles(lhs, rhs, (x, y), need, core, side, (part, parts), pct, compare)

    # A pair may be met by several keys.
    return spark.range(0, len(units), 1, len(units)).mapInPandas(run, schema).distinct()


_PAIR = "later_title string, later_price double, earlier_title string, earlier_price double, ratio double"


def fuzzy_title_join(
    a: DataFrame,
    b: DataFrame | None = None,
    cfg: MatchConfig = MatchConfig(),
    title: str = "title",
    price: str = "price_eur",
    seq: str = "seq",
    tile_rows: int = TILE_ROWS,
    thin: bool = False,
    keyed_from: int = KEYED_FROM,
) -> DataFrame:
    """Title/price entries that match: ``(later_title, later_price, earlier_title,
    earlier_price, ratio)``.

    The ratio is not symmetric, so each row says which entry takes the later place; with
    one input a direction is present when some member of it can arrive later. With two
    inputs, ``a`` is later. Equal entries (always ratio 1) are not listed with one input.
    ``thin``, with one input, leaves out pairs that other pairs of the result lead to (``link_titles``).

    Exact. Entries are blocked by price band and length band such that matches lie in the
    same or adjacent bands. Where bands have ``keyed_from`` pairs or more and their titles are short enough, pairs are found by keys
    of each title (``keyed``), which is linear in the titles. Every other block is cut into hashed chunks of about ``tile_rows`` from
    counted block sizes, each written once, and one task compares one chunk with another, reading both: a band that holds
    a third of all entries becomes many equal tiles, and only matches leave a tile.
    """
    left, left_blocks, left_sizes = _bands(a, cfg, title, price, seq, tile_rows)
    # Offsets (price band, length band) from the left block to the right one.
    if b is None:
        right, right_blocks, right_sizes = left, left_blocks, left_sizes
        offsets = [(0, 0), (0, 1), (1, -1), (1, 0), (1, 1)]
    else:
        right, right_blocks, right_sizes = _bands(b, cfg, title, price, seq, tile_rows)
        offsets = [(p, l) for p in (-1, 0, 1) for l in (-1, 0, 1)]
    ratio, pct, two = cfg.title_ratio, cfg.price_pct, b is not None

    def compare(lhs: pd.DataFrame, rhs: pd.DataFrame, same: bool, pairs: Pairs | None = None) -> pd.DataFrame:
        if thin and not two:
            return link_titles(lhs, rhs, same, ratio, pct, pairs)
        return compare_titles(lhs, rhs, same, not two, ratio, pct, pairs)

    units, done = _keyed_units(left_sizes, right_sizes, two, ratio, keyed_from)
    links, n, _ = _tile_links(left_blocks, right_blocks, offsets, done)
    found = []
    if units:
        folder = _write_sizes(left, {k for u in units for k in (u[2:4] if b is None else u[2:3])})
        folders = (folder, folder if b is None else _write_sizes(right, {u[3] for u in units}))
        found.append(_in_units(left.sparkSession, units, folders, two, pct, compare, _PAIR))
    if n or not found:
        own = (F.col("pb") == F.col("pb2")) & (F.col("lb") == F.col("lb2")) if b is None else F.lit(False)
        tiles = links.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("lc") - 1))).withColumn(
            "j", F.explode(F.sequence(F.when(own, F.col("i")).otherwise(F.lit(0)), F.col("rc") - 1))
        )
        folder = _write_chunks(left, left_blocks)
        folders = (folder, folder if b is None else _write_chunks(right, right_blocks))
        found.append(_in_tiles(tiles, n, folders, compare, _PAIR))
    return reduce(DataFrame.unionByName, found)


def fuzzy_title_hits(
    a: DataFrame,
    b: DataFrame,
    cfg: MatchConfig = MatchConfig(),
    title: str = "title",
    price: str = "price_eur",
    tile_rows: int = TILE_ROWS,
    keyed_from: int = KEYED_FROM,
) -> DataFrame:
    """``(title, price)`` of the entries of ``a`` that match some entry of ``b``, ``a`` being later; one row each.

    An existence join: a tile asks for the candidates of an entry until the first match, and no pair leaves it.
    Crowded bands of short titles are looked at by keys first, as in ``fuzzy_title_join``. Of the others the right chunks are
    looked at in turns of 1, 2, 4 ...; entries that are decided leave before the next turn.
    """
    rows = lambda df: df.select(F.col(title).alias("title"), F.col(price).alias("price"), F.lit(0).alias("seq"))
    left, left_blocks, left_sizes = _bands(rows(a), cfg, "title", "price", "seq", tile_rows)
    right, right_blocks, right_sizes = _bands(rows(b), cfg, "title", "price", "seq", tile_rows)
    ratio, pct = cfg.title_ratio, cfg.price_pct
    schema = "title string, price double"

    def compare(lhs: pd.DataFrame, rhs: pd.DataFrame, same: bool, pairs: Pairs | None = None) -> pd.DataFrame:
        return hit_titles(lhs, rhs, ratio, pct, pairs)

    units, done = _keyed_units(left_sizes, right_sizes, True, ratio, keyed_from)
    links, n, most = _tile_links(left_blocks, right_blocks, [(p, l) for p in (-1, 0, 1) for l in (-1, 0, 1)], done)
    found: list[DataFrame] = []
    if units:
        folders = (_write_sizes(left, {u[2] for u in units}), _write_sizes(right, {u[3] for u in units}))
        found.append(cut(_in_units(left.sparkSession, units, folders, True, pct, compare, schema)))
        if n:
            left = cut(left.join(found[-1], ["title", "price"], "left_anti"))
    there = _write_chunks(right, right_blocks) if n or not found else ""
    lo = 0
    while lo < most or not found:
        hi = 2 * lo + 1
        tiles = links.filter(F.col("rc") > lo).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("lc") - 1)))
        tiles = tiles.withColumn("j", F.explode(F.sequence(F.lit(lo), F.least(F.col("rc"), F.lit(hi)) - 1)))
        n = links.filter(F.col("rc") > lo).agg(F.sum(F.col("lc") * F.least(F.col("rc") - lo, F.lit(hi - lo)))).first()[0]
        hits = _in_tiles(tiles, n or 0, (_write_chunks(left, left_blocks), there), compare, schema)
        found.append(cut(hits.distinct()))
        lo = hi
        if lo < most:
            left = cut(left.join(found[-1], ["title", "price"], "left_anti"))
    return reduce(DataFrame.unionByName, found)


# --- the cascade ---------------------------------------------------------------------------

CODE_LAYER, GRID_LAYER, TITLE_LAYER = 1, 2, 3


def _signature(layer: int, *parts: Column) -> Column:
    return F.concat_ws("|", F.lit(str(layer)), *[p.cast("string") for p in parts])


def layer_members(df: DataFrame, cfg: MatchConfig, seq: str = "seq") -> DataFrame:
    """``(sig, seq)``: the signature of each row in every layer that applies to it."""
    rows = grid_signature(df, cfg)
    grid = F.when(
        F.col("cell").isNotNull(), _signature(GRID_LAYER, F.col("cell"), F.col("price_cell"), F.col("m2"))
    )
    titled = F.when(
        F.col("price_eur") > 0,
        _signature(TITLE_LAYER, F.col("price_eur"), text.normalize_title(F.col("title"))),
    )
    coded = F.when(F.col("code").isNotNull(), _signature(CODE_LAYER, F.col("code")))
    return rows.select(
        F.explode(F.array_compact(F.array(coded, grid, titled))).alias("sig"), F.col(seq).alias("seq")
    )


def layer_links(df: DataFrame, cfg: MatchConfig) -> DataFrame:
    """``(later_sig, earlier_sig)``: signatures whose rows match when arriving in that order."""
    coded = hamming_join(df, max_dist=cfg.max_hamming).select(
        _signature(CODE_LAYER, F.col("code_a")).alias("x"), _signature(CODE_LAYER, F.col("code_b")).alias("y")
    )
    cells = grid_bucket_join(df, cfg=cfg).select(
        _signature(GRID_LAYER, F.col("cell"), F.col("price_cell"), F.col("m2_a")).alias("x"),
        _signature(GRID_LAYER, F.col("cell"), F.col("price_cell"), F.col("m2_b")).alias("y"),
    )
    either = coded.unionByName(cells)
    titles = fuzzy_title_join(df, cfg=cfg, thin=True).select(
        _signature(TITLE_LAYER, F.col("later_price"), F.col("later_title")).alias("later_sig"),
        _signature(TITLE_LAYER, F.col("earlier_price"), F.col("earlier_title")).alias("earlier_sig"),
    )
    return (
        either.select(F.col("x").alias("later_sig"), F.col("y").alias("earlier_sig"))
        .unionByName(either.select(F.col("y").alias("later_sig"), F.col("x").alias("earlier_sig")))
        .unionByName(titles)
    )


# Arrivals are looked at in spans of this many sequence numbers, which bounds every window.
SPAN = 65_536


def thread_edges(members: DataFrame, links: DataFrame) -> DataFrame:
    """Rows of equal and of linked signatures as a sparse set of edges ``(later, earlier, sig)``.

    Each row points to the previous row of its own signature. For linked signatures A and B,
    each row of the one with fewer rows points to the row of the other just before it, and is
    pointed to by the row just after it. Every earlier matching row is then reachable
    through earlier rows, with at most two edges per row of the smaller side instead of
    one per pair.

    Lookups run inside (signature, span of arrivals): sequence numbers are unique, so no window
    holds more than twice a span, whatever the size of the group. What precedes and
    follows a span is read from one row per span.
    """
    sizes = members.groupBy("sig").agg(F.count("*").alias("n"))
    later = F.col("later_sig")
    pairs = (
        links.select(
            F.least("later_sig", "earlier_sig").alias("a"),
            F.greatest("later_sig", "earlier_sig").alias("b"),
            (later == F.least("later_sig", "earlier_sig")).alias("a_later"),
        )
        .groupBy("a", "b")
        .agg(F.max("a_later").alias("a_later"), F.max(~F.col("a_later")).alias("b_later"))
        .join(sizes.withColumnsRenamed({"sig": "a", "n": "na"}), "a")
        .join(sizes.withColumnsRenamed({"sig": "b", "n": "nb"}), "b")
    )
    a_small = F.col("na") <= F.col("nb")
    asks = pairs.select(
        F.when(a_small, F.col("a")).otherwise(F.col("b")).alias("small"),
        F.when(a_small, F.col("b")).otherwise(F.col("a")).alias("sig"),
        F.when(a_small, F.col("a_later")).otherwise(F.col("b_later")).alias("ask_before"),
        F.when(a_small, F.col("b_later")).otherwise(F.col("a_later")).alias("ask_after"),
    )
    asks = members.withColumnRenamed("sig", "small").join(asks, "small").select(
        "sig", "seq", F.lit(False).alias("member"), "ask_before", "ask_after"
    )
    line = members.select(
        "sig", "seq", F.lit(True).alias("member"), F.lit(True).alias("ask_before"), F.lit(False).alias("ask_after")
    ).unionByName(asks)
    line = line.withColumn("span", F.floor(F.col("seq") / F.lit(float(SPAN))).cast("bigint")).withColumn(
        "own", F.when(F.col("member"), F.col("seq"))
    )
    spans = line.groupBy("sig", "span").agg(F.min("own").alias("lo"), F.max("own").alias("hi"))
    by_span = Window.partitionBy("sig").orderBy("span")
    spans = spans.select(
        "sig",
        "span",
        F.last("hi", True).over(by_span.rowsBetween(Window.unboundedPreceding, -1)).alias("span_before"),
        F.first("lo", True).over(by_span.rowsBetween(1, Window.unboundedFollowing)).alias("span_after"),
    ).filter("span_before is not null or span_after is not null")
    inside = Window.partitionBy("sig", "span").orderBy("seq")
    line = line.select(
        "*",
        F.last("own", True).over(inside.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
        F.first("own", True).over(inside.rowsBetween(1, Window.unboundedFollowing)).alias("after"),
    ).join(spans, ["sig", "span"], "left")
    before, after = F.coalesce("before", "span_before"), F.coalesce("after", "span_after")
    arrows = F.array(
        F.when(F.col("ask_before") & before.isNotNull(), F.struct(F.col("seq").alias("later"), before.alias("earlier"))),
        F.when(F.col("ask_after") & after.isNotNull(), F.struct(after.alias("later"), F.col("seq").alias("earlier"))),
    )
    return line.select("sig", F.explode(F.array_compact(arrows)).alias("e")).select(
        "e.later", "e.earlier", "sig"
    )


def same_flat_edges(df: DataFrame, cfg: MatchConfig = MatchConfig(), seq: str = "seq") -> DataFrame:
    """Edges ``(later, earlier, layer)`` of the cascade: image code, then grid cell, then title.

    Sparse: a pair that matches is connected through earlier rows, not always directly.
    ``df`` has ``seq, code, lat, lng, m2, price_eur, title``.
    """
    rows = cut(df.select(seq, "code", "lat", "lng", "m2", "price_eur", "title"))
    edges = thread_edges(cut(layer_members(rows, cfg, seq)), cut(layer_links(rows, cfg)))
    layer = F.substring_index("sig", "|", 1).cast("int")
    return edges.groupBy("later", "earlier").agg(F.min(layer).alias("layer"))


def skipped_dup_antijoin(df: DataFrame, hidden: DataFrame, cfg: MatchConfig = MatchConfig()) -> DataFrame:
    """Rows that are not the same flat as any hidden one, by image code or by title and price.

    Hidden rows have no coordinates, so the grid layer does not apply. Matching happens between
    signatures; rows are then dropped by equality.
    """
    left = post_dup_antijoin(df, hidden, cfg)
    hits = fuzzy_title_hits(df, hidden, cfg).select(F.col("title").alias("_t"), F.col("price").alias("_p"))
    same = (text.normalize_title(F.col("title")) == F.col("_t")) & (F.col("price_eur") == F.col("_p"))
    return left.join(hits, same, "left_anti")


def post_dup_antijoin(df: DataFrame, known: DataFrame, cfg: MatchConfig = MatchConfig()) -> DataFrame:
    """Rows whose image code is not within reach of a known one; rows without a code stay.

    Rows without a code may be many and match nothing: a hash of the row spreads them, as they
    would all meet in one task otherwise.
    """
    hits = hamming_join(df, known, max_dist=cfg.max_hamming).select(
        F.col("code_a").alias("code"), F.lit(0).cast("bigint").alias("_spread")
    )
    plain = [c for c, t in df.dtypes if not t.startswith(("map", "array", "struct", "variant"))]
    spread = F.when(F.col("code").isNull(), F.xxhash64(*plain)).otherwise(F.lit(0).cast("bigint"))
    keys = ["code", "_spread"]
    return df.withColumn("_spread", spread).join(hits.distinct(), keys, "left_anti").drop("_spread")

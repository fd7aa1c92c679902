"""Pairs of texts with a long common subsequence, found by keys of each text instead of text by text.

Take two texts with a common subsequence of n characters, k characters of both being outside of it, and any
m1 + m2 = n + 1. The m1-th character of the subsequence is then among its first m1 and among its last m2. What both
texts skip before it and what they skip after it is k together, so for E1 + E2 = k - 1 they skip at most E1 before it or at
most E2 after it. A text's keys are thus its subsequences of m1 characters that skip at most E1 characters from its start on, and
those of m2 that skip at most E2 from its end on: texts that match share one, whatever they are made of.

Their number, (m1 + E1 over E1) + (m2 + E2 over E2), follows the lengths alone, so the work is linear in the texts. Keys that skip
many characters only meet those that skip few, so only the latter are kept, and the others are looked up as they are made.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np

# Keys kept at a time; more are divided by the first characters that they take.
KEPT = 1_500_000
# Slots of the tables that tell which keys are kept.
SLOTS_A_KEY, MOST_SLOTS = 40, 24
# Pairs of texts up to which all are named.
ALL_PAIRS = 1 << 20
# Texts whose keys are made together.
BLOCK = 8_192
# Pairs of places that are held at a time.
PAIRS_HELD = 1 << 22
_MIX = np.uint64(0x9E3779B97F4A7C15)


def skipped(size_a: int, size_b: int, need: int) -> int:
    """Characters of both texts outside of a common subsequence of ``need``."""
    return size_a + size_b - 2 * need


def shares(need: int, skip: int) -> list[list[tuple[int, int]]]:
    """The ways to divide ``need`` characters and ``skip`` others: ``(m, most skipped)`` from the start and from the end."""
    if skip <= 0:
        return [[(need, 0)]]
    low = (skip - 1) // 2
    return [[(m, skip - 1 - low), (need + 1 - m, low)] for m in range(1, need + 1)]


def keys_of(share: list[tuple[int, int]]) -> int:
    return sum(math.comb(m + most, most) for m, most in share)


def key_count(size_a: int, size_b: int, need: int) -> int:
    """Keys of a text, divided in the middle."""
    ways = shares(need, skipped(size_a, size_b, need))
    return keys_of(ways[(len(ways) - 1) // 2])


def choose(need: int, skip: int, n: int, letters: float) -> list[tuple[int, int]]:
    """The way with the least work for ``n`` texts whose characters agree once in ``letters``: keys made and pairs met by chance."""

    def work(share: list[tuple[int, int]]) -> float:
        met = 0.0
        for m, most in share:
            made = [math.comb(m - 1 + s, s) for s in range(most + 1)]
            met += sum(made[s] * sum(made[: most - s + 1]) for s in range(most + 1)) / letters**m
        return keys_of(share) + 20 * n * met

    return min(shares(need, skip), key=work)


def matrix(sides: list[list[str]], sizes: list[int]) -> tuple[list[np.ndarray], int]:
    """The texts of each side, all of one size, as numbers of their characters: a row for each place. And how many characters there are."""
    points = [np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, size) for texts, size in zip(sides, sizes, strict=True)]
    used = np.zeros(1 + max((int(p.max()) for p in points if p.size), default=0), bool)
    for p in points:
        used[p.ravel()] = True
    letters = int(used.sum())
    number = (np.cumsum(used) - 1).astype(np.uint8 if letters <= 1 << 8 else np.uint16 if letters <= 1 << 16 else np.uint32)
    return [np.ascontiguousarray(number[p].T) for p in points], letters


def share(places: list[np.ndarray], letters: int, x: np.ndarray, y: np.ndarray, need: int) -> np.ndarray:
    """Whether the texts ``x[k]`` and ``y[k]``, places in those of both sides, share a subsequence of ``need`` characters; those of the
    last side have 64 or fewer. Bit-parallel over the right text (Hyyro, "Bit-parallel LCS-length computation revisited", 2004)."""
    left, right = places[0], places[-1]
    y = y - (left.shape[1] if len(places) > 1 else 0)
    out = np.empty(len(x), bool)
    step = max(256, (1 << 20) // letters)
    for at in range(0, len(x), step):
        a, b = left[:, x[at : at + step]], right[:, y[at : at + step]]
        n = a.shape[1]
        base = np.arange(n) * letters
        masks = np.zeros(n * letters, np.uint64)
        for q in range(len(b)):
            masks[base + b[q]] |= np.uint64(1 << q)
        v = np.full(n, np.uint64(0xFFFFFFFFFFFFFFFF))
        for row in a:
            u = v & masks.take(base + row)
            v = (v + u) | (v - u)
        out[at : at + step] = np.bitwise_count(~v) >= need
    return out


def _outer(places: list[np.ndarray]) -> int:
    """Places at which all texts agree, from the first on."""
    reach = min(len(p) for p in places)
    return next((k for k in range(reach) if any((p[k] != places[0][k, 0]).any() for p in places)), reach)


def _letters(places: list[np.ndarray]) -> float:
    """How rarely two characters of some texts agree."""
    some = np.concatenate([p[:, :: max(1, p.shape[1] // 2_000)].ravel() for p in places])
    counts = np.unique(some, return_counts=True)[1] / max(1, len(some))
    return max(1.5, 1 / float((counts**2).sum()))


class _Keys:
    """Keys of ``m`` characters that skip at most ``most``, read from the first row of ``places`` on."""

    def __init__(self, places: list[np.ndarray], m: int, most: int, parts: int):
        self.m, self.most, self.parts = m, most, parts
        self.places = [p[: m + most] for p in places]
        self.starts = np.cumsum([0, *[p.shape[1] for p in places]])
        top = max((int(p.max(initial=0)) for p in self.places), default=0)
        # A key is a sum of random numbers, one for each character and its place in the key.
        self.table = np.random.default_rng(20_260_601).integers(0, 1 << 63, (m, top + 1), np.uint64) * np.uint64(2)

    def value(self, t: int, chars: np.ndarray) -> np.ndarray:
        return self.table[t].take(chars)

    def leads(self) -> list[tuple[int, np.ndarray, int, int, np.ndarray | None]]:
        """The ways to take a key's first characters, and the part that each text's keys are of then."""
        out = []
        for start, p in zip(self.starts.tolist(), self.places, strict=False):
            width = min(len(p), self.m + self.most) if p.shape[1] else 0
            for q0 in range(min(width, self.most + 1)) if width >= self.m else ():
                for q1 in range(q0 + 1, min(width, self.most + 2)) if self.m > 1 else [q0]:
                    of = None
                    if self.parts > 1:
                        h = (self.value(0, p[q0]) + (self.value(1, p[q1]) if self.m > 1 else np.uint64(0))) * _MIX
                        of = ((h >> np.uint64(40)) & np.uint64(self.parts - 1)).astype(np.uint8 if self.parts <= 1 << 8 else np.uint32)
                    out.append((start, p, q0, q1, of))
        return out

    def walk(self, leads: list, part: int, most: int, leaf: Callable[[int, np.ndarray, np.ndarray], None]) -> Iterator[None]:
        """``leaf(skipped, keys, texts)`` for the keys of a part that skip at most ``most``; a stop after each block of texts."""
        lead = min(2, self.m)
        for start, p, q0, q1, of in leads:
            if q1 + 1 - lead > most:
                continue
            rows = np.arange(p.shape[1]) if of is None else np.flatnonzero(of == part)
            for at in range(0, len(rows), BLOCK):
                some = rows[at : at + BLOCK]
                h = self.value(0, p[q0].take(some))
                h = h + self.value(1, p[q1].take(some)) if lead == 2 else h
                self._below(p, q1 + 1, lead, h, some, (start + some).astype(np.uint64), most, leaf)
                yield

    def _below(self, p: np.ndarray, q: int, lead: int, h: np.ndarray, rows: np.ndarray, texts: np.ndarray, most: int, leaf: Callable) -> None:
        width = min(len(p), self.m + most)
        values = {}
        for k in range(q, width):
            chars = p[k].take(rows)
            values |= {(t, k): self.value(t, chars) for t in range(max(lead, k - most), min(self.m, k + 1))}
        # Where no more can be skipped, the rest of a key is the characters that follow.
        rest: dict[int, np.ndarray] = {self.m: np.uint64(0)}
        for t in range(self.m - 1, lead - 1, -1):
            if (t, t + most) not in values or t + 1 not in rest:
                break
            rest[t] = values[t, t + most] + rest[t + 1]

        def down(t: int, q: int, h: np.ndarray) -> None:
            if t == self.m:
                leaf(q - t, h, texts)
            elif q - t == most:
                if t in rest:
                    leaf(most, h + rest[t], texts)
            else:
                for k in range(q, min(width, t + most + 1)):
                    down(t + 1, k + 1, h + values[t, k])

        down(lead, q, h)


def expand(left: np.ndarray, lo: np.ndarray, hi: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each ``left[k]`` with each of ``right[lo[k]:hi[k]]``, a bounded number of pairs at a time."""
    n = hi - lo
    some = np.flatnonzero(n > 0)
    ends = np.cumsum(n[some])
    at = 0
    while at < len(some):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + PAIRS_HELD, "right")))
        now = some[at:to]
        size = n[now]
        offset = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        yield np.repeat(left[now], size), right[np.repeat(lo[now], size) + offset]
        at = to


def _met(keys: _Keys, leads: list, part: int, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of different texts that share a key of the part and may skip so few characters."""
    half, most = keys.most // 2, keys.most
    row_bits = np.uint64(int(n - 1).bit_length())
    row_mask = (np.uint64(1) << row_bits) - np.uint64(1)
    kept: list[list[np.ndarray]] = [[] for _ in range(half + 1)]

    def keep(skip: int, h: np.ndarray, texts: np.ndarray) -> None:
        kept[skip].append(h & ~row_mask | texts)  # the text stands in a key's low bits

    for _ in keys.walk(leads, part, half, keep):
        pass
    # For each number of characters a table of the keys that skip no more, small enough for a core to have it near.
    tables, shifts = [], []
    for skip in range(half + 1 if most > half else 0):
        some = [h for hs in kept[: skip + 1] for h in hs]
        bits = min(MOST_SLOTS, max(16, (SLOTS_A_KEY * sum(map(len, some))).bit_length()))
        table = np.zeros(1 << bits, bool)
        for h in some:
            table[h >> np.uint64(64 - bits)] = True
        tables.append(table)
        shifts.append(np.uint64(64 - bits))
    low = np.sort(np.concatenate([np.empty(0, np.uint64), *(h for hs in kept for h in hs)]))
    kept.clear()
    if not len(low):
        return
    code, texts = low >> row_bits, (low & row_mask).astype(np.int64)
    # Two that skip few: one and those that follow with its key.
    same = np.flatnonzero((low[1:] != low[:-1]) & (code[1:] == code[:-1]))
    yield from expand(texts[same], same + 1, np.searchsorted(code, code[same], "right"), texts)
    # One that skips many: looked up among those that skip few enough.
    asked: list[np.ndarray] = []

    def ask(skip: int, h: np.ndarray, rows: np.ndarray) -> None:
        if skip > half:
            few = min(most - skip, half)
            hit = np.flatnonzero(tables[few].take((h >> shifts[few]).view(np.int64)))
            asked.append(h.take(hit) & ~row_mask | rows.take(hit))

    def answers() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        high = np.sort(np.concatenate(asked or [low[:0]]))
        asked.clear()
        sought = high >> row_bits
        lo = np.searchsorted(code, sought)
        found = np.flatnonzero(code[np.minimum(lo, len(code) - 1)] == sought)
        yield from expand((high[found] & row_mask).astype(np.int64), lo[found], np.searchsorted(code, sought[found], "right"), texts)

    for _ in keys.walk(leads, part, most, ask) if most > half else ():
        if sum(map(len, asked)) > PAIRS_HELD:
            yield from answers()
    yield from answers()


def near_pairs(
    sides: list[list[str]], sizes: list[int], need: int, side: int, share_of: tuple[int, int]
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places, the lesser first, in the texts of all ``sides`` put one after another; side k's are of ``sizes[k]``
    characters. With two sides, pairs of a text of either.

    They share a subsequence of ``need`` characters; a pair may come more than once. ``side`` says
    by which of both kinds of keys they are found, and ``share_of`` which of how many parts of the keys (a power of two) is looked
    at: the pairs of all parts of both sides are whole together.
    """
    n, first = sum(len(s) for s in sides), len(sides[0])
    part, of = share_of
    if n < 2 or not all(sides):
        return
    places, letters = matrix(sides, sizes)
    # What stands at the start or the end of all texts is in a longest subsequence anyway.
    before = _outer(places)
    after = min(_outer([p[::-1] for p in places]), min(sizes) - before)
    need -= before + after
    skip = skipped(sizes[0] - before - after, sizes[-1] - before - after, need)
    places = [p[before : len(p) - after] for p in places]
    waiting: list[np.ndarray] = []

    def told() -> tuple[np.ndarray, np.ndarray]:
        x, y = np.divmod(np.unique(np.concatenate([np.empty(0, np.int64), *waiting])), n)
        waiting.clear()
        near = share(places, letters, x, y, need)
        return x[near], y[near]

    for x, y in _candidates(places, need, skip, side, part, of):
        low, high = np.minimum(x, y), np.maximum(x, y)
        some = (low < first) & (high >= first) if len(sides) > 1 else low < high
        waiting.append(low[some] * n + high[some])
        if sum(map(len, waiting)) > PAIRS_HELD:
            yield told()
    yield told()


def _candidates(places: list[np.ndarray], need: int, skip: int, side: int, part: int, of: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    n = sum(p.shape[1] for p in places)
    if need < 1 or n * (n - 1) // 2 <= ALL_PAIRS:
        if side == 0:  # the texts of this part with all that follow them
            for k in range(part, n - 1, of):
                yield np.full(n - 1 - k, k), np.arange(k + 1, n)
        return
    ways = choose(need, skip, n, _letters(places))
    if side >= len(ways):
        return
    if side:
        places = [p[::-1] for p in places]
    m, most = ways[side]
    few = n * math.comb(m + most // 2, most // 2)
    parts = of << (-(-few // (KEPT * of)) - 1).bit_length()
    keys = _Keys(places, m, most, parts)
    leads = keys.leads()
    for p in range(part, parts, of):
        yield from _met(keys, leads, p, n)

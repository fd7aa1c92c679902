"""Similarity ratios of many title pairs at once: twice the matched characters over both lengths.

The matched blocks are those of the standard library's sequence matcher: the longest common block, the first in
the left text and then in the right one among equally long ones, and so on to its left and right. All open
pieces of all pairs advance together through one table of common suffix lengths.
"""

from __future__ import annotations

import numpy as np

# Fixed values of the sequence matcher: from this length on, a character of the right text that stands in
# more than one of a hundred places (and one more) starts no block, though blocks grow over it.
LONG = 200
_NO_LEFT, _NO_RIGHT = np.uint32(0xFFFFFFFF), np.uint32(0xFFFFFFFE)  # beyond all characters, equal to none
CELLS = 1 << 21  # of a table that is worked on at a time


def _padded(points: list[np.ndarray], width: int, empty: np.uint32) -> np.ndarray:
    out = np.full((len(points), width), empty, np.uint32)
    sizes = np.array([len(p) for p in points], np.int64)
    rows = np.repeat(np.arange(len(points)), sizes)
    columns = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    if len(rows):
        out[rows, columns] = np.concatenate(points)
    return out


def _starters(points: np.ndarray) -> np.ndarray:
    """The right text, without the characters that start no block."""
    if len(points) < LONG:
        return points
    chars, counts = np.unique(points, return_counts=True)
    popular = chars[counts > len(points) // 100 + 1]
    return np.where(np.isin(points, popular), _NO_RIGHT, points)


def _longest(a: np.ndarray, b: np.ndarray, size_a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(start in a, start in b, size)`` of the longest common block of each row; the first of equally long ones."""
    n = len(a)
    run = np.zeros((n, b.shape[1]), np.int32)
    best = np.zeros(n, np.int32)
    at_a, at_b = np.zeros(n, np.int64), np.zeros(n, np.int64)
    live = np.arange(n)
    for i in range(a.shape[1]):
        if (size_a[live] <= i).any():
            keep = size_a[live] > i
            live, run = live[keep], run[keep]
            if not len(live):
                break
        same = b[live] == a[live, i][:, None]
        run[:, 1:] = np.where(same[:, 1:], run[:, :-1] + 1, 0)
        run[:, 0] = same[:, 0]
        j = run.argmax(1)
        top = run[np.arange(len(live)), j]
        more = top > best[live]
        rows = live[more]
        best[rows] = top[more]
        at_a[rows] = i - top[more] + 1
        at_b[rows] = j[more] - top[more] + 1
    return at_a, at_b, best.astype(np.int64)


def matched_characters(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Characters in matched blocks of each pair ``(left[k], right[k])`` of code point arrays."""
    n = len(left)
    total = np.zeros(n, np.int64)
    sizes = np.array([[len(a), len(b)] for a, b in zip(left, right, strict=True)], np.int64).reshape(n, 2)
    order = np.lexsort((sizes[:, 0], sizes[:, 1]))
    at = 0
    while at < n:
        # Pairs of near sizes, as many as the table holds.
        some = order[at : at + max(1, CELLS // max(1, int(sizes[order[min(at + 255, n - 1)]].max())))]
        while len(some) > 1 and len(some) * sizes[some].max() > 2 * CELLS:
            some = some[: len(some) // 2]
        total[some] = _matched([left[k] for k in some], [right[k] for k in some])
        at += len(some)
    return total


def _matched(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    n = len(left)
    total = np.zeros(n, np.int64)
    width_a, width_b = (max(1, max(len(p) for p in side)) for side in (left, right))
    a, b = _padded(left, width_a, _NO_LEFT), _padded(right, width_b, _NO_RIGHT)
    starts = _padded([_starters(p) for p in right], width_b, _NO_RIGHT)
    row = np.arange(n)
    a_lo, b_lo = np.zeros(n, np.int64), np.zeros(n, np.int64)
    a_hi, b_hi = (np.array([len(p) for p in side], np.int64) for side in (left, right))
    while True:
        open_ = (a_hi > a_lo) & (b_hi > b_lo)
        row, a_lo, a_hi, b_lo, b_hi = (x[open_] for x in (row, a_lo, a_hi, b_lo, b_hi))
        if not len(row):
            return total
        x, y, size = (np.zeros(len(row), np.int64) for _ in range(3))
        # Pieces of near sizes together, so that small ones aren't carried at the width of large ones.
        by_size = np.argsort(b_hi - b_lo, kind="stable")
        for part in np.array_split(by_size, max(1, min(8, len(row) // 64))):
            reach_a, reach_b = int((a_hi - a_lo)[part].max()), int((b_hi - b_lo)[part].max())
            ka, kb = a_lo[part, None] + np.arange(reach_a), b_lo[part, None] + np.arange(reach_b)
            pa = np.where(ka < a_hi[part, None], a[row[part, None], np.minimum(ka, width_a - 1)], _NO_LEFT)
            pb = np.where(kb < b_hi[part, None], starts[row[part, None], np.minimum(kb, width_b - 1)], _NO_RIGHT)
            x[part], y[part], size[part] = _longest(pa, pb, (a_hi - a_lo)[part])
        x, y = x + a_lo, y + b_lo
        # Blocks grow over characters that start none; an empty block stands at the start of its piece.
        while (grow := (x > a_lo) & (y > b_lo) & (a[row, x - 1] == b[row, y - 1])).any():
            x, y, size = x - grow, y - grow, size + grow
        while True:
            i, j = x + size, y + size
            grow = (i < a_hi) & (j < b_hi) & (a[row, np.minimum(i, width_a - 1)] == b[row, np.minimum(j, width_b - 1)])
            if not grow.any():
                break
            size = size + grow
        found = size > 0
        row, x, y, size, a_lo, a_hi, b_lo, b_hi = (v[found] for v in (row, x, y, size, a_lo, a_hi, b_lo, b_hi))
        np.add.at(total, row, size)
        row = np.concatenate([row, row])
        a_lo, a_hi, b_lo, b_hi = (np.concatenate(p) for p in ((a_lo, x + size), (x, a_hi), (b_lo, y + size), (y, b_hi)))


def ratios(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The ratio of each pair; two empty texts are equal."""
    both = np.array([len(a) + len(b) for a, b in zip(left, right, strict=True)], np.int64)
    return np.where(both > 0, 2.0 * matched_characters(left, right) / np.maximum(both, 1), 1.0)

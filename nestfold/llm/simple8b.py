"""Simple-8b: as many integers as fit share a 64-bit word, whose top four bits say how many.

Layout of a block, little-endian: magic, documents, words and escapes (u32 each); then by document its
id (i64), its number of ids (u32) and the index of its first word (u32); then the words and the
escapes (u64). A document starts on a word of its own, so any can be decoded alone, and all words
with one selector are unpacked together.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
MAGIC = 0x31423853
# Selector s packs COUNTS[s] values of BITS[s] bits. 0: one value of over 60 bits, kept
# behind the words; 1: a run of zeros.
COUNTS = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([64, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
_WIDTH16 = np.array([int(v).bit_length() for v in range(1 << 16)], np.uint8)


def widths(values: np.ndarray) -> np.ndarray:
    """Bits of each value."""
    if len(values) and int(values.max()) < 1 << 16:
        return _WIDTH16[values]
    out = np.zeros(len(values), np.uint8)
    for k in range(4):
        part = (values >> U64(16 * k)) & U64(0xFFFF)
        out = np.where(part > 0, _WIDTH16[part] + np.uint8(16 * k), out)
    return out


def encode(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(words, first word of each document, escapes)`` of the documents laid end to end."""
    n, ends = len(values), np.cumsum(counts)
    if not n:
        return np.empty(0, U64), np.zeros(len(counts), np.uint32), np.empty(0, U64)
    values = values.astype(U64, copy=False)
    longest = {1: widths(values)}  # the widest of the next 1, 2, 4, ... values
    for p in (1, 2, 4, 8, 16, 32):
        longest[2 * p] = longest[p].copy()
        np.maximum(longest[p][:-p], longest[p][p:], out=longest[2 * p][: max(0, n - p)])
    rest = np.minimum(np.repeat(ends, counts) - np.arange(n), 255).astype(np.uint8)
    chosen = np.zeros(n, np.uint8)
    for s in range(15, 0, -1):
        c, b = int(COUNTS[s]), int(BITS[s])
        p = min(64, 1 << (c.bit_length() - 1))
        widest = longest[p]
        if c > p and n > c - p:
            widest = widest.copy()
            np.maximum(longest[p][: n - (c - p)], longest[p][c - p :], out=widest[: n - (c - p)])
        fits = widest <= b
        if fits.any():
            chosen[fits & (rest >= c)] = s
    step, at, starts = COUNTS[chosen].tolist(), 0, []
    while at < n:
        starts.append(at)
        at += step[at]
    starts = np.array(starts)
    selectors = chosen[starts]
    words = selectors.astype(U64) << U64(60)
    for s in range(2, 16):
        mine = np.flatnonzero(selectors == s)
        if len(mine):
            at, held = starts[mine], words[mine]
            for k in range(COUNTS[s]):
                held |= values[at + k] << U64(k * BITS[s])
            words[mine] = held
    first = np.searchsorted(starts, ends - counts).astype(np.uint32)
    return words, first, values[starts[selectors == 0]]


def decode(words: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    """All values of the words, selector by selector."""
    selectors = (words >> U64(60)).astype(np.int64)
    ends = np.cumsum(COUNTS[selectors])
    out = np.zeros(int(ends[-1]) if len(ends) else 0, U64)
    for s in range(2, 16):
        mine = np.flatnonzero(selectors == s)
        if len(mine):
            at, held, mask = ends[mine] - COUNTS[s], words[mine], U64((1 << int(BITS[s])) - 1)
            for k in range(COUNTS[s]):
                out[at + k] = (held >> U64(k * BITS[s])) & mask
    mine = selectors == 0
    out[ends[mine] - 1] = escapes
    return out


def pack(ids: np.ndarray, counts: np.ndarray, words: np.ndarray, first: np.ndarray, escapes: np.ndarray) -> bytes:
    head = np.array([MAGIC, len(ids), len(words), len(escapes)], "<u4")
    parts = (head, ids.astype("<i8"), counts.astype("<u4"), first.astype("<u4"), words.astype("<u8"), escapes.astype("<u8"))
    return b"".join(p.tobytes() for p in parts)


def unpack(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(ids, counts, first words, words, escapes)``."""
    magic, n, n_words, n_escapes = (int(x) for x in np.frombuffer(block, "<u4", 4))
    if magic != MAGIC:
        raise ValueError("not a block of token ids")
    out, at = [], 16
    for kind, k in (("<i8", n), ("<u4", n), ("<u4", n), ("<u8", n_words), ("<u8", n_escapes)):
        out.append(np.frombuffer(block, kind, k, at))
        at += k * int(kind[2:])
    return tuple(out)

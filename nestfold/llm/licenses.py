"""License scan: MinHash bands over overlapping windows of words retrieve templates, and exact containment
of the template's shingles verifies them.

A template is looked for through windows of one length, the longest of LADDER of which a copy is sure to hold
one whole, wherever it starts. All windows of that length in the template are known, so a true copy has a window
equal to one of them; an altered one whose window keeps a share s of its shingles shares one of
BANDS bands with probability 1 - (1 - s**ROWS)**BANDS, at 0.8 above 0.9997.

Words are runs of ASCII letters and digits in small letters, and of other characters beyond ASCII:
punctuation and line breaks make no difference.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from nestfold.llm.license_texts import TEMPLATES
from nestfold.llm.words import U64, extended, hashes_of, mix, seeds, windows_of, with_columns

SHINGLE = 5
ROWS, BANDS = 2, 8
LADDER = ((32, 8), (16, 4), (12, 3), (8, 2), (5, 1))  # words of a window, words from one to the next
SEGMENT = 1 << 15  # words looked at together
_SLOTS = 16

HIT = T.StructType(
    [T.StructField("license", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("words", T.IntegerType()), T.StructField("containment", T.DoubleType())]
)
_KIND = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int32()), ("words", pa.int32()), ("containment", pa.float64())]))
_LETTERS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def license_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(_LETTERS).split()


def _bands(h: np.ndarray, lengths: list[int], factors: np.ndarray) -> dict[int, np.ndarray]:
    """By window length the band keys (band, place) of the windows at every place of the word hashes."""
    s, out = windows_of(h, SHINGLE), {}
    longest = {1: s[None, :] * factors}
    for w in sorted(lengths):
        n, size = len(h) - w + 1, w - SHINGLE + 1
        if n <= 0:
            break
        p = 1 << (size.bit_length() - 1)
        q = max(longest)
        while q < p:
            longest[2 * q] = np.minimum(longest[q][:, :-q], longest[q][:, q:])
            q *= 2
        least = np.minimum(longest[p][:, :n], longest[p][:, size - p : size - p + n])
        keys = np.arange(1, BANDS + 1, dtype=U64)[:, None] + U64(64 * w)
        for r in range(ROWS):
            keys = mix(keys + least[r::ROWS][:, :n])
        out[w] = keys
    return out


class Scanner:
    """Templates and the band keys of their windows, sorted."""

    def __init__(self, templates: dict[str, str], least: float):
        self.least = least
        self.names = sorted(templates)
        self.words = [hashes_of(license_words(templates[n])) for n in self.names]
        self.shingles = [np.unique(windows_of(w, SHINGLE)) for w in self.words]
        self.factors = seeds(ROWS * BANDS, 7)[:, None]
        self.short = [k for k, w in enumerate(self.words) if 0 < len(w) < SHINGLE]
        found: dict[int, list[tuple[np.ndarray, int]]] = {}
        for k, w in enumerate(self.words):
            size = next((size for size, step in LADDER if len(w) >= size + step - 1), None)
            if size:
                found.setdefault(size, []).append((_bands(w, [size], self.factors)[size], k))
        self.tables = {}
        for size, parts in found.items():
            keys = np.concatenate([p.ravel() for p, _ in parts])
            owner = np.concatenate([np.full(p.size, k) for p, k in parts])
            place = np.concatenate([np.tile(np.arange(p.shape[1]), BANDS) for p, _ in parts])
            order = np.argsort(keys, kind="stable")
            likely = np.zeros(1 << _SLOTS, bool)
            likely[(keys >> U64(64 - _SLOTS)).astype(np.int64)] = True
            self.tables[size] = (keys[order], owner[order], place[order], likely)

    def candidates(self, h: np.ndarray) -> set[tuple[int, int]]:
        """``(template, place where it would start)`` of every window that shares a band, and of short templates."""
        out: set[tuple[int, int]] = set()
        for a in range(0, len(h), SEGMENT):
            part = h[a : a + SEGMENT + LADDER[0][0] - 1]
            bands = _bands(part, list(self.tables), self.factors)
            for size, (keys, owner, place, likely) in self.tables.items():
                if size not in bands:
                    continue
                step = dict(LADDER)[size]
                mine = bands[size][:, ::step]
                band, at = np.nonzero(likely[(mine >> U64(64 - _SLOTS)).astype(np.int64)])
                lo, hi = (np.searchsorted(keys, mine[band, at], side) for side in ("left", "right"))
                some = hi > lo
                for p, x, y in zip((a + at[some] * step).tolist(), lo[some].tolist(), hi[some].tolist(), strict=True):
                    out.update(zip(owner[x:y].tolist(), (p - place[x:y]).tolist(), strict=True))
        for k in self.short:
            w = self.words[k]
            n = len(h) - len(w) + 1
            if n > 0:
                same = np.logical_and.reduce([h[j : n + j] == w[j] for j in range(len(w))])
                out.update((k, int(p)) for p in np.flatnonzero(same))
        return out

    def verified(self, h: np.ndarray, k: int, start: int) -> tuple[float, int, int] | None:
        """``(containment, first word, words)`` of a template around its place in one text."""
        w = self.words[k]
        if k in self.short:
            return (1.0, start, len(w)) if 0 <= start <= len(h) - len(w) else None
        room = len(w) // 5
        a = max(0, start - room)
        own = windows_of(h[a : max(0, start + len(w) + room)], SHINGLE)
        there = np.isin(own, self.shingles[k])
        share = len(np.unique(own[there])) / len(self.shingles[k])
        if share < self.least:
            return None
        at = np.flatnonzero(there)
        return share, a + int(at[0]), int(at[-1] - at[0]) + SHINGLE

    def scan(self, texts: list[str | None]) -> list[list[dict]]:
        """Hits of each text, in order of their place. A stretch has one name: of hits that overlap by half of the shorter one
        the best stays, which is the one that explains the most words, then the one with the best containment."""
        words = [license_words(t) for t in texts]
        ends = np.cumsum([len(w) for w in words])
        h = hashes_of([w for ws in words for w in ws])
        found: list[list[dict]] = [[] for _ in texts]
        by_text: dict[int, set[tuple[float, float, int, int, int]]] = {}
        for k, start in self.candidates(h):
            # The middle of the copy tells its text; a window over two texts proves nothing and fails below.
            d = int(np.searchsorted(ends, start + len(self.words[k]) // 2, "right"))
            if d < len(texts):
                begin = int(ends[d]) - len(words[d])
                hit = self.verified(h[begin : ends[d]], k, start - begin)
                if hit:
                    share, a, n = hit
                    # Shingles that stand there, less those of the template that don't: a longer template that is mostly there wins.
                    known = max(1, len(self.shingles[k]))
                    by_text.setdefault(d, set()).add((known * (2 * share - 1), share, -a, n, k))
        for d, hits in by_text.items():
            taken: list[tuple[int, int]] = []
            for _, share, a, n, k in sorted(hits, reverse=True):
                a = -a
                if all(2 * (min(a + n, b + m) - max(a, b)) <= min(n, m) for b, m in taken):
                    taken.append((a, n))
                    found[d].append({"license": self.names[k], "start": a, "words": n, "containment": round(share, 4)})
        return [sorted(f, key=lambda x: (x["start"], x["license"])) for f in found]


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, least: float = 0.8, text_col: str = "text", name: str = "licenses") -> DataFrame:
    """``docs`` with ``licenses``: an array of (license, start, words, containment), places counted in license words.

    A template is found where at least ``least`` of its 5-word shingles stand near each other; one of fewer words must
    stand there word by word. Of templates that lay claim to one stretch the one is named that explains most of it. The
    templates, a parameter, go to every task.

    Null and empty texts hold none. Texts that repeat are each scanned. An empty table stays
    empty. Other columns are carried along; one called ``name`` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Scanner(TEMPLATES if templates is None else templates, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = shared.value
        for batch in batches:
            found, some, size = [], [], 0
            for text in batch.column(text_col):
                some.append(text.as_py())
                size += len(some[-1] or "")
                if size > 1 << 18:
                    found += scanner.scan(some)
                    some, size = [], 0
            found += scanner.scan(some)
            yield with_columns(batch, {name: pa.array(found, _KIND)})

    return docs.mapInArrow(run, extended(docs.schema, name, T.ArrayType(HIT)))

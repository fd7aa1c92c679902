"""Vector code compression: product codes, their codebooks found by equal-average search.

By Cauchy and Schwarz two parts of d components whose sums differ by g are g * g / d apart or more. So a part is
compared with the entries in the order of their sums, outward from its own sum, and a side ends where the gap's
square over d strictly exceeds the best distance (an equal one could still be a tie with a lower index). Parts of
near sums go outward together, a run of entries at a time, so that a step is one matrix product.

The codebooks, 256 entries a part, go to every task; each task sends back one row for each entry that it used.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nestfold.session import broadcast_if_small, cut

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
LARGEST = 2.0**60  # of an integer component: sums of any number of rows then fit a decimal
TOGETHER = 256  # parts that go outward together
RUN = 32  # entries of a step to one side
_EXACT = 2**53  # doubles hold whole numbers below it


def usable(vector: Column) -> Column:
    """Whether a vector holds numbers alone, each finite and not beyond ``LARGEST`` when scaled."""
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) * SCALE < LARGEST, F.lit(False))), F.lit(False))


class Codebook:
    """Entries of one part position, sorted by their sums."""

    def __init__(self, entries: list[list[int]]):
        self.entries = entries
        self.sums = np.array([sum(e) for e in entries], object)
        self.order = np.argsort(self.sums, kind="stable")
        self.largest = max((abs(x) for e in entries for x in e), default=0)
        self.tables: dict[type, tuple] = {}

    def table(self, kind: type) -> tuple:
        if kind not in self.tables:
            sorted_entries = np.array([self.entries[k] for k in self.order], kind).reshape(len(self.order), -1)
            self.tables[kind] = (sorted_entries, sorted_entries.sum(1), (sorted_entries * sorted_entries).sum(1))
        return self.tables[kind]

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(index, squared distance)`` of the nearest entry of each part, the lowest index of equally near ones.

        ``parts`` are doubles that hold whole numbers. Products are exact in doubles for all sizes that
        embeddings have; larger ones are counted in Python's integers.
        """
        n, d = parts.shape
        if d == 0:
            return np.zeros(n, np.int64), np.zeros(n, np.int64)
        top = max(self.largest, int(np.abs(parts).max(initial=0)))
        kind = float if 4 * d * d * top * top < _EXACT else object
        if kind is object:
            parts = np.array([[int(x) for x in row] for row in parts], object).reshape(n, d)
        entries, sums, squares = self.table(kind)
        own, lengths = parts.sum(1), (parts * parts).sum(1)
        by_sum = np.argsort(own, kind="stable")
        index, best = np.empty(n, np.int64), np.empty(n, kind)
        for a in range(0, n, TOGETHER):
            rows = by_sum[a : a + TOGETHER]
            index[rows], best[rows] = self._outward(parts[rows], own[rows], lengths[rows], entries, sums, squares)
        return index, best if kind is object else best.astype(np.int64)

    def _outward(self, parts, own, lengths, entries, sums, squares):
        d, n = parts.shape[1], len(parts)
        index, best = np.full(n, len(entries)), np.full(n, None if parts.dtype == object else np.inf)
        if parts.dtype == object:
            best[:] = 4 * d * (2 * int(LARGEST)) ** 2

        def compare(rows: np.ndarray, lo: int, hi: int) -> None:
            away = lengths[rows][:, None] + squares[lo:hi] - 2 * parts[rows].dot(entries[lo:hi].T)
            least = away.min(1)
            # The lowest index among the equally near ones, of this run and before it.
            lowest = np.where(away == least[:, None], self.order[lo:hi], len(entries)).min(1)
            better = (least < best[rows]) | ((least == best[rows]) & (lowest < index[rows]))
            index[rows[better]], best[rows[better]] = lowest[better], least[better]

        def open_to(rows: np.ndarray, at: int) -> np.ndarray:
            gap = own[rows] - sums[at]
            return rows[gap * gap <= d * best[rows]]

        # Start between the sums of the block; from there each side is followed by those it is still open to.
        lo = hi = int(np.searchsorted(sums, own[n // 2]))
        left = right = np.arange(n)
        while len(left) or len(right):
            if hi < len(entries) and len(right := self._still(right, own, sums[hi], 1, open_to, hi)):
                compare(right, hi, min(hi + RUN, len(entries)))
                hi = min(hi + RUN, len(entries))
            else:
                right = right[:0]
            if lo > 0 and len(left := self._still(left, own, sums[lo - 1], -1, open_to, lo - 1)):
                compare(left, max(lo - RUN, 0), lo)
                lo = max(lo - RUN, 0)
            else:
                left = left[:0]
        return index, best

    @staticmethod
    def _still(rows, own, at_sum, side, open_to, at):
        """The rows that go on: those whose own sum isn't reached yet, and those the next gap leaves open."""
        ahead = (own[rows] - at_sum) * side > 0
        return np.union1d(rows[ahead], open_to(rows, at))


def _integers(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    """The vectors as doubles that hold floor(SCALE * x), a row each."""
    flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat * SCALE).reshape(len(batch), dim)


def _assigned(whole: np.ndarray, books: list[Codebook]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    d = whole.shape[1] // len(books)
    for p, book in enumerate(books):
        part = whole[:, p * d : (p + 1) * d]
        yield part, *book.nearest(part)


_USED = "part int, entry int, at int, n long, total decimal(38,0)"


def _update(books: list[Codebook], dim: int):
    """For each entry used in a task, the number of its parts and their sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = dim // len(books)
        counts, totals = np.zeros((len(books), ENTRIES), np.int64), np.zeros((len(books), ENTRIES, d), object)
        for batch in batches:
            for p, (part, index, _) in enumerate(_assigned(_integers(batch, dim), books)):
                used, place, n = np.unique(index, return_inverse=True, return_counts=True)
                counts[p, used] += n
                if len(part) * np.abs(part).max(initial=0) < _EXACT:
                    sums = np.zeros((len(used), d))
                    np.add.at(sums, place, part)
                    totals[p, used] += sums.astype(np.int64).astype(object)
                else:
                    for k, row in zip(index.tolist(), part.tolist(), strict=True):
                        totals[p, k] += np.array([int(x) for x in row], object)
        part, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(part, d), pa.int32()),
                pa.array(np.repeat(entry, d), pa.int32()),
                pa.array(np.tile(np.arange(d), len(part)), pa.int32()),
                pa.array(np.repeat(counts[part, entry], d)),
                pa.array([int(x) for x in totals[part, entry].ravel()], pa.decimal128(38, 0)),
            ],
            ["part", "entry", "at", "n", "total"],
        )

    return run


def _encode(books: list[Codebook], dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, error = np.empty((len(batch), len(books)), np.uint8), np.zeros(len(batch), object)
            for p, (_, index, away) in enumerate(_assigned(_integers(batch, dim), books)):
                codes[:, p] = index
                error += away
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array([int(e) for e in error], pa.decimal128(38, 0))],
                ["vec_id", "label", "code", "error"],
            )

    return run


def train(vectors: DataFrame, dim: int, rounds: int = ROUNDS) -> list[list[list[int]]]:
    """The entries of each part's codebook after ``rounds`` rounds over ``(vec_id, vector)``.

    They start as the parts of the rows with the smallest ids (of equal ids the smaller vectors; a null id comes
    last). What comes to the driver is the codebooks, at most ENTRIES vectors a round.
    """
    d = dim // PARTS
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(ENTRIES).collect()
    whole = [[int(np.floor(float(x) * SCALE)) for x in row.vector] for row in first]
    books = [[v[p * d : (p + 1) * d] for v in whole] for p in range(PARTS)]
    for _ in range(rounds if d else 0):
        used = vectors.select("vec_id", "vector").mapInArrow(_update([Codebook(b) for b in books], dim), _USED)
        used = used.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        for row in used.collect():
            books[row.part][row.entry][row.at] = int(row.total) // row.n
    return books


def codebooks_digest(books: list[list[list[int]]]) -> str:
    """SHA-256 of all components by part, entry and place, as decimal numbers joined by commas."""
    return hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()


def compress(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", rounds: int = ROUNDS
) -> tuple[DataFrame, list[list[list[int]]]]:
    """``(id, label, code, error, label_error)`` of each usable vector, and the codebooks.

    A component x counts as floor(SCALE * x). ``code`` has two hex digits for each part's entry, ``error`` is
    the squared distance to the entries, ``label_error`` its sum over equal labels (nulls are equal).

    Null vectors and those with a component that is null, not finite or beyond LARGEST go. All vectors
    have the length that most have (of equally many the longest), and are filled up with zeros to a multiple of PARTS;
    those of another length go as well. With fewer than ENTRIES vectors there are fewer entries. Rows that
    repeat count each. An error beyond a long is null. No vectors give no rows and empty codebooks.
    Other columns are not read.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector")).filter(usable(F.col(vector_col)))
    rows = cut(rows.withColumn("size", F.size("vector")))
    sizes = rows.groupBy("size").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    size = sizes["size"] if sizes else 0
    dim = -(-size // PARTS) * PARTS
    rows = rows.filter(F.col("size") == size).select("vec_id", "label", "vector")
    if dim > size:
        rows = rows.withColumn("vector", F.concat("vector", F.array_repeat(F.lit(0).cast(rows.schema["vector"].dataType.elementType), dim - size)))
    books = train(rows, dim, rounds)
    kind = rows.schema["label"].dataType.simpleString()
    coded = rows.select("vec_id", "label", "vector").mapInArrow(_encode([Codebook(b) for b in books], dim), f"vec_id long, label {kind}, code string, error decimal(38,0)")
    coded = cut(coded)
    by_label = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    out = coded.join(broadcast_if_small(by_label), F.col("label").eqNullSafe(F.col("_label")), "left")
    longs = [F.expr(f"try_cast({c} as long)").alias(c) for c in ("error", "label_error")]
    return out.select(F.col("vec_id").alias(id_col), F.col("label").alias(label_col), "code", *longs), books

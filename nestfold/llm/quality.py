"""Quality classifier: logistic regression over hashed word n-grams, trained by
follow-the-regularised-leader, scored as a sparse dot product.

The grams of a text are its single words and neighbouring pairs, lower-cased in A-Z, and the same of its
words' shapes (what is left of a word without small letters: capitals, digits, marks). A word that
stands twice in a row makes one pair of its own, whatever the word. Every family of grams is hashed into one
table of 2^BITS weights; a gram's value is its share of the text's words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from nestfold.llm.words import U64, extended, hashes_of, mix, with_columns

BITS = 18
SCALE = 8.0  # a gram that is every word of a text has this value
_PAIR, _SHAPE, _TWICE, _EMPTY = (U64(xxh3_64_intdigest(k)) for k in (b"pair", b"shape", b"twice", b"empty"))

_SHAPES = bytes(ord("U") if 65 <= c <= 90 else ord("0") if 48 <= c <= 57 else c for c in range(256))
_SMALL = bytes(range(97, 123)) + bytes(range(128, 256))
_RUNS = re.compile(rb"U{2,}"), re.compile(rb"0{2,}"), re.compile(rb"([^\sU0])\1{2,}")


def grams(text: str | None) -> tuple[np.ndarray, float]:
    """``(slots of all grams, value of each)``. A text without words has one slot of its own."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    h = hashes_of(raw.lower().split())
    if not len(h):
        return np.array([int(_EMPTY >> U64(64 - BITS))]), SCALE
    shapes = raw.translate(_SHAPES, _SMALL)
    for runs, short in zip(_RUNS, (b"UU", b"00", rb"\1\1"), strict=True):
        shapes = runs.sub(short, shapes)
    s = hashes_of(shapes.split()) ^ _SHAPE
    parts = [h, s]
    for one in (h, s):
        pairs = mix(one[:-1] * U64(3) + mix(one[1:] + _PAIR))
        if one is h:
            pairs[one[:-1] == one[1:]] = _TWICE
        parts.append(pairs)
    return (mix(np.concatenate(parts)) >> U64(64 - BITS)).astype(np.int64), SCALE / len(h)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        slots, values = [], []
        for text in batch.column("text").to_pylist():
            at, each = grams(text)
            at, times = np.unique(at, return_counts=True)
            slots.append(at.astype(np.int32).tobytes())
            values.append((times * each).astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column("nth"), batch.column("label"), pa.array(slots, pa.binary()), pa.array(values, pa.binary())],
            ["nth", "label", "slots", "vals"],
        )


def _train(alpha: float, beta: float, l1: float, l2: float, epochs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [
            (label, np.frombuffer(s, np.int32), np.frombuffer(v, np.float32).astype(np.float64))
            for batch in batches
            for label, s, v in zip(*(batch.column(c).to_pylist() for c in ("label", "slots", "vals")), strict=True)
        ]
        z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)  # the last is the constant's

        def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
            return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))

        for _ in range(epochs):
            for label, at, x in rows:
                at, x = np.append(at, 1 << BITS), np.append(x, 1.0)
                zi, ni = z[at], n[at]
                w = weights(zi, ni)
                g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - label) * x
                grown = ni + g * g
                z[at] = zi + g - (np.sqrt(grown) - np.sqrt(ni)) / alpha * w
                n[at] = grown
        yield pa.RecordBatch.from_arrays([pa.array([weights(z, n).astype(np.float32).tobytes()], pa.binary())], ["weights"])

    return run


def train(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "quality",
    max_rows: int = 12_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    alpha: float = 1.0,
    beta: float = 1.0,
    l1: float = 0.02,
    l2: float = 0.05,
    epochs: int = 2,
) -> np.ndarray:
    """The weights (2^18 and a constant, 1 MB) learnt from the labelled texts.

    At most ``max_rows`` labelled rows are used, those with the smallest hash of their id; grams are
    made where the texts lie, and one task takes the bounded sample in the order of that hash.
    Rows with a null label or id, and labels without a document, teach nothing; without any
    row all weights are zero.
    """
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).dropna()
    sample = known.withColumn("nth", F.xxhash64("id")).orderBy("nth", "id", "label").limit(max_rows)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = texts.join(F.broadcast(sample), "id").select("nth", "label", "text")  # at most max_rows short rows
    made = rows.mapInArrow(_features, "nth long, label int, slots binary, vals binary")
    made = made.repartition(1).sortWithinPartitions("nth", "slots")
    learnt = made.mapInArrow(_train(alpha, beta, l1, l2, epochs), "weights binary").first()
    return np.frombuffer(learnt[0], np.float32) if learnt else np.zeros((1 << BITS) + 1, np.float32)


def score(docs: DataFrame, weights: np.ndarray, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1, from the text alone.

    Null and empty texts get the score of a text without words. All other columns are carried
    along as they are, repeated rows too; one called ``name`` is replaced.
    """
    table = docs.sparkSession.sparkContext.broadcast(np.asarray(weights, np.float64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = table.value
        for batch in batches:
            out = np.empty(batch.num_rows)
            for k, text in enumerate(batch.column(text_col)):
                at, each = grams(text.as_py())
                out[k] = w[-1] + each * w[at].sum()
            yield with_columns(batch, {name: pa.array(1 / (1 + np.exp(-out)))})

    return docs.mapInArrow(run, extended(docs.schema, name, "double"))

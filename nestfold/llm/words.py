"""Words, shingles and their 64-bit hashes, for the tasks that work on Arrow batches.

A word is a run of bytes other than space and 0x09 to 0x0D: exactly what ``bytes.split()`` cuts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql.types import DataType, StructType
from xxhash import xxh3_64_intdigest

U64 = np.uint64
_STEP = U64(0x9E3779B97F4A7C15)
_MIX_A, _MIX_B = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: every input bit reaches every output bit."""
    h = (h ^ (h >> U64(30))) * _MIX_A
    h = (h ^ (h >> U64(27))) * _MIX_B
    return h ^ (h >> U64(31))


def words_of(text: str | None, lower: bool = False) -> list[bytes]:
    """The words of a text; ``lower`` maps A-Z alone. Null has none."""
    if text is None:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


def hashes_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh3_64_intdigest, words), U64, len(words))


def windows_of(h: np.ndarray, size: int) -> np.ndarray:
    """One hash for each run of ``size`` word hashes, in order; fewer words give none."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, U64)
    out = np.zeros(n, U64)
    for k in range(size):
        out = out * _STEP + mix(h[k : k + n] + U64(k))
    return mix(out)


def shingles_of(h: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct shingles; with fewer words the whole sequence is one, without words none."""
    if len(h) == 0:
        return np.empty(0, U64)
    if len(h) < size:
        return mix(windows_of(h, len(h)) + U64(len(h)))
    return np.unique(windows_of(h, size))


def seeds(n: int, start: int) -> np.ndarray:
    """``n`` fixed odd multipliers."""
    return mix(np.arange(1, n + 1, dtype=U64) * _STEP + U64(start)) | U64(1)


def binary(rows: list[bytes | None]) -> pa.Array:
    return pa.array(rows, pa.binary())


def with_columns(batch: pa.RecordBatch, made: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch with the made columns behind it; one of the same name, in any case, is replaced."""
    names = {n.lower() for n in made}
    kept = [n for n in batch.schema.names if n.lower() not in names]
    return pa.RecordBatch.from_arrays([batch.column(n) for n in kept] + list(made.values()), kept + list(made))


def extended(schema: StructType, name: str, kind: DataType | str) -> StructType:
    """The schema of ``with_columns``' batches."""
    return StructType([f for f in schema.fields if f.name.lower() != name.lower()]).add(name, kind)


def fresh(columns: list[str], name: str) -> str:
    """``name``, with as many underscores before it as make it differ from all ``columns``."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name

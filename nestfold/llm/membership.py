"""A bitmap of hashes, of bounded size, that lets a task tell most strangers away before anything leaves it."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

U64 = np.uint64
BITS = (22, 26)  # a bitmap has 2**22 to 2**26 bits, about 500 for each hash where these suffice


def bitmap(hashes: DataFrame) -> np.ndarray:
    """One bit for the highest bits of each ``hash``: words of 64, made in tasks, 8 MB at most. The more hashes
    share it the more strangers it lets pass, but it never leaves out a member."""
    bits = min(max(math.ceil(math.log2(hashes.count() + 1)) + 9, BITS[0]), BITS[1])
    slot = F.shiftrightunsigned("hash", 64 - bits)
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(hash, {64 - bits}) % 64 as int))")
    made = hashes.select(F.shiftright(slot, 6).cast("int").alias("word"), bit.alias("bit"))
    found = made.groupBy("word").agg(F.bit_or("bit").alias("held")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[found["word"].to_numpy()] = found["held"].to_numpy()
    return out.view(U64)


def inside(held: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which unsigned hashes may be members."""
    slot = hashes >> U64(64 - (len(held).bit_length() - 1) - 6)
    return (held[(slot >> U64(6)).astype(np.int64)] >> (slot & U64(63))) & U64(1) > 0

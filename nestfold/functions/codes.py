"""64-bit fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def vector_fingerprint(vector: Column) -> Column:
    """64 numbers to a 64-bit code: bit i is set when value i is above the median."""
    v = vector.cast("array<double>")
    ordered = F.sort_array(v)
    median = (F.get(ordered, F.lit(31)) + F.get(ordered, F.lit(32))) / F.lit(2.0)
    bits = F.transform(
        v,
        lambda x, i: F.when(x > median, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(
            F.lit(0).cast("bigint")
        ),
    )
    code = F.aggregate(bits, F.lit(0).cast("bigint"), lambda acc, b: acc.bitwiseOR(b))
    return F.when(F.size(v) == 64, code)


def hex_to_code(digits: Column) -> Column:
    """16 hex digits to the code; anything else is null."""
    return F.when(digits.rlike("^[0-9a-fA-F]{16}$"), F.conv(digits, 16, -10).cast("bigint"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))

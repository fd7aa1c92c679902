"""White space of every script, apart so that all function modules can use it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Written out so that it means the same for every script.
SPACE = r"\s\x{1c}-\x{1f}"


def full_strip(c: Column) -> Column:
    """Drop leading and trailing whitespace of any script (``trim`` only drops spaces)."""
    # From the first to the last other character: what lies between is passed over without a look.
    return F.regexp_extract(c, f"(?Us)^[{SPACE}]*+(.*[^{SPACE}])?", 1)

"""Running sums over a whole table in a stated order, without bringing it into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nestfold.session import cut


def running_sum(df: DataFrame, order: list[Column], size: str, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``size`` over all rows before this one in ``order``.

    Rows are dealt out by range and written once; a part's own running sum starts from the sum of the
    parts before it, which is one row for each part. Rows equal in ``order`` come in any order.
    """
    ranged = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    parts = ranged.groupBy("_part").agg(F.sum(size).alias("_sum"))
    parts = parts.select("_part", (F.sum("_sum").over(Window.orderBy("_part")) - F.col("_sum")).alias("_base"))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = ranged.withColumn("_upto", F.sum(size).over(inside)).join(F.broadcast(parts), "_part")
    return out.withColumn(name, F.col("_base") + F.col("_upto") - F.col(size)).drop("_part", "_base", "_upto")

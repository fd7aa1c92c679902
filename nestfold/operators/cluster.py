"""Components and first-fit clusters over match edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nestfold.session import cut


def connected_components(edges: DataFrame, a: str = "later", b: str = "earlier") -> DataFrame:
    """``(node, component_id)`` for every node with an edge; the id is the smallest node.

    Alternating large-star and small-star steps (Kiveris et al., "Connected components in
    MapReduce and beyond", 2014). Each step is a partial ``min`` per node and a join
    with that one row per node; lineage is cut every round.
    """
    u, v = F.col("u"), F.col("v")
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(u != v).distinct()
    now = cut(now)
    while True:
        before = now
        both = now.unionByName(now.select(v.alias("u"), u.alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter(v > u).select(v.alias("u"), F.col("m").alias("v"))
        large = large.filter(u != v).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter(v != F.col("m")).select(v.alias("u"), F.col("m").alias("v"))
        heads = low.select("u", F.col("m").alias("v"))
        now = cut(small.unionByName(heads).distinct())
        if now.count() == before.count() and now.join(before, ["u", "v"], "left_anti").isEmpty():
            break
    heads = now.select(v.alias("node"), v.alias("component_id")).distinct()
    return now.select(u.alias("node"), v.alias("component_id")).unionByName(heads)


def first_fit_labels(edges: DataFrame) -> DataFrame:
    """``(node, cluster_id)`` for every row with an earlier match.

    First fit puts a row into the oldest cluster that holds any earlier match. A cluster is
    as old as its founder, so a row's cluster is the smallest founder among its earlier
    matches' clusters; followed down, that is the smallest founder reachable through
    ever earlier rows. This needs no replay: labels sink along the edges until nothing changes.

    Each round also follows the current label like an edge (it is a reachable row), so long
    chains shorten geometrically.
    """
    base = cut(edges.select("later", "earlier").distinct())
    labels = base.groupBy("later").agg(F.min("earlier").alias("label"))
    while True:
        arrows = base.withColumn("held", F.lit(None).cast("bigint")).unionByName(
            labels.select("later", F.col("label").alias("earlier"), F.col("label").alias("held"))
        )
        below = labels.select(F.col("later").alias("earlier"), F.col("label").alias("lower"))
        moved = cut(
            arrows.join(below, "earlier", "left")
            .groupBy("later")
            .agg(F.min(F.coalesce("lower", "earlier")).alias("label"), F.max("held").alias("held"))
        )
        labels = moved.select("later", "label")
        if moved.filter("label <> held").isEmpty():
            return labels.select(F.col("later").alias("node"), F.col("label").alias("cluster_id"))


def cluster_flats(df: DataFrame, edges: DataFrame, seq: str = "seq") -> DataFrame:
    """Adds ``cluster_id``, the arrival number of the founding row of the row's cluster."""
    labels = first_fit_labels(edges).withColumnRenamed("node", seq)
    return df.join(labels, seq, "left").withColumn("cluster_id", F.coalesce("cluster_id", F.col(seq)))

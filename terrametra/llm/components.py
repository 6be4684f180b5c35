"""Connected components by alternating large-star and small-star steps (equi-joins and minima only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrametra.session import free, written


def dealt_anew(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` with its keys as fresh expressions: a join then deals this side out by an exchange of its own.

    Spark splits a hot key of a join only if both sides are exchanges; an aggregate's output would be joined in place.
    """
    return df.withColumns({k: F.shiftright(k, 0) for k in keys})


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every node that has an edge to another node; the root is the component's smallest node.

    Nodes are longs; null ends and loops are ignored, repeated edges count once, no edge gives an empty result. A
    node with very many edges meets its minimum by a join that Spark can split; no neighbour list is ever formed.
    Every round is written to the shared folder, so a lost executor costs one round; the round before is removed.
    """
    spark, name = edges.sparkSession, "components"
    now, path = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct(), name)
    seen = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                now.select("v", "v").distinct()
            )
        seen = state
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(dealt_anew(low, "u"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large, between = written(large.union(low.filter("m < u")).distinct(), name)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(dealt_anew(low, "u"), "u")
        before = path
        now, path = written(small.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low).distinct(), name)
        free(spark, before, between)

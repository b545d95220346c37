"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WAYS = 16  # tasks that the neighbours of one node are dealt to


def components(links: DataFrame, store: Callable[[DataFrame], DataFrame], most: int = 100) -> DataFrame:
    """(node, component) of every linked node, component being its smallest reachable node, itself included.

    links: columns a and b of one orderable type, without nulls. Alternates the large star (every larger neighbour
    is linked to the smallest one) and the small star (every smaller one is) until the links are stars, which takes
    O(log^2 n) rounds; each is two aggregations and two joins, keeps at most as many links as there were, and is
    written by `store`, so nothing is gathered in one place and a lost executor costs one round. The joins are hinted, since Spark would send
    either side through the driver while it is under the broadcast threshold, several of them at once.
    """
    edges = store(links.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    before = None
    for _ in range(most):
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        dealt = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(WAYS - 1))))
        large = both.where("v > u").withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(WAYS)).cast("int")).join(dealt.hint("merge"), ["u", "salt"]).select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least.hint("merge"), "hi").select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e")).select("e.*").where("hi <> lo").distinct()
        edges = store(small)
        now = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")), F.lit(0))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"links didn't settle in {most} rounds")
    roots = edges.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(roots)

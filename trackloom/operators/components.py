"""Connected groups over edge tables by label propagation in joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.operators.lineage import checkpointed


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) with the smallest node id of each group.

    Alternating large-star and small-star steps point every node at the smallest id it can see; the number of
    rounds grows with the logarithm of the longest chain, and no step gathers a whole group.
    """
    pairs = edges.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).filter("lo < hi").distinct()
    current = checkpointed(pairs)
    while True:
        both = current.select(F.col("lo").alias("n"), F.col("hi").alias("m")).unionByName(
            current.select(F.col("hi").alias("n"), F.col("lo").alias("m"))
        )
        least = both.groupBy("n").agg(F.least(F.min("m"), F.first("n")).alias("root"))
        large = both.filter("m > n").join(least, "n").select(F.col("root").alias("lo"), F.col("m").alias("hi"))
        large = large.filter("lo < hi").distinct()
        down = large.groupBy("hi").agg(F.min("lo").alias("root"))
        small = large.join(down, "hi").select(
            F.explode(F.array(F.struct(F.col("root").alias("lo"), F.col("hi")), F.struct(F.col("root").alias("lo"), F.col("lo").alias("hi")))).alias("e")
        ).select("e.lo", "e.hi")
        following = checkpointed(small.filter("lo < hi").distinct())
        if following.exceptAll(current).isEmpty() and current.exceptAll(following).isEmpty():
            break
        current = following
    nodes = edges.select(F.col(a).alias("node")).unionByName(edges.select(F.col(b).alias("node"))).distinct()
    roots = current.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return nodes.join(roots, "node", "left").withColumn("component", F.coalesce("component", "node"))

"""Smallest node reachable over undirected links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import settle

SALTS = 16


def salted_join(many: DataFrame, one: DataFrame, key: str, spread: str, salts: int = SALTS) -> DataFrame:
    """Inner join where ``one`` has a row per key; a key with very many rows in ``many`` is dealt to ``salts`` tasks.

    For a small ``one``: Spark sizes it as if it were not repeated, until the repeated rows are dealt out and counted.
    """
    left = many.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = one.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).repartition(key, "__salt")
    return left.join(right, [key, "__salt"]).drop("__salt")


def met_by_key(many: DataFrame, one: DataFrame, key: str) -> DataFrame:
    """Inner join where ``one`` has a row per key and grows with the input: it is never sent to the driver, and no row is repeated.

    The second key makes Spark deal both sides out anew, also where ``one`` was grouped by ``key``; then it splits a skewed key.
    """
    again = F.xxhash64(F.lit("again"), key)
    return many.withColumn("__again", again).join(one.withColumn("__again", again).hint("merge"), [key, "__again"]).drop("__again")


def smallest_reachable(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b).  The driver sees two numbers a round; each round is a written table."""
    current = settle(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "links")
    before = state(current)
    while before[0]:
        current = settle(small_star(large_star(current)), "links")
        after = state(current)
        if after == before:
            break
        before = after
    roots = current.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def state(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def large_star(links: DataFrame) -> DataFrame:
    """Larger neighbours of each node meet its smallest neighbour."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    met = met_by_key(both.filter("v > u"), least, "u")
    return met.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()


def small_star(links: DataFrame) -> DataFrame:
    """Smaller neighbours of each node, and the node itself, meet its smallest neighbour."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    met = met_by_key(links, least, "u")
    smaller = met.select(F.col("v").alias("u"), F.col("m").alias("v"))
    return smaller.unionByName(least.select("u", F.col("m").alias("v"))).filter("u > v").distinct()

"""Connected components of a graph whose links are a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchengine.llm.store import materialise

ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """(node, component) of links (a, b) between long ids: the smallest id that each linked node reaches.

    Rounds of large-star and small-star: each node's neighbours are linked to the smallest of them, until a round
    changes nothing. A node with very many neighbours is only ever minimised over (with partial sums) and joined
    (Spark splits skewed joins); its neighbours are never gathered. Each round is written, so that lineage stays short.
    """
    edges = materialise(links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).filter("hi > lo").distinct(), "links")
    mark = None
    for _ in range(ROUNDS):
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        # large star: neighbours above u go to the least of u and its neighbours
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        # small star: u and its neighbours below go to the least of these
        below = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(below, "hi").filter("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        edges = materialise(small.union(below.select("hi", F.col("m").alias("lo"))).distinct(), "links")
        now = tuple(edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("hi", "lo"), F.lit(1 << 40)))).first())
        if now == mark:
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
        mark = now
    raise RuntimeError(f"components: not settled after {ROUNDS} rounds")

"""Connected components of an edge list, by alternating large and small stars.

Every round groups edges by node and replaces neighbours by the least one; the
rounds end when the edges form stars, each node having one part in one of them,
after about the logarithm of the longest path.  Each round is a written table, so
neither the plan nor the recovery of a lost executor grows with the rounds.
"""

from pyspark.sql import DataFrame, functions as F

from drayage.llm.common import stage


def _large_star(edges: DataFrame) -> DataFrame:
    """Connect each node's greater neighbours to its least neighbour or itself."""
    both = edges.unionAll(edges.select(F.col("low").alias("high"), F.col("high").alias("low"))).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("high"), F.col("m").alias("low"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Connect each node and its lesser neighbours to the least of them."""
    least = edges.groupBy("high").agg(F.min("low").alias("m"))
    lesser = F.col("low") > F.col("m")
    node = F.when(lesser, F.col("low")).otherwise(F.col("high"))
    return edges.join(least, "high").select(node.alias("high"), F.col("m").alias("low")).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node is the middle of a star or the greater end of a single edge."""
    parts = edges.select(F.col("high").alias("node"), F.lit(1).alias("ends"), F.lit(0).alias("middle"))
    parts = parts.unionAll(edges.select(F.col("low").alias("node"), F.lit(0).alias("ends"), F.lit(1).alias("middle")))
    parts = parts.groupBy("node").agg(F.sum("ends").alias("ends"), F.max("middle").alias("middle"))
    return parts.filter("ends + middle > 1").isEmpty()


def stars(links: DataFrame) -> DataFrame:
    """high and low, the least node reachable, for every node of links (a, b) that is not the least itself."""
    edges = links.select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low"))
    edges = stage(edges.filter("high > low").distinct(), "components")
    while not _settled(edges):
        edges = stage(_small_star(_large_star(edges)), "components")
    return edges


def components(links: DataFrame) -> DataFrame:
    """node and component (the least node reachable) for every node of links (a, b)."""
    edges = stars(links)
    return edges.select(F.col("high").alias("node"), F.col("low").alias("component")).unionAll(
        edges.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct()
    )

"""Connected components of a graph held as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabaudit.functions.lineage import cut
from tabaudit.llm.skew import join_hot


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v): root is the smallest node it is connected with.

    Alternates two steps that hang neighbours onto the smallest node around: first the
    larger neighbours of each node, then the smaller ones. Every step aggregates before
    it shuffles and leaves at most the edges it found; the number of rounds grows with
    the logarithm of the largest component. Each round is written to the shared folder.
    """
    e = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct())
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(both.groupBy(F.col("u").alias("c")).agg(F.least(F.min("v"), F.col("c")).alias("m"), F.count(F.lit(1)).alias("degree")))
        # a node may be the smallest around for a large share of all nodes
        larger = join_hot(both.filter("v > u"), low, "u", "c", "degree", 2 * e.count())
        large = larger.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.filter("m < c").select(F.col("c").alias("u"), F.col("m").alias("v"))).distinct()
        low2 = large.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m"))
        small = large.join(low2, F.col("u") == F.col("c")).filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.unionByName(low2.select(F.col("c").alias("u"), F.col("m").alias("v"))).distinct())
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()

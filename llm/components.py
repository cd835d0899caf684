"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from llm.common import store


def components(links: DataFrame) -> DataFrame:
    """(node, root): for every node of the links (a, b), the smallest node it can reach.

    Alternates two rounds until nothing changes: each node links its larger neighbours to its
    smallest one, then its smaller neighbours. Both keep what is reachable, and a node's links are
    reduced to minima before the shuffle, so a hub costs no more than its links. Rounds grow with
    the logarithm of the longest chain. Empty links give no nodes.
    """
    def undirected(t: DataFrame) -> DataFrame:
        return t.union(t.select("b", "a"))

    pairs = store(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    last = None
    while True:
        both = undirected(pairs).toDF("a", "b")
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").union(low).distinct()
        pairs = store(small.toDF("a", "b"), "links")
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
    roots = pairs.toDF("node", "root")
    return roots.union(roots.select("root", "root").distinct())

"""Connected components of a link table, by alternating star operations; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseek.llm._common import Scratch


def connected_components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b: long), where root is the smallest node reachable.

    Each round hangs every larger neighbour on a node's least neighbour, then every smaller one, until no link
    changes: a number of rounds that grows with the logarithm of the component's size.  Each round is a written
    table, so a lost executor costs one round at most.  Null ends and self-links are left out.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    edges = scratch.keep(links.where("a != b").select(high.alias("a"), low.alias("b")).distinct(), "round0")
    seen, k = None, 0
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen, k = state, k + 1
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        large = scratch.keep(large, f"large{k}")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        edges = scratch.keep(small, f"round{k}")
        scratch.drop(f"round{k - 1}", f"large{k}")
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)

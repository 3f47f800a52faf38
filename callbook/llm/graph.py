"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callbook.llm.common import settle


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component (its smallest node) for every node of the edges.

    edges: columns a and b of one orderable type; loops and repeated edges do no harm, rows
    with a null do not count. Each round joins and groups on nodes, with partial sums
    before the shuffle, and settles its edges; rounds grow with the logarithm of the
    longest path.
    """
    now = settle(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    mark = None
    for _ in range(rounds):
        new = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if not new[0]:
            break
        if new == mark:
            break
        mark = new
        # Large star: larger neighbours of a node point to the smallest of its neighbours and itself.
        both = now.union(now.select("b", "a")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        # Small star: smaller neighbours and the node itself point to the smallest of them.
        low = large.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
        small = large.join(low, large.b == low.u).select(F.col("m").alias("x"), F.col("a").alias("y")) \
            .union(low.select("m", "u"))
        now = settle(small.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
    else:
        raise RuntimeError("components did not settle")
    return now.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component")) \
        .union(now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())

"""Personalized PageRank as a loop of joins; every round is cut off at the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.session import cut


def personalized_pagerank(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, damping: float = 0.85, most: int = 50, tolerance: float = 1e-6) -> DataFrame:
    """(node, rank). nodes has node; edges src, dst, weight (unknown ends and weights of zero or less
    are dropped, parallel edges add up); seeds node, weight (all nodes alike if there are none).

    What reaches nodes without a way out flows back to the seeds. Stops when the ranks move less
    than `tolerance` in sum, after `most` rounds at the latest; without nodes there are no rows."""
    nodes = nodes.select("node").distinct()
    total = seeds.join(nodes, "node", "left_semi").agg(F.sum("weight")).first()[0] or 0.0
    n = nodes.count()
    if total > 0:
        own = seeds.groupBy("node").agg((F.sum("weight") / total).alias("p"))
        start = nodes.join(own, "node", "left").select("node", F.coalesce("p", F.lit(0.0)).alias("p"))
    else:
        start = nodes.select("node", F.lit(1.0 / max(n, 1)).alias("p"))
    start = cut(start)
    e = edges.where("weight > 0").groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    e = e.join(nodes.withColumnRenamed("node", "src"), "src", "left_semi").join(nodes.withColumnRenamed("node", "dst"), "dst", "left_semi")
    out = e.groupBy("src").agg(F.sum("weight").alias("out"))
    e = cut(e.join(out, "src").select("src", "dst", (F.col("weight") / F.col("out")).alias("part")))
    ends = e.select(F.col("src").alias("node")).distinct().withColumn("goes", F.lit(True))
    base = cut(start.join(ends, "node", "left").select("node", "p", F.coalesce("goes", F.lit(False)).alias("goes")))
    rank = base.select("node", "p", "goes", F.col("p").alias("rank"))
    stays = F.coalesce(F.sum(F.when(~F.col("goes"), F.col("rank"))), F.lit(0.0))
    dangling = rank.agg(stays).first()[0]
    for _ in range(most):
        flow = rank.join(e, rank.node == e.src).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") * F.col("part")).alias("flow"))
        moved = rank.join(flow, "node", "left").select("node", "p", "goes", F.col("rank").alias("old"), ((1 - damping) * F.col("p") + damping * dangling * F.col("p") + damping * F.coalesce("flow", F.lit(0.0))).alias("rank"))
        moved = cut(moved)
        delta, dangling = moved.agg(F.coalesce(F.sum(F.abs(F.col("rank") - F.col("old"))), F.lit(0.0)), stays).first()
        rank = moved.drop("old")
        if delta < tolerance:
            break
    return rank.select("node", "rank")

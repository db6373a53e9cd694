"""Connected components of a large graph by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelens.llm.common import joined, stored

ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for every node of edges (a, b of one orderable type).

    Each round joins edges to the least neighbour of a node, so that no neighbourhood is ever
    gathered; nodes with very many neighbours are broadcast (``common.joined``). The number
    of rounds grows with the logarithm of the longest path. An edge to itself gives a node alone.
    """
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    links = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    for _ in range(ROUNDS):
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before, count = now, now[0]
        # Large star: every larger neighbour of u is linked to the least neighbour of u.
        both = links.union(links.select("v", "u"))
        least = stored(both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("_times")).select("u", F.least("u", "m").alias("m"), "_times"))
        large = stored(joined(both, least, ["u"], "_times", 2 * count).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # Small star: u and its smaller neighbours are linked to the least of them.
        least = stored(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("_times")))
        moved = joined(large, least, ["u"], "_times", count).select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = stored(moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
    else:
        raise RuntimeError("components did not settle")
    roots = links.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))

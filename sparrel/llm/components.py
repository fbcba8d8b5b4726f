"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Rounds beyond which something is wrong: two steps at least halve the longest path, so that 2^64 nodes take fewer.
MAX_ROUNDS = 200


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (a > b): each node's neighbours (large: those above it; small: those below it and itself) are joined to the least of
    its neighbours and itself.  The least ones are written before they are joined, so that Spark can split the join of a node with very many edges."""
    key = "b" if large else "a"
    around = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = common.written(around.groupBy(F.col("a").alias(key)).agg(F.min(F.least("a", "b")).alias("m")), "components-least")
    met = edges.join(least, key)
    if large:
        out = met.select("a", F.col("m").alias("b"))
    else:
        out = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """node, comp (its component's smallest node) for every node of edges (a, b); loops and repeated edges don't matter."""
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, before = common.written(edges, "components"), None
    for _ in range(MAX_ROUNDS):
        total = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if total == before or total[0] == 0:
            break
        before = total
        if _is_stars(edges):
            break
        edges = common.written(_star(_star(edges, large=True), large=False), "components")
    else:
        raise RuntimeError("components did not settle")
    stars = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("comp"))
    return common.written(stars.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct()), "components")


def _is_stars(edges: DataFrame) -> bool:
    """Whether every node either points to one root only or is a root."""
    many = edges.groupBy("a").count().where("count > 1").select("a")
    roots = edges.select(F.col("b").alias("a")).distinct().join(edges.select("a").distinct(), "a", "left_semi")
    return not many.unionByName(roots).limit(1).count()

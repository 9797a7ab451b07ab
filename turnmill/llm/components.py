"""Connected components of an edge table, all in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b); a component's name is its least node.

    Alternating large and small stars: each round hangs every node's neighbours on the least of them, so the depth shrinks
    geometrically; an error tells if ``rounds`` of them don't end it. Each round's edges go to the shared folder; the driver sees their number and a checksum. Self-loops and
    repeated edges don't matter; null ends are ignored; no edges give no nodes.
    """
    clean = edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).where(F.col("a").isNotNull() & F.col("b").isNotNull())
    given = checkpoint(clean.distinct())
    loops = given.where("lo = hi").select("lo")
    now = given.where("lo < hi")
    seen = None
    for left in range(rounds, -1, -1):
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first())
        if mark == seen or not mark[0]:
            break
        if not left:
            raise RuntimeError(f"components: not done after {rounds} rounds")
        seen = mark
        # a node's least neighbour, if less than itself, is at the other end of an edge that ends in it
        least = now.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("m"))
        large = now.join(least, F.col("lo") == F.col("node"), "left").select("hi", F.coalesce("m", "lo").alias("lo"))
        root = large.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("m"))
        small = large.join(root, F.col("hi") == F.col("node")).select(F.explode(F.array(F.struct(F.col("m").alias("lo"), F.col("hi")), F.struct(F.col("m").alias("lo"), F.col("lo").alias("hi")))).alias("e"))
        now = checkpoint(small.select("e.lo", "e.hi").where("lo < hi").distinct())
    tree = now.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    roots = now.select(F.col("lo").alias("node"), F.col("lo").alias("component"))
    alone = loops.select(F.col("lo").alias("node"), F.col("lo").alias("component"))
    return tree.unionByName(roots).unionByName(alone).groupBy("node").agg(F.min("component").alias("component"))

"""Connected components of an edge table by alternating star contraction, in Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedsieve.llm.common import checkpoint, compact


def _star(edges: DataFrame, small: bool, rows: int) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if small:
        both = both.where("b < a")
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
    near = both if small else both.where("b > a")
    moved = compact(near.join(least, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b")), rows)
    if small:
        moved = moved.union(compact(least.select(F.col("k").alias("a"), F.col("m").alias("b")), rows))
    return compact(moved.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), rows)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge; edges has long columns a and b.  The root is the smallest node.

    Each round is a few joins of the edge table with itself; rounds grow with the
    logarithm of the longest path.  Every round's table is checkpointed, in partitions for
    its number of rows.
    """
    edges = checkpoint(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    sums = [F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")]
    seen = edges.agg(*sums).first()
    for _ in range(rounds):
        if not seen[0]:
            break
        edges = compact(edges, seen[0])
        edges = checkpoint(_star(_star(edges, small=False, rows=seen[0]), small=True, rows=seen[0]))
        now = edges.agg(*sums).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    edges = compact(edges, seen[0])
    rooted = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return rooted.union(compact(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct(), seen[0]))

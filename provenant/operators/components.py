"""Connected components of a table of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenant.functions.storage import checkpoint


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
    return row["n"], int(row["h"] or 0)


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the least of its neighbourhood."""
    both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).union(edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
    least = both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("x0"), F.least("x", "m").alias("m"))
    return both.where("y > x").join(least, F.col("x") == F.col("x0")).select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are tied to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("u0"), "m")
    tied = edges.join(least, F.col("u") == F.col("u0")).select("u", "v", "m")
    ends = tied.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
    return ends.select("e.u", "e.v").where("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Columns a and b of edges -> node, root: the least node that can be reached, for every node of an edge.

    Rows with a null or with a = b tie nothing; repeated rows count once; no edges give no rows. Rounds grow with the
    logarithm of the longest path; each round's edges are checkpointed.
    """
    edges = checkpoint(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    state = _state(edges)
    while state[0]:
        edges = checkpoint(_small_star(_large_star(edges)))
        now = _state(edges)
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())

"""Connected components of a graph given as a table of edges, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .skew import dealt
from .storage import discard, materialise


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node around it."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(dealt(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them. Edges have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(dealt(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v) of any orderable type → (node, root): each node of an edge with its component's smallest node.

    Self-loops, repeated edges and nulls are ignored; an empty table gives an empty one. Every round is a table in
    the shared folder, so lost executors cost one round at most; rounds grow with the logarithm of the size. The
    driver gets two numbers a round. A node with very many edges takes part in joins that Spark can split.
    """
    spark = edges.sparkSession
    start = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, path, mark = _marked(start)
    seen = None
    while mark[0] and mark != seen:
        seen = mark
        after, new_path, mark = _marked(_small_star(_large_star(now)))
        discard(spark, path)
        now, path = after, new_path
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _marked(edges: DataFrame) -> tuple[DataFrame, str, tuple]:
    """(table, path, number and sum of hashes of the rows): written, and marked on the way."""
    seen = Observation()
    marked = edges.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum"))
    table, path = materialise(marked, "stars")
    return table, path, (seen.get["n"], seen.get["sum"])

"""Connected components of an edge table, by alternating large and small stars.

Each round is two groupings and two joins; no neighbour list is ever collected, so a node with very many
neighbours is split by skew_join(). Rounds are cut by checkpoints in the shared folder, and go on until a
round changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import checkpointed, fewer_parts, skew_join


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links each node's neighbours (above it, or itself and those below it) to the least of all."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = checkpointed(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n"))
    joined = skew_join(both, least, ["a"], "n")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b); root is the least node of its component. Self-links count as nodes."""
    start = edges.select("a", "b")
    nodes = start.select(F.col("a").alias("node")).union(start.select("b")).distinct()
    state = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    now = checkpointed(start.where("a != b").distinct())
    after = state(now)
    before = None
    while after != before and after[0]:
        before = after
        now = checkpointed(_star(_star(fewer_parts(now, before[0]), True), False))
        after = state(now)
    return nodes.join(now.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))

"""Connected components of an edge table by alternating stars, in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import in_two_stages, staged

ROUNDS = 50


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Link neighbours to the smallest one: of larger nodes only, or of smaller ones."""
    if larger:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    # A node with very many neighbours is summed before the shuffle and split in the join.
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    least = in_two_stages(least.select("a", F.least("a", "m").alias("m")))
    linked = both.join(least, "a")
    if larger:
        out = linked.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            least.select("a", F.col("m").alias("b"))
        )
    return out.filter(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes with an edge; a component is its smallest node. Edges
    are rows (a, b) of longs. Stops when a round of both stars changes nothing."""
    edges = staged(edges.filter(F.col("a") != F.col("b")).select("a", "b").distinct(), "edges")

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = state(edges)
    for _ in range(ROUNDS):
        if not before[0]:
            break
        edges = staged(_star(_star(edges, larger=True), larger=False), "edges")
        now = state(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return stars.union(roots)

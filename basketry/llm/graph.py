"""Connected components of link tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.store import discard, staged


def _star(edges: DataFrame, upward: bool) -> tuple[DataFrame, DataFrame]:
    """Point the larger (upward) or smaller-or-equal neighbours of every node at its least neighbour, itself included.

    Returns the new links and the staged table that they are made of.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if not upward:
        both = both.filter("b < a")
    least = staged(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")
    moved = both.join(least, "a")
    if upward:
        return moved.filter("b > a").select(F.col("b").alias("x"), F.col("m").alias("y")), least
    kept = moved.select(F.col("b").alias("x"), F.col("m").alias("y"))
    return kept.unionByName(least.select(F.col("a").alias("x"), F.col("m").alias("y"))), least


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """The component of every node of an edge table: node, component (its least node).

    Alternates the large-star and small-star steps until nothing changes, which takes a few rounds on groups of
    copies and about the logarithm of the longest chain otherwise. Every round is written to the shared folder. A
    node with many links is one key of a min() with map-side partial sums and of a join that can be split.
    Null ends, loops and repeated edges are ignored; no edges give no rows.
    """
    e = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter(f"{a} is not null and {b} is not null").filter("a < b").distinct()
    e, before = staged(e, "edges"), None
    while True:
        for upward in (True, False):
            moved, least = _star(e, upward)
            old, e = e, staged(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).filter("a < b").distinct(), "edges")
            discard(old, least)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
        if now == before:
            break
        before = now
    leaves = e.select(F.col("b").alias("node"), F.col("a").alias("component"))
    roots = e.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return leaves.unionByName(roots)

"""Minimum spanning forests by Borůvka rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .storage import forget, stored


def spanning_forest(edges: DataFrame, by: list[str]) -> DataFrame:
    """(by, a, b): edges of a minimum spanning forest of each graph of ``by``, for edges (by, a, b) with a < b that are ordered by (b, a).

    In each round every component takes its least edge to another one, which at least halves those that have one. What the
    edges taken join is a tree in which two components take the same edge, and the lesser of them is its root; pointers to it double in
    length with each join. No component is ever gathered, and of parallel edges between two components the least stays. Repeated edges
    count once; loops and null ends make none. Every step is a table in the shared folder, and joins are by sort and merge, as files say little of rows.
    """
    least = lambda c: F.min(F.struct("b", "a", c))
    e = stored(edges.where("a < b").select(*by, "a", "b", F.col("a").alias("ca"), F.col("b").alias("cb")).distinct(), "edges")
    taken = None
    while not e.isEmpty():  # rounds grow with the logarithm of the nodes
        both = e.select(*by, "a", "b", F.col("ca").alias("c"), F.col("cb").alias("to")).union(e.select(*by, "a", "b", F.col("cb"), F.col("ca")))
        best = stored(both.groupBy(*by, "c").agg(least("to").alias("e")).select(*by, "c", F.col("e.to").alias("p"), "e.a", "e.b"), "least")
        now = best.select(*by, "a", "b").distinct()
        taken = now if taken is None else taken.union(now)
        back = best.select(*by, F.col("c").alias("p"), F.col("p").alias("c2"))
        roots = best.join(back.hint("merge"), [*by, "p"]).select(*by, "c", F.when((F.col("c2") == F.col("c")) & (F.col("c") < F.col("p")), F.col("c")).otherwise(F.col("p")).alias("p"))
        up = _to_roots(stored(roots, "up"), by)
        at = lambda old, new: up.select(*by, F.col("c").alias(old), F.col("p").alias(new))
        moved = e.join(at("ca", "x").hint("merge"), [*by, "ca"]).join(at("cb", "y").hint("merge"), [*by, "cb"]).where("x <> y")
        once: Column = F.struct("b", "a")
        rest = moved.groupBy(*by, F.least("x", "y").alias("ca"), F.greatest("x", "y").alias("cb")).agg(F.min(once).alias("e")).select(*by, "e.a", "e.b", "ca", "cb")
        old, e = e, stored(rest, "edges")
        forget(old, up)
    return edges.select(*by, "a", "b").limit(0) if taken is None else taken


def _to_roots(up: DataFrame, by: list[str]) -> DataFrame:
    """Pointers (by, c, p) of trees, of which a root points to itself, all led to the root."""
    while True:
        further = up.select(*by, F.col("c").alias("p"), F.col("p").alias("top"))
        longer = stored(up.join(further.hint("merge"), [*by, "p"]).select(*by, "c", F.col("top").alias("p"), (F.col("top") != F.col("p")).alias("moved")), "up")
        done = longer.where("moved").isEmpty()
        forget(up)
        up = longer.drop("moved")
        if done:
            return up

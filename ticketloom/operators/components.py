"""Connected components by iterated minimum-label contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketloom.session import discard, written


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every vertex of an edge of two different ends; component is the smallest id reached.

    Each round every vertex takes the smallest label among itself and its
    neighbours, and the edges are contracted to those labels: the smallest
    vertex of a component keeps its label, so it is what remains. The edges
    shrink from round to round; a hub is only ever reduced by min(), which is
    combined before the shuffle. Null ends are no edge; loops and repeated
    edges change nothing; no edges give an empty table.
    """
    ends = edges.select(F.col(a).cast("bigint").alias("a"), F.col(b).cast("bigint").alias("b"))
    ends = ends.where("a is not null and b is not null and a <> b")
    current = written(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    mapping: DataFrame | None = None
    while True:
        both = current.select("a", "b").unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("p"))
        least = written(least, "labels")
        if mapping is None:
            mapping = least.select(F.col("v").alias("id"), F.col("p").alias("component"))
            mapping._ticketloom_path = getattr(least, "_ticketloom_path", None)
        else:
            moved = mapping.join(least.select(F.col("v").alias("component"), "p"), "component", "left")
            moved = written(moved.select("id", F.coalesce("p", "component").alias("component")), "components")
            discard(mapping)
            mapping = moved
        pa, pb = least.select(F.col("v").alias("a"), F.col("p").alias("x")), least.select(F.col("v").alias("b"), F.col("p").alias("y"))
        nxt = current.join(pa, "a").join(pb, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        nxt = written(nxt, "edges")
        done = nxt.isEmpty()
        discard(current)
        if getattr(mapping, "_ticketloom_path", None) != getattr(least, "_ticketloom_path", None):
            discard(least)
        if done:
            discard(nxt)
            return mapping
        current = nxt

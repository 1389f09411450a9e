"""Connected components of a distributed graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup_join, materialize


def components(edges: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """(v, p) for every vertex of ``edges`` (a, b): ``p`` is the smallest vertex reachable.

    Each round, a vertex takes the least parent among its neighbours', and
    then its parent's parent; ends when a round changes nothing. Minima are
    taken map-side before the shuffle and looked up through a join that can
    split hot vertices, so a star of any size is no single task. ``start``
    (v, p) may give components already known: they count as edges too, so that
    a new edge at any of its vertices moves the whole component.
    """
    if start is not None:
        edges = edges.select("a", "b").union(start.select(F.col("v").alias("a"), F.col("p").alias("b")))
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = materialize(both, "edges")
    vertices = both.select(F.col("a").alias("v"), F.col("a").alias("p"))
    if start is not None:
        vertices = vertices.union(start.select("v", "p"))
    parents = materialize(vertices.groupBy("v").agg(F.min("p").alias("p")), "parents")
    size = parents.count()
    while True:
        seen = lookup_join(both, parents.select(F.col("v").alias("b"), F.col("p").alias("q")), "b", rows=size)
        least = seen.groupBy(F.col("a").alias("v")).agg(F.min("q").alias("q"))
        moved = parents.join(least, "v", "left").select("v", F.least("p", F.coalesce("q", "p")).alias("p"), F.col("p").alias("old"))
        moved = materialize(moved, "hooked")
        # a vertex that is a parent keeps its own parent under its name
        up = moved.select(F.col("v").alias("p"), F.col("p").alias("top"))
        jumped = lookup_join(moved, up, "p", rows=size).select("v", F.least("p", F.coalesce("top", "p")).alias("p"), "old")
        jumped = materialize(jumped, "jumped")
        changed = jumped.where("p <> old").limit(1).count()
        parents = jumped.select("v", "p")
        if not changed:
            return parents

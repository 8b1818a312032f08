"""Connected components over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from curbsight.functions.lineage import cut


def _follow(parents: DataFrame, keys: list[str]) -> DataFrame:
    """Replace each parent by its own parent."""
    up = parents.select(*keys, F.col("v").alias("parent"), F.col("parent").alias("next"))
    return parents.join(up, [*keys, "parent"], "left").select(
        *keys, "v", F.coalesce("next", "parent").alias("parent"))


def components(vertices: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, v, root): the lowest vertex number each vertex is connected to.

    ``vertices`` has (keys, v), ``edges`` has (keys, a, b) in either direction. Each round
    hangs every vertex on its lowest neighbour, merges the vertices along these links and
    drops the edges that have become loops, so the graph shrinks several times per round and
    the lowest vertex of a component is the one that is left. Minimum and distinct are taken
    per task before the shuffle: a vertex with very many neighbours is no hot spot.
    """
    labels = vertices.select(*keys, "v", F.col("v").alias("root"))
    low, high = F.least("a", "b"), F.greatest("a", "b")
    edges = cut(edges.filter("a <> b").select(
        *keys, low.alias("a"), high.alias("b")).distinct())
    while not edges.isEmpty():
        # With a < b, only b can hang on a; a vertex without lower neighbours is its own parent.
        hung = edges.groupBy(*keys, F.col("b").alias("v")).agg(F.min("a").alias("parent"))
        parents = cut(_follow(_follow(hung, keys), keys))
        a_up = parents.select(*keys, F.col("v").alias("a"), F.col("parent").alias("pa"))
        b_up = parents.select(*keys, F.col("v").alias("b"), F.col("parent").alias("pb"))
        pa, pb = F.coalesce("pa", "a"), F.col("pb")
        merged = edges.join(b_up, [*keys, "b"]).join(a_up, [*keys, "a"], "left")
        edges = cut(merged.filter(pa != pb).select(
            *keys, F.least(pa, pb).alias("a"), F.greatest(pa, pb).alias("b")).distinct())
        roots = parents.select(*keys, F.col("v").alias("root"), "parent")
        labels = labels.join(roots, [*keys, "root"], "left").select(
            *keys, "v", F.coalesce("parent", "root").alias("root"))
    return labels

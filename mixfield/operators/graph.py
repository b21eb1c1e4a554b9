"""Connected components of an edge list, without GraphFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixfield.operators.storage import discard, written


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for each node of ``edges(a, b)``: the smallest node that it is connected with.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until the edges are stars; the number of rounds grows
    with the logarithm of the size of a component. Each round is written to the shared folder, so that lost
    executors cost no earlier round. Hubs are only ever joined and summed by key, and no component is gathered in a task.
    Edges from a node to itself are ignored; without edges the result is empty.
    """
    stars = written(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while (now := stars.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()) != seen:
        seen = now
        both = stars.union(stars.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        before = stars
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        stars = written(small.where("a != b").distinct(), "edges")
        discard(before)
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).union(stars.select("b", "b").distinct())


def label_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, label`` for each of ``nodes(id)``: the smallest id of its component, its own if it has no edge."""
    found = components(edges)
    return nodes.join(found, nodes.id == found.node, "left").select("id", F.coalesce("root", "id").alias("label"))

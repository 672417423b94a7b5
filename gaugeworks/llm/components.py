"""Connected components of links between long ids, by contraction.

In each round every vertex points to its smallest neighbour or itself, pointers are followed
twice, and the links between different pointers form the next, smaller graph. Ids only get
smaller and the least id of a component never moves, so it names the component in the end. Each
round is an aggregation with map-side combine and joins against unique keys, written to the
shared folder: nothing depends on one key's number of links, and a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.store import materialise, small_or_shuffled


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every id that has a link; ``component`` is the smallest id reachable."""
    edges = materialise(links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct(), "edges")
    labels: DataFrame | None = None
    while not edges.isEmpty():
        both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = materialise(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p")), "pointers")
        up = small_or_shuffled(point.select(F.col("a").alias("p"), F.col("p").alias("q")), 16)
        jump = materialise(point.join(up, "p").select("a", F.col("q").alias("p")), "jumps")
        to = small_or_shuffled(jump, 16)
        if labels is None:
            labels = jump.select(F.col("a").alias("id"), F.col("p").alias("component"))
        else:
            held = labels.join(to.select(F.col("a").alias("component"), "p"), "component", "left")
            labels = held.select("id", F.coalesce("p", "component").alias("component"))
        labels = materialise(labels, "labels")
        moved = edges.join(to, "a").select(F.col("p").alias("a"), "b").join(to.select(F.col("a").alias("b"), F.col("p").alias("q")), "b")
        edges = materialise(moved.select(F.least("a", "q").alias("a"), F.greatest("a", "q").alias("b")).where("a < b").distinct(), "edges")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")) if labels is None else labels

"""Connected components of a graph given as edges, by contraction to the smallest neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folionaut.llm.session import staged


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id connected with each id of the ``a, b`` edges.

    In each round every node points to its smallest neighbour and edges move to the nodes pointed at, until none is left;
    the pointers of all rounds are then followed. Edges and pointers stay tables on shared storage throughout.
    """
    left = staged(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    found: DataFrame | None = None
    while True:
        ends = left.select(F.col("a").alias("id"), F.col("b").alias("other")).unionAll(left.select("b", "a"))
        to = staged(ends.groupBy("id").agg(F.min("other").alias("other")).select("id", F.least("id", "other").alias("component")))
        if found is None:
            found = to
        else:
            later = to.select(F.col("id").alias("component"), F.col("component").alias("next"))
            found = staged(found.join(later, "component", "left").select("id", F.coalesce("next", "component").alias("component")))
        first = to.select(F.col("id").alias("a"), F.col("component").alias("p"))
        second = to.select(F.col("id").alias("b"), F.col("component").alias("q"))
        moved = left.join(first, "a").join(second, "b").where("p <> q")
        left = staged(moved.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct())
        if left.isEmpty():
            return found

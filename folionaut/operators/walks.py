"""Walks from many seeds at once: each seed has its own visited entities, its own order and its own budget of edges."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folionaut.operators.durable import durable
from folionaut.operators.fusion import ranked_per_group
from folionaut.operators.traverse import neighbours
from folionaut.settings import FolioError


class Walks(NamedTuple):
    reached: DataFrame  # (seed, entity_id, depth, place)
    edges: DataFrame  # (seed, relationship_id, depth, place, at, next_id, orientation)
    truncated: DataFrame  # (seed) whose budget ended before its edges


def _order() -> Column:
    """Outgoing edges of an entity come first, incoming ones by their source; entities in the order they were reached."""
    incoming = F.col("orientation") == "incoming"
    return F.struct("place", incoming.alias("incoming"), F.when(incoming, F.col("source_id")).alias("source_id"), "line_start", "relationship_id")


def walk_all(resolved: DataFrame, seeds: DataFrame, direction: str, kinds: tuple[str, ...] | None, depth: int, budget: int) -> Walks:
    """Breadth-first walks of ``seeds`` (seed, entity_id), at most ``depth`` steps and ``budget`` edges for each seed.

    A step joins the newest entities of all seeds with the edges, so a thousand walks cost as many jobs as one. An edge counts
    once for a seed, where it comes first; an entity is walked on from once, so cycles end. Before rows of a seed meet, each
    task keeps only the first ``budget`` + 1 of them, whatever the number of edges at a name. Nulls among the seeds and
    repeated seeds take no part; edges without a target count, but lead nowhere.
    """
    if depth < 1 or budget < 1:
        raise FolioError("CONFIG_INVALID", "depth and budget must be positive")
    start = seeds.filter(F.col("seed").isNotNull() & F.col("entity_id").isNotNull()).select("seed", "entity_id").distinct()
    newest = durable(start.withColumn("depth", F.lit(0)).withColumn("place", F.lit(0)))
    reached, taken, cut = [newest], [], []
    # Every step reads the edges, so their resolution is done once, for the wanted kinds alone.
    wanted = resolved.filter(F.col("observed_kind").isin(*kinds)) if kinds else resolved
    edges = durable(wanted.select("relationship_id", "from_id", "target_id", "source_id", "line_start", "observed_kind"))
    for step in range(1, depth + 1):
        # One row of a level's entity stands for all seeds at it while edges are looked up.
        found = neighbours(edges, newest.select("entity_id").distinct(), direction, kinds)
        met = newest.select("seed", F.col("entity_id").alias("at"), "place").join(found, "at")
        for before in taken:
            met = met.join(before.select("seed", "relationship_id"), ["seed", "relationship_id"], "left_anti")
        first = met.groupBy("seed", "relationship_id").agg(
            F.min_by(F.struct("at", "next_id", "orientation"), _order()).alias("edge"), F.min(_order()).alias("order")
        )
        ranked = ranked_per_group(first, "seed", ("order",), budget + 1, "rank")
        used = newest.select("seed").distinct().withColumn("used", F.lit(0))
        for before in taken:
            spent = before.groupBy("seed").agg(F.count("*").alias("spent"))
            used = used.join(spent, "seed", "left").select("seed", (F.col("used") + F.coalesce("spent", F.lit(0))).alias("used"))
        level = durable(ranked.join(used, "seed").select("seed", "relationship_id", "edge", "rank", (F.col("rank") + F.col("used")).alias("place")))
        cut.append(level.filter(F.col("place") > budget).select("seed"))
        kept = level.filter(F.col("place") <= budget).select("seed", "relationship_id", F.lit(step).alias("depth"), "place", "edge.*")
        taken.append(kept)
        ahead = kept.filter("next_id IS NOT NULL").groupBy("seed", F.col("next_id").alias("entity_id")).agg(F.min("place").alias("place"))
        for before in reached:
            ahead = ahead.join(before.select("seed", "entity_id"), ["seed", "entity_id"], "left_anti")
        # A walk whose budget is spent goes no further.
        newest = durable(ahead.withColumn("depth", F.lit(step)).select("seed", "entity_id", "depth", "place"))
        if newest.isEmpty():
            break
        reached.append(newest)
        newest = newest.join(cut[-1].distinct(), "seed", "left_anti")
    return Walks(_all(reached), _all(taken), _all(cut).distinct())


def _all(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole

"""Top-k selection and reciprocal rank fusion without ranking a whole corpus in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folionaut.operators.durable import durable


def top_k(scores: DataFrame, score: str, k: int, key: str = "seq") -> DataFrame:
    return scores.orderBy(F.desc(score), F.asc(key)).limit(k)


def sufficient_depth(k: int, channels: int, rrf_k: int) -> int:
    """Rows per channel among which the fused top k must lie.

    Take a row outside the first M of every channel, and of the channels longer than M the one with
    the greatest weight w. The row reaches less than channels * w / (rrf_k + M), while the first k rows
    of that channel reach w / (rrf_k + k) each. With this M they all come before it.
    """
    return channels * (rrf_k + k) - rrf_k


def exact_ranks(channel: DataFrame, wanted: DataFrame, score: str, key: str) -> DataFrame:
    """Ranks, within the whole channel, of the few wanted keys: (key, rank).

    Every row that is not worse than all wanted rows finds how many of them are strictly better (its bin); the rank of
    the n-th wanted row is the number of rows in bins 0..n. ``wanted`` must hold a bounded number of rows.
    """
    place = F.struct((-F.col(score)).alias("negative"), F.col(key).alias("key"))
    chosen = channel.join(F.broadcast(wanted.select(key)), key, "left_semi")
    marks = chosen.agg(F.array_sort(F.collect_list(place)).alias("marks"))
    better = F.size(F.filter("marks", lambda mark: mark < place))
    level = channel.withColumn("marks", marks.scalar()).filter(place <= F.try_element_at("marks", F.lit(-1)))
    bins = level.select(better.alias("bin")).groupBy("bin").count()
    ordered = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = bins.select("bin", F.sum("count").over(ordered).alias("rank"))
    return (
        marks.select(F.posexplode("marks").alias("bin", "mark"))
        .join(running, "bin")
        .select(F.col("mark.key").alias(key), "rank")
    )


def fused_candidates(
    channels: Sequence[tuple[DataFrame, str, float]], k: int, rrf_k: int, key: str = "seq"
) -> DataFrame:
    """Exact fused scores of a bounded set that holds the top k, ties included: (key, score).

    ``channels`` are (frame, score column, weight). A channel is read three times, so its narrow
    (key, score) rows should be kept with ``durable`` where they are costly.
    """
    depth = sufficient_depth(k, len(channels), rrf_k)
    wanted = None
    for frame, score, _ in channels:
        part = top_k(frame.select(key, score), score, depth, key).select(key)
        wanted = part if wanted is None else wanted.union(part)
    wanted = wanted.distinct()
    parts = None
    for frame, score, weight in channels:
        ranks = exact_ranks(frame.select(key, score), wanted, score, key)
        part = ranks.select(key, (F.lit(weight) / (rrf_k + F.col("rank"))).alias("part"))
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy(key).agg(F.sum("part").alias("score"))


def fuse(
    channels: Sequence[tuple[DataFrame, str, float]], k: int, rrf_k: int, key: str = "seq"
) -> DataFrame:
    """Weighted reciprocal rank fusion: the top k by (score, key). Channel rows are computed once."""
    kept = [(durable(frame.select(key, score)), score, weight) for frame, score, weight in channels]
    return top_k(fused_candidates(kept, k, rrf_k, key), "score", k, key)


def ranked_per_group(rows: DataFrame, group: str, order: Sequence, k: int, name: str = "rank") -> DataFrame:
    """Best k rows of each group. Spark keeps k rows per task and group before it shuffles."""
    window = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= k)


def reciprocal_group_rank(rows: DataFrame, group: str, order: Sequence, k: int, rrf_k: int, ties: Sequence) -> DataFrame:
    """Merge collections by rank inside each one; scores of different collections are never compared."""
    ranked = ranked_per_group(rows, group, order, k, "collection_rank")
    scored = ranked.withColumn("fusion_score", 1.0 / (rrf_k + F.col("collection_rank")))
    return scored.orderBy(F.desc("fusion_score"), *ties).limit(k)

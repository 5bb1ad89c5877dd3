"""Read models over the bookkeeping tables: status counts, pages of files, manifests, jobs, versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folionaut.operators.vocabulary import MAX_PAGE
from folionaut.settings import bounded


def status_counts(sources: DataFrame) -> DataFrame:
    return sources.filter(F.col("deleted_at").isNull()).groupBy("status").agg(F.count("*").alias("sources"))


def collection_counts(sources: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: live sources, indexed, failed, and chunks."""
    live = sources.filter(F.col("deleted_at").isNull())
    totals = live.agg(
        F.count("*").alias("sources"),
        F.count_if(F.col("status") == "indexed").alias("indexed_sources"),
        F.count_if(F.col("status") == "failed").alias("failed_sources"),
    )
    return totals.withColumn("chunks", chunks.agg(F.count("*")).scalar())


def list_files(
    sources: DataFrame, extension: str | None = None, path_prefix: str | None = None, status: str | None = None,
    limit: int = 50, offset: int = 0,
) -> DataFrame:
    found = sources.filter(F.col("deleted_at").isNull())
    if extension:
        found = found.filter(F.col("extension") == extension.lower().lstrip("."))
    if path_prefix:
        found = found.filter(F.col("path").startswith(path_prefix))
    if status:
        found = found.filter(F.col("status") == status)
    return found.orderBy("filename", "source_id").offset(max(offset, 0)).limit(bounded("limit", limit, MAX_PAGE))


def manifest(sources: DataFrame) -> DataFrame:
    """Live sources in path order, by a range partitioned sort."""
    return sources.filter(F.col("deleted_at").isNull()).orderBy("path")


def latest_per_key(rows: DataFrame, key: str, when: str, tie: str, columns: list[str]) -> DataFrame:
    """The newest row per key; partial maxima come before the shuffle, so a hot key stays cheap."""
    picked = F.max_by(F.struct(*columns), F.struct(when, tie)).alias("r")
    return rows.groupBy(key).agg(picked).select(key, "r.*")


def first_per_key(rows: DataFrame, key: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): of rows with the same key the first in order is kept."""
    first = rows.groupBy(key).agg(F.min(F.struct(*order)).alias("_first"))
    marked = rows.join(first, key).withColumn("_accepted", F.struct(*order) == F.col("_first")).drop("_first")
    return marked.filter("_accepted").drop("_accepted"), marked.filter("NOT _accepted").drop("_accepted")


def prune_before(rows: DataFrame, column: str, cutoff: Column) -> DataFrame:
    """Retention: rows at or after the cutoff."""
    return rows.filter(F.col(column) >= cutoff)


def without_sources(rows: DataFrame, removed: DataFrame) -> DataFrame:
    """Derived rows of all other sources."""
    return rows.join(removed.select("source_id"), "source_id", "left_anti")


# States of a job.
ACTIVE = ("queued", "running")
COMPLETE = ("completed", "completed_with_errors")


def job_progress(jobs: DataFrame, now: Column) -> DataFrame:
    """Percent done, elapsed and remaining seconds of each job.

    Needs status, phase, total, completed, unchanged, failed, skipped, started_at, processing_started_at,
    finished_at, updated_at.
    """
    active, complete = F.col("status").isin(*ACTIVE), F.col("status").isin(*COMPLETE)
    done = sum((F.coalesce(F.col(c), F.lit(0)) for c in ("completed", "unchanged", "failed", "skipped")), F.lit(0))
    end = F.when(active, now).otherwise(F.coalesce("finished_at", "updated_at"))

    def seconds(start: str) -> Column:
        micros = F.unix_micros(F.col("_end").cast("timestamp")) - F.unix_micros(F.col(start).cast("timestamp"))
        return F.greatest(F.lit(0.0), micros / 1000000.0)

    percent = F.when(F.col("total") > 0, F.least(F.lit(100.0), 100.0 * F.col("processed") / F.col("total"))).when(
        (F.col("total") == 0) & complete, F.lit(100.0)
    )
    phase = F.when(complete, F.lit("finished")).when(~active, F.col("status")).otherwise(F.col("phase"))
    measurable = active & (F.col("phase") == "indexing") & (F.col("processed") > 0) & F.col("total").isNotNull()
    remaining = F.when(complete, F.lit(0.0)).when(
        measurable & F.col("processing_started_at").isNotNull(),
        seconds("processing_started_at") / F.col("processed") * F.greatest(F.lit(0), F.col("total") - F.col("processed")),
    )
    return jobs.withColumn("processed", done).withColumn("_end", end).select(
        *[c for c in jobs.columns if c not in ("phase",)],
        phase.alias("phase"),
        "processed",
        percent.alias("percent"),
        F.round(F.coalesce(seconds("started_at"), F.lit(0.0)), 1).alias("elapsed_seconds"),
        F.round(remaining, 1).alias("estimated_remaining_seconds"),
    )


def graph_status(graph_sources: DataFrame) -> DataFrame:
    """Per parse status: sources, entities and relationships."""
    return graph_sources.groupBy("status").agg(
        F.count("*").alias("sources"),
        F.coalesce(F.sum("entity_count"), F.lit(0)).cast("bigint").alias("entities"),
        F.coalesce(F.sum("relationship_count"), F.lit(0)).cast("bigint").alias("relationships"),
    )

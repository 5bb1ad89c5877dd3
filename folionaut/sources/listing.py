"""File listings: what a scan sees, and how it differs from what is indexed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folionaut.functions.names import extension
from folionaut.functions.text import stable_id

SIDECAR_FOLDER = ".folionaut"


def read_files(spark: SparkSession, root: str, recursive: bool = True, hidden: bool = False, pattern: str | None = None) -> DataFrame:
    """Files below a folder with content and digest; hidden names and sidecar folders are left out.

    Links are not followed. The listing is ordered by path only where an order is asked for.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return describe_files(reader.load(root), root, hidden)


def describe_files(files: DataFrame, root: str, hidden: bool = False) -> DataFrame:
    prefix = "^(?:file:)?/*" + "/*".join(part for part in root.split("/") if part) + "/*"
    relative = F.regexp_replace(F.regexp_replace("path", "^file:", ""), prefix, "")
    described = files.select(
        F.regexp_replace("path", "^file:/*", "/").alias("path"),
        relative.alias("relative_path"),
        F.element_at(F.split("path", "/"), -1).alias("filename"),
        extension(F.col("path")).alias("extension"),
        F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("modified_at"),
        F.sha2("content", 256).alias("content_hash"),
        "content",
    ).withColumn("source_id", stable_id(F.col("path")))
    visible = ~F.concat(F.lit("/"), F.col("relative_path")).contains(f"/{SIDECAR_FOLDER}/")
    if not hidden:
        visible = visible & ~F.concat(F.lit("/"), F.col("relative_path")).rlike(r"/\.")
    return described.filter(visible)


def classify(listing: DataFrame, sources: DataFrame, supported: Column) -> DataFrame:
    """Listing rows with ``classification``: what a scan has to do about each file.

    ``sources`` holds path, content_hash and status of live sources.
    """
    known = sources.select(
        F.col("path"), F.col("content_hash").alias("_hash"), F.col("status").alias("_status"), F.lit(True).alias("_known")
    )
    state = (
        F.when(~supported, "unsupported")
        .when(F.col("_known").isNull(), "new")
        .when(F.col("_status") == "failed", "previously_failed")
        .when((F.col("_status") == "indexed") & (F.col("_hash") == F.col("content_hash")), "unchanged")
        .otherwise("changed")
    )
    return listing.join(known, "path", "left").withColumn("classification", state).drop("_hash", "_status", "_known")


def missing_sources(sources: DataFrame, listing: DataFrame) -> DataFrame:
    """Sources whose file is no longer there."""
    return sources.join(listing.select("path"), "path", "left_anti")

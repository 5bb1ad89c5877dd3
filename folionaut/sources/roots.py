"""Roots of source code: which root a file belongs to, and its path and module below that root."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folionaut.functions import names


def _trimmed(path: Column) -> Column:
    """A folder without closing slashes; the root folder itself is empty."""
    return F.regexp_replace(path, "/+$", "")


def ancestors(path: Column) -> Column:
    """All folders above a file, from the root folder (empty) to its own; none above a plain name."""
    parts = F.split(path, "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return F.when(F.size(parts) > 1, folders).otherwise(F.array().cast("array<string>"))


def with_roots(files: DataFrame, roots: DataFrame) -> DataFrame:
    """``files`` (path, ...) with ``root_key``, ``relative_path``, ``language`` and ``module_key`` under the deepest root above.

    ``roots`` are (root_key, root_path). Each file meets its own folders by equality, so neither many roots nor nested
    ones multiply it, and of the roots above it the longest path counts (equal paths: the smaller key). Files outside all
    roots keep their path and have no root. Two roots may hold the same module: names are looked up within a root only.
    """
    folders = roots.filter(F.col("root_key").isNotNull()).groupBy(_trimmed(F.col("root_path")).alias("_folder")).agg(F.min("root_key").alias("_key"))
    paths = files.select("path").distinct()
    above = paths.withColumn("_folder", F.explode(ancestors(F.col("path")))).join(folders, "_folder")
    deepest = above.groupBy("path").agg(F.max_by(F.struct("_key", "_folder"), F.length("_folder")).alias("_root"))
    found = files.join(deepest, "path", "left")
    relative = F.coalesce(F.substring("path", F.length("_root._folder") + 2, F.length("path")), F.col("path"))
    placed = found.withColumns({"root_key": F.col("_root._key"), "relative_path": relative}).drop("_root")
    language = names.language(F.col("relative_path"))
    return placed.withColumn("language", language).withColumn("module_key", names.module_key(F.regexp_replace("relative_path", "^/+", ""), language))

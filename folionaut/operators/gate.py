"""Which parse results may be shown, and which files must be parsed (again): two sides of one comparison.

Parse results are rows (source_id, content_hash, parser_version, parsed_at, ...), appended by every run and never
changed. A result is valid for a live source while it was made from the indexed content by the current parser. A source
without a valid result is parsed anew from its stored text: its chunks and vectors stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ("source_id", "content_hash", "parser_version")


def live_sources(sources: DataFrame) -> DataFrame:
    return sources.filter((F.col("status") == "indexed") & F.col("deleted_at").isNull())


def wanted(sources: DataFrame, parsers: DataFrame) -> DataFrame:
    """(source_id, content_hash, language, parser_version) that live sources ask for.

    ``parsers`` (language, parser_version) is data: as many rows as there are languages. A source in a language without
    a parser asks for nothing.
    """
    return live_sources(sources).select("source_id", "content_hash", "language").join(F.broadcast(parsers.limit(1000)), "language")


def valid_results(results: DataFrame, sources: DataFrame, parsers: DataFrame) -> DataFrame:
    """The latest result of each live source, where it is valid; partial maxima come before the shuffle."""
    columns = [c for c in results.columns if c != "source_id"]
    held = results.join(wanted(sources, parsers).select(*KEY), list(KEY), "left_semi")
    newest = held.groupBy("source_id").agg(F.max_by(F.struct(*columns), "parsed_at").alias("r"))
    return newest.select("source_id", "r.*")


def backfill(results: DataFrame, sources: DataFrame, parsers: DataFrame) -> DataFrame:
    """(source_id, content_hash, language, parser_version, reason) of live sources to be parsed.

    ``unparsed`` never had a result, ``changed`` had one of other content, ``older_parser`` one of this content by another
    parser.
    """
    asked = wanted(sources, parsers)
    missing = asked.join(results.select(*KEY), list(KEY), "left_anti")
    seen = results.select("source_id", "content_hash").groupBy("source_id").agg(F.lit(True).alias("_any"))
    same = results.select("source_id", "content_hash").distinct().withColumn("_same", F.lit(True))
    known = missing.join(seen, "source_id", "left").join(same, ["source_id", "content_hash"], "left")
    reason = F.when(F.col("_same"), "older_parser").when(F.col("_any"), "changed").otherwise("unparsed")
    return known.select("source_id", "content_hash", "language", "parser_version", reason.alias("reason"))


def stale_results(results: DataFrame, sources: DataFrame, parsers: DataFrame) -> DataFrame:
    """Results that no live source asks for: they can be dropped."""
    return results.join(wanted(sources, parsers).select(*KEY), list(KEY), "left_anti")

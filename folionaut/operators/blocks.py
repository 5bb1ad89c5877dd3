"""A written keyword index in blocks of rows, of which a search reads only those that can hold one of the first k rows.

Rows are dealt to blocks by a hash of their key. ``postings`` has a folder for each block, sorted by term. ``bounds`` has one
narrow row for each term of a block: how many rows hold it, its largest count, and the least length per occurrence. From these
follows the most that the term can add to the score of any row of the block, whatever the mean length has become since.

A search takes blocks in the order of the most that their rows can reach, in growing rounds, and ends when the next block stays
below the k-th score found. The rows are exactly those of a search that reads everything; equal scores go by key.
Words repeat their weight as they repeat in the query. Phrases of several words need positions: they are refused here.
An empty query, an empty table and a query without hits give no rows. Null texts are empty; null keys take no part.
"""

from __future__ import annotations

import math
from collections import Counter
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folionaut.functions.text import query_phrases
from folionaut.operators import bm25
from folionaut.settings import FolioError

# A block of this many rows has some megabytes of postings: one task writes it, and its folder is worth opening.
ROWS_PER_BLOCK = 65_536
# Blocks read in one round at most; their numbers pass through the driver.
LARGEST_ROUND = 4_096
# Bounds and scores are sums in another order, so blocks this close to the k-th score are read too.
SLACK = 1e-9


class Found(NamedTuple):
    rows: DataFrame
    blocks_read: int
    blocks: int


def write_index(rows: DataFrame, folder: str, columns: tuple[str, ...] = bm25.TEXT_COLUMNS, key: str = "seq", rows_per_block: int = ROWS_PER_BLOCK) -> None:
    """Write ``statistics``, ``postings`` and ``bounds`` below ``folder``. A lost executor's tasks write their files again."""
    spark = rows.sparkSession
    rows = rows.filter(F.col(key).isNotNull())
    bm25.corpus_statistics(bm25.lengths(rows, columns, key)).write.mode("overwrite").parquet(f"{folder}/statistics")
    total = spark.read.parquet(f"{folder}/statistics").first()["rows"]
    blocks = max(1, math.ceil(total / rows_per_block))
    listed = bm25.postings(rows, columns, key).select("term", key, "tf", "length", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("block"))
    listed.repartition(blocks, "block").sortWithinPartitions("block", "term", key).write.mode("overwrite").partitionBy("block").parquet(f"{folder}/postings")
    written = spark.read.schema(listed.schema).parquet(f"{folder}/postings")
    bounds = written.groupBy("block", "term").agg(
        F.count("*").alias("rows"), F.max("tf").alias("most"), F.min(F.col("length") / F.col("tf")).alias("least_spread"), F.min(key).alias("first_key")
    )
    bounds.repartitionByRange("term", "block").sortWithinPartitions("term", "block").write.mode("overwrite").parquet(f"{folder}/bounds")


def _weight(weights: dict[str, float]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(part) for pair in weights.items() for part in pair]), F.col("term"))


def search(spark: SparkSession, folder: str, query: str, k: int, key: str = "seq", candidates: DataFrame | None = None) -> Found:
    """The first k rows (key, keyword_score), and how many of the blocks were read. ``candidates`` are the keys that count.

    At most k rows, the numbers of one round's blocks and one row for each word of the query reach the driver.
    """
    wanted = Counter(query_phrases(query))
    if any(len(phrase) > 1 for phrase in wanted):
        raise FolioError("QUERY_INVALID", "phrases of several words need an index with positions")
    words = {phrase[0]: count for phrase, count in wanted.items()}
    totals = spark.read.parquet(f"{folder}/statistics").first()
    bounds = spark.read.parquet(f"{folder}/bounds").filter(F.col("term").isin(list(words)))
    held = {row["term"]: row["rows"] for row in bounds.groupBy("term").agg(F.sum("rows").alias("rows")).collect()}
    weights = {word: count * bm25.idf(totals["rows"], held[word]) for word, count in words.items() if word in held}
    ddl = f"{key} {bounds.schema['first_key'].dataType.simpleString()}, keyword_score double"
    if not weights:
        return Found(spark.createDataFrame([], ddl), 0, 0)
    postings = spark.read.parquet(f"{folder}/postings")
    mean = totals["mean_length"] or 1.0
    # The saturation of the score, written so that it falls with 1/count and with length/count.
    most = F.lit(bm25.K1 + 1) / (1 + bm25.K1 * (1 - bm25.B) / F.col("most") + bm25.K1 * bm25.B / mean * F.col("least_spread"))
    reach = bounds.groupBy("block").agg(F.sum(_weight(weights) * most).alias("reach"))
    total = reach.count()
    best: list[tuple] = []
    read, size, last = 0, k, None
    while True:
        open_ = reach
        if last is not None:
            open_ = open_.filter((F.col("reach") < last[0]) | ((F.col("reach") == last[0]) & (F.col("block") > last[1])))
        if len(best) == k:
            open_ = open_.filter(F.col("reach") >= best[-1][1] - SLACK)
        turn = [(row["reach"], row["block"]) for row in open_.orderBy(F.desc("reach"), "block").limit(size).collect()]
        if not turn:
            break
        part = _weight(weights) * bm25.saturation(F.col("tf").cast("double"), F.col("length"), mean)
        hits = postings.filter(F.col("block").isin([block for _, block in turn]) & F.col("term").isin(list(weights)))
        scores = hits.groupBy(key).agg(F.sum(part).alias("keyword_score"))
        if candidates is not None:
            scores = scores.join(candidates.select(key), key, "left_semi")
        found = [(row[key], row["keyword_score"]) for row in scores.orderBy(F.desc("keyword_score"), key).limit(k).collect()]
        best = sorted(best + found, key=lambda row: (-row[1], row[0]))[:k]
        read, last, size = read + len(turn), turn[-1], min(size * 2, LARGEST_ROUND)
    return Found(spark.createDataFrame(best, ddl), read, total)

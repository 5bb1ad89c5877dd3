"""Outbox events with doubled and late deliveries, and cards written by parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from folionaut.plans import cardstore
from folionaut.streaming import changes
from suite.registry import query, table


def outbox(spark, folder):
    """Events of a user as changes of one key; every fifth event is delivered twice, and partitions arrive in any order."""
    events = table(spark, folder, "lineitem", "l_orderkey").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("event_id"), (F.col("l_partkey") % 500).alias("key"),
        F.xxhash64("l_orderkey", "l_linenumber").alias("_order"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("sequence"),
        F.when(F.col("l_linenumber") % 3 == 0, "delete").otherwise("upsert").alias("kind"), F.col("l_extendedprice").cast("string").alias("payload"),
    ).drop("_order")
    return events.unionByName(events.where("event_id % 5 = 0"))


@query(
    "outbox_current_rows",
    """WITH e AS (SELECT l_partkey % 500 AS key, l_orderkey * 8 + l_linenumber AS sequence, CASE WHEN l_linenumber % 3 = 0 THEN 'delete' ELSE 'upsert' END AS kind FROM lineitem),
    n AS (SELECT key, max(sequence) AS sequence, arg_max(kind, sequence) AS kind FROM e GROUP BY key)
    SELECT key, sequence FROM n WHERE kind <> 'delete'""",
)
def outbox_current_rows(spark, folder):
    return changes.current_rows(changes.newest_events(outbox(spark, folder))).select("key", "sequence")


CARDS_SQL = """
held AS (SELECT p_partkey AS source_id, 'c' || p_partkey AS card_id FROM part WHERE p_partkey % 2 = 0),
writes AS (SELECT p_partkey AS write_no, p_partkey AS source_id, CASE p_size % 6 WHEN 0 THEN 'invalid' WHEN 1 THEN 'not_card' ELSE 'card' END AS outcome,
  CASE WHEN p_size % 6 > 1 THEN CASE WHEN p_partkey % 2 = 0 THEN 'd' || p_partkey % 40 ELSE 'c' || (p_partkey - 1 + p_size % 3 * 2) END END AS card_id FROM part),
fresh AS (SELECT *, row_number() OVER (PARTITION BY card_id ORDER BY write_no) = 1 AS ok FROM writes WHERE outcome = 'card' AND source_id % 2 = 0),
gone AS (SELECT w.source_id, w.write_no AS leaves FROM writes w LEFT JOIN fresh f USING (source_id) WHERE w.source_id % 2 = 0 AND (w.outcome = 'not_card' OR f.ok)),
taken AS (SELECT w.*, CASE WHEN h.source_id IS NULL THEN -1 ELSE coalesce(g.leaves, 9e18::BIGINT) END AS free_from
  FROM writes w LEFT JOIN held h USING (card_id) LEFT JOIN gone g ON g.source_id = h.source_id WHERE w.outcome = 'card' AND w.source_id % 2 = 1),
odd AS (SELECT *, write_no > free_from AND row_number() OVER (PARTITION BY card_id, write_no > free_from ORDER BY write_no) = 1 AS ok FROM taken),
settled AS (SELECT source_id, write_no, card_id, ok FROM fresh UNION ALL SELECT source_id, write_no, card_id, ok FROM odd
  UNION ALL SELECT source_id, write_no, NULL, outcome = 'not_card' FROM writes WHERE outcome <> 'card')"""


def card_writes(spark, folder):
    """Even parts hold a card each. All parts write: odd ones ask for cards of even ones, before or after these move on."""
    part = table(spark, folder, "part", "p_partkey")
    key, kind, text = F.col("p_partkey"), F.col("p_size") % 6, lambda x: x.cast("string")
    even = key % 2 == 0
    held = part.where(even).select(text(key).alias("source_id"), F.concat(F.lit("c"), text(key)).alias("card_id"))
    asked = F.when(even, F.concat(F.lit("d"), text(key % 40))).otherwise(F.concat(F.lit("c"), text(key - 1 + F.col("p_size") % 3 * 2)))
    writes = part.select(
        key.cast("bigint").alias("write_no"), text(key).alias("source_id"),
        F.when(kind == 0, "invalid").when(kind == 1, "not_card").otherwise("card").alias("outcome"), F.when(kind > 1, asked).alias("card_id"),
    )
    return held, writes


@query(
    "card_rejected_writes",
    "WITH" + CARDS_SQL + """ SELECT write_no, source_id::VARCHAR AS source_id, CASE WHEN card_id IS NULL THEN 'KNOWLEDGE_CARD_INVALID' ELSE 'KNOWLEDGE_CARD_DUPLICATE' END AS code
    FROM settled WHERE NOT ok""",
)
def card_rejected_writes(spark, folder):
    held, writes = card_writes(spark, folder)
    return cardstore.merged(held, writes, cardstore.settle(held, writes))[1]


@query(
    "card_live_after_batch",
    "WITH" + CARDS_SQL + """,
    after_ AS (SELECT source_id, card_id FROM held WHERE source_id NOT IN (SELECT source_id FROM settled WHERE ok)
      UNION ALL SELECT source_id, card_id FROM settled WHERE ok AND card_id IS NOT NULL)
    SELECT source_id::VARCHAR AS source_id, card_id FROM after_ JOIN part ON p_partkey = source_id WHERE p_size % 10 <> 7 AND p_partkey % 17 <> 0""",
)
def card_live_after_batch(spark, folder):
    """The cards after the batch, of sources that neither failed nor were removed."""
    held, writes = card_writes(spark, folder)
    after, _ = cardstore.merged(held, writes, cardstore.settle(held, writes))
    key = F.col("p_partkey")
    sources = table(spark, folder, "part", "p_partkey").select(
        key.cast("string").alias("source_id"), F.when(F.col("p_size") % 10 == 7, "failed").otherwise("indexed").alias("status"),
        F.when(key % 17 == 0, F.current_timestamp()).alias("deleted_at"),
    )
    return cardstore.live_cards(after, sources).select("source_id", "card_id")

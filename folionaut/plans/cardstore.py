"""A collection of cards: which write of which source holds a card id, and searches over what live sources hold.

A write (write_no, source_id, outcome, card_id, ...) is one reading of a source: ``card`` with a card, ``not_card`` where
the file holds none, or ``invalid``. A batch holds at most one write of a source. Writes count in the order of ``write_no``:

* a card replaces what its source held, unless another source holds its id at that moment: then it is rejected, and what
  its source held stays;
* ``not_card`` releases what its source held; ``invalid`` is rejected and releases nothing.

Whether an id is free may hang on an earlier write of its holder, and that one on another's. Each round settles all writes
that no unsettled one stands before; a round is joins by id and source, so no card passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folionaut.functions.porter import stem, stem_token_lists
from folionaut.functions.text import query_phrases
from folionaut.operators import bm25, cards as card_scores, vector
from folionaut.operators.durable import durable

# Why a write is rejected.
DUPLICATE, INVALID = "KNOWLEDGE_CARD_DUPLICATE", "KNOWLEDGE_CARD_INVALID"
LARGEST = (1 << 63) - 1


def settle(held: DataFrame, writes: DataFrame) -> DataFrame:
    """(write_no, source_id, card_id, accepted, code) of all writes. ``held`` is (source_id, card_id) before the batch."""
    asked = writes.select("write_no", "source_id", "outcome", "card_id")
    held = held.select("source_id", "card_id")
    plain = asked.filter(F.col("outcome") != "card").select(
        "write_no", "source_id", F.lit(None).cast("string").alias("card_id"),
        (F.col("outcome") == "not_card").alias("accepted"), F.when(F.col("outcome") != "not_card", INVALID).alias("code"),
    )
    # Who holds the id that a write asks for, and when that holder moves on, if at all.
    own = held.select(F.col("source_id").alias("holder"), "card_id")
    moves = asked.filter(F.col("outcome") != "invalid").select(
        F.col("source_id").alias("holder"), F.col("write_no").alias("leaves"), F.col("card_id").alias("_next")
    )
    open_ = durable(asked.filter(F.col("outcome") == "card").join(own, "card_id", "left").join(moves, "holder", "left").withColumn(
        "leaves", F.when(F.col("_next").eqNullSafe(F.col("card_id")), F.lit(None)).otherwise(F.col("leaves"))
    ).select("write_no", "source_id", "card_id", "holder", "leaves"))
    settled = durable(plain)
    while not open_.isEmpty():
        done = settled.select(F.col("write_no").alias("leaves"), F.col("accepted").alias("_left"))
        known = open_.join(done, "leaves", "left").withColumn("_free_from", _free_from())
        # An id's writes are settled together, once it is known from which moment on the id is free.
        ready = known.groupBy("card_id").agg(
            F.min(F.when(~F.col("source_id").eqNullSafe(F.col("holder")) & (F.col("write_no") > F.col("_free_from")), F.col("write_no"))).alias("_first")
        )
        marked = known.join(ready, "card_id")
        same = F.col("source_id").eqNullSafe(F.col("holder"))
        accepted = same | F.coalesce(F.col("write_no") == F.col("_first"), F.lit(False))
        # A write before its holder's own one finds the id taken, whatever becomes of that one; so no two wait for each other.
        clear = F.col("_free_from").isNotNull() | (F.col("write_no") < F.col("leaves"))
        out = marked.filter(clear).select(
            "write_no", "source_id", "card_id", accepted.alias("accepted"), F.when(~accepted, DUPLICATE).alias("code")
        )
        settled = durable(settled.unionByName(out))
        open_ = durable(marked.filter(~clear).select("write_no", "source_id", "card_id", "holder", "leaves"))
    return settled


def _free_from() -> Column:
    """After which write an id is free: before all where nobody holds it, never where its holder stays, null while open."""
    left = F.when(F.col("_left"), F.col("leaves")).when(~F.col("_left"), F.lit(LARGEST))
    return F.when(F.col("holder").isNull(), F.lit(-1)).when(F.col("leaves").isNull(), F.lit(LARGEST)).otherwise(left).cast("bigint")


def merged(held: DataFrame, writes: DataFrame, settled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cards held after the batch, rejected writes). ``held`` and ``writes`` carry the card's own columns."""
    accepted = settled.filter("accepted").select("write_no", "source_id")
    kept = held.join(accepted.select("source_id"), "source_id", "left_anti")
    new = writes.filter(F.col("outcome") == "card").join(accepted.select("write_no"), "write_no", "left_semi")
    rejected = settled.filter("NOT accepted").select("write_no", "source_id", "code")
    return kept.unionByName(new.select(*held.columns)), rejected


def live_cards(cards: DataFrame, sources: DataFrame) -> DataFrame:
    """Cards whose source is indexed and not removed."""
    live = sources.filter((F.col("status") == "indexed") & F.col("deleted_at").isNull()).select("source_id")
    return cards.join(live, "source_id", "left_semi")


def stored_stems(cards: DataFrame) -> DataFrame:
    """(card_id, token lists as a search needs them): stemmed once, when a card is written."""
    listed = card_scores.with_text_columns(cards).select("card_id", bm25.token_lists(card_scores.CARD_TEXT_COLUMNS).alias("lists"))
    return stem_token_lists(listed, "card_id")


def stored_lexical_scores(stems: DataFrame, cards: DataFrame, query: str, minimum: float) -> DataFrame:
    """(card_id, keyword_score) from stored stems; ``cards`` (card_id, confidence) are the live ones, statistics cover all."""
    phrases = [tuple(stem(word) for word in phrase) for phrase in query_phrases(query)]
    hits = durable(bm25.scores_of_lists(stems, phrases, "card_id").join(cards.select("card_id", "confidence"), "card_id"))
    strongest = hits.agg(F.max("keyword_score")).scalar()
    scored = hits.select("card_id", (F.col("keyword_score") / strongest * F.col("confidence")).alias("keyword_score"))
    return scored.filter(F.col("keyword_score") >= minimum)


def unusable_vectors(vectors: DataFrame, dimensions: int) -> DataFrame:
    """(card_id, field_type) of stored vectors that are null, of another length, without direction, or not finite."""
    return vectors.filter(~F.coalesce(vector_is_usable(F.col("embedding"), dimensions), F.lit(False))).select("card_id", "field_type")


def vector_is_usable(embedding: Column, dimensions: int) -> Column:
    # Fixed values of the contract: largest and smallest size of a component.
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= 3.4e38))
    return (F.size(embedding) == dimensions) & fine & F.exists(embedding, lambda x: F.abs(x) >= 1e-30)

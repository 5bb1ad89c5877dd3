"""Exact duplicates of texts by a minimal perfect hash over the distinct digests of what was seen before.

1. Each text is normalised (A-Z to lower case, nothing else) and becomes its SHA-256 digest; from here on only digests,
   ids and row numbers travel, never texts.
2. The *index* of historical rows: their distinct digests are dealt by digest into shards of about ``SHARD`` digests, and
   each shard gets a minimal perfect hash. A slot holds the whole digest, the locator of the row that stays (its id and
   row number) and the number of rows. An index is a table and serves any number of later tables.
3. Arriving rows are combined by digest inside their tasks, so that a text which a third of all rows share costs one row
   a task, and meet the shards. The slot's digest is compared byte by byte: a member is a repeat and moves the slot's
   winner and number on; nonmembers are grouped among themselves.
4. Winners go back to the rows by a join on the digest, which adaptive execution splits where one digest is frequent.

Of equal texts the row of the largest id stays, of rows with one id the one read last; rows without an id come before all
others, so one stays only in a group without ids. A null text counts as empty. Each row is judged, repeated ones too, and
exactly one row of a group stays. An empty history leaves all to step 3, an empty table gives an empty result. Very long
texts are digested where they are read and kept nowhere. Other columns of ``docs`` pass as they are, under whatever name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folionaut.llm.encoding import binary_column
from folionaut.llm.perfecthash import PerfectHash, digest_matrix
from folionaut.llm.session import staged

#: Digests of one shard, about; an index row of so many takes some 15 MB.
SHARD = 1 << 18
WIDTH = 32
#: Rows that a task combines before it ships them.
COMBINED = 1 << 19
#: What a missing id counts as.
NO_ID = -(1 << 63)

_INDEX = "shard long, sizes binary, bits binary, rest binary, digests binary, ids binary, rows binary, counts binary"
_GROUPS = "shard long, digest binary, id long, row long, n long"


def digest(text: Column | str) -> Column:
    """SHA-256 of a text after lower-casing A-Z only; null counts as empty."""
    text = F.col(text) if isinstance(text, str) else text
    plain = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.unhex(F.sha2(plain.cast("binary"), 256))


def _shard(shards: int) -> Column:
    return F.crc32("digest") % shards


def shards_of(rows: int) -> int:
    return max(1, -(-rows // SHARD))


def _columns(shard: np.ndarray, digests: np.ndarray, ids: np.ndarray, rows: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    binary = binary_column(np.ascontiguousarray(digests).ravel(), np.arange(len(digests) + 1) * WIDTH)
    return pa.RecordBatch.from_arrays(
        [pa.array(shard), binary, pa.array(ids), pa.array(rows), pa.array(n)], ["shard", "digest", "id", "row", "n"]
    )


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return digest_matrix(b"".join(column.to_pylist()), WIDTH)


def _fold(digests: np.ndarray, ids: np.ndarray, rows: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Equal digests as one: the largest (id, row) and the sum of ``n``."""
    key = np.ascontiguousarray(digests).view(f"V{WIDTH}").ravel()
    _, group = np.unique(key, return_inverse=True)
    order = np.lexsort((rows, ids, group))
    last = np.flatnonzero(np.append(np.diff(group[order]) != 0, True))
    best = order[last]
    return digests[best], ids[best], rows[best], np.bincount(group, weights=n).astype(np.int64)


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one task with equal digests as one row."""
    held: list[tuple[np.ndarray, ...]] = []

    def flush() -> pa.RecordBatch:
        digests, ids, rows, n = _fold(*(np.concatenate(x) for x in zip(*held)))
        held.clear()
        return _columns(np.zeros(len(ids), dtype=np.int64), digests, ids, rows, n)

    for batch in batches:
        if batch.num_rows:
            held.append((_matrix(batch.column(1)), batch.column(2).to_numpy(), batch.column(3).to_numpy(), batch.column(4).to_numpy()))
        if sum(len(h[1]) for h in held) >= COMBINED:
            yield flush()
    if held:
        yield flush()


def _locators(digested: DataFrame) -> DataFrame:
    """(shard, digest, id, row, n) of single rows."""
    return digested.select(F.lit(0).cast("long").alias("shard"), "digest", "id", "row", F.lit(1).cast("long").alias("n"))


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """The index of (digest, id, row) rows, one row per shard that is not empty; ``shards_of(rows)`` suits."""
    best = F.max(F.struct("id", "row"))
    distinct = history.groupBy("digest").agg(best.alias("b"), F.count("*").alias("n"))
    distinct = distinct.select(_shard(shards).alias("shard"), "digest", "b.id", "b.row", "n")

    def build(group: pa.Table) -> pa.Table:
        digests = _matrix(group.column("digest"))
        table = PerfectHash.build(digests)
        order = np.argsort(table.slots(digests))
        arrays = [group.column(c).to_numpy()[order].tobytes() for c in ("id", "row", "n")]
        packed = [*table.dump(), np.ascontiguousarray(digests[order]).tobytes(), *arrays]
        names = ["sizes", "bits", "rest", "digests", "ids", "rows", "counts"]
        return pa.table({"shard": group.column("shard").slice(0, 1)} | {k: pa.array([v], pa.binary()) for k, v in zip(names, packed)})

    return distinct.groupBy("shard").applyInArrow(build, _INDEX)


def absorb(arrivals: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """(digest, id, row, n) of each distinct digest of the index and of ``arrivals`` (digest, id, row) together."""
    combined = _locators(arrivals).mapInArrow(_combined, _GROUPS).withColumn("shard", _shard(shards))
    schema = "member boolean, digest binary, id long, row long, n long"

    def meet(arrived: pa.Table, known: pa.Table) -> pa.Table:
        digests, own = _matrix(arrived.column("digest")), [arrived.column(c).to_numpy() for c in ("id", "row", "n")]
        outside = np.ones(len(digests), dtype=bool)
        out = []
        if known.num_rows:
            one = known.to_pylist()[0]
            slots = PerfectHash.load(one["sizes"], one["bits"], one["rest"], WIDTH).slots(digests)
            held = digest_matrix(one["digests"], WIDTH)
            outside = slots < 0
            at = np.flatnonzero(~outside)
            outside[at] = (held[slots[at]] != digests[at]).any(axis=1)
            inside = ~outside
            # Members move their slots on.
            kept = [np.frombuffer(one[c], dtype=np.int64) for c in ("ids", "rows", "counts")]
            slot = np.concatenate([np.arange(len(held)), slots[inside]])
            ids, rows, n = (np.concatenate([k, o[inside]]) for k, o in zip(kept, own))
            order = np.lexsort((rows, ids, slot))
            best = order[np.flatnonzero(np.append(np.diff(slot[order]) != 0, True))]
            total = np.zeros(len(held), dtype=np.int64)
            np.add.at(total, slot, n)
            out.append((np.ones(len(held), dtype=bool), held, ids[best], rows[best], total))
        out.append((np.zeros(int(outside.sum()), dtype=bool), digests[outside], *(o[outside] for o in own)))
        member, digests, ids, rows, n = (np.concatenate(x) for x in zip(*out))
        batch = _columns(np.zeros(len(ids), dtype=np.int64), digests, ids, rows, n)
        return pa.table([pa.array(member), *batch.columns[1:]], names=["member", "digest", "id", "row", "n"])

    met = staged(combined.groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(meet, schema))
    best = F.max(F.struct("id", "row"))
    outside = met.where("not member").groupBy("digest").agg(best.alias("b"), F.sum("n").alias("n"))
    return met.where("member").drop("member").unionByName(outside.select("digest", "b.id", "b.row", "n"))


def _rows(docs: DataFrame, columns: list[str], history: Column | None, id_column: str) -> DataFrame:
    """(doc, digest, old, id, row): written once, so that row numbers stay what they are when a task is run again."""
    mark = F.coalesce(history, F.lit(False)) if history is not None else F.lit(False)
    doc = F.struct(*(F.col(f"`{c}`") for c in columns))
    own = F.coalesce(F.col(f"`{id_column}`").cast("long"), F.lit(NO_ID))
    return staged(docs.select(doc.alias("doc"), digest("text").alias("digest"), mark.alias("old"), own.alias("id"), F.monotonically_increasing_id().alias("row")))


def _groups(rows: DataFrame) -> DataFrame:
    """(digest, id, row, n) of each distinct digest: historical rows are indexed, the others arrive."""
    locators = rows.select("digest", "id", "row", "old")
    shards = shards_of(rows.count())
    index = staged(build_index(locators.where("old"), shards))
    return absorb(locators.where("not old"), index, shards)


def resolved(docs: DataFrame, history: Column | None = None, id_column: str = "doc_id") -> DataFrame:
    """Each row of ``docs`` as one struct column ``doc`` without its text, with ``keep_id``, ``group_size``, ``kept`` and
    ``digest``.

    ``history`` marks the rows that are indexed first; the others arrive at that index. None by default; which rows are
    marked changes no result.
    """
    rows = _rows(docs, [c for c in docs.columns if c != "text"], history, id_column)
    winners = _groups(rows).select("digest", F.col("id").alias("keep_id"), F.col("row").alias("keep_row"), F.col("n").alias("group_size"))
    return rows.join(winners, "digest").select(
        "doc", F.when(F.col("keep_id") != NO_ID, F.col("keep_id")).alias("keep_id"), "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"), "digest",
    )


def deduplicated(docs: DataFrame, history: Column | None = None, id_column: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay, as they were."""
    rows = _rows(docs, docs.columns, history, id_column)
    return rows.join(_groups(rows).select("row"), "row", "left_semi").select("doc.*")

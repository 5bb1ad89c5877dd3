"""Token ids as canonical length-limited Huffman codes.

Format: a folder with ``codebook`` (symbol, code length) and ``blocks``. A row of ``blocks`` is one independent block of
whole documents: its range and number, the documents' keys and sizes, the ids before it in its range, and the bits. The
bit offset of every ``CHECKPOINT``-th id is kept, so a block is decoded at all checkpoints at once by table look-up.
Ranges hold ascending keys; within a range the blocks are numbered in ascending key order.

Codes come from counts over all documents (package-merge, at most ``LIMIT`` bits). Null and empty texts hold the end id
alone; null keys come first; rows with equal keys are ordered by text; an empty table gives an empty folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folionaut.llm.arrays import blocks
from folionaut.llm.encoding import binary_column, encoder, with_end
from folionaut.llm.session import partitions, staged
from folionaut.llm.workers import forgets

LIMIT = 20
BLOCK_IDS = 1 << 18
CHECKPOINT = 128

BLOCK_SCHEMA = "range int, block int, before long, keys array<long>, sizes array<long>, n_ids long, checkpoints binary, bits binary"


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits by package-merge; 0 for symbols that don't occur."""
    lengths = np.zeros(len(counts), dtype=np.uint8)
    used = np.flatnonzero(counts)
    n = len(used)
    if n <= 1:
        lengths[used] = 1
        return lengths
    if n > 1 << limit:
        raise ValueError(f"{n} symbols don't fit codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.int64)
    leaves, packages = [], np.empty(0, dtype=np.int64)
    for _ in range(limit):
        merged = np.concatenate([weights, packages])
        by_weight = np.argsort(merged, kind="stable")
        leaves.append(by_weight < n)
        merged = merged[by_weight]
        even = len(merged) // 2 * 2
        packages = merged[0:even:2] + merged[1:even:2]
    take, sums = 2 * n - 2, np.zeros(n, dtype=np.uint8)
    for is_leaf in reversed(leaves):
        chosen = int(is_leaf[:take].sum())
        sums[:chosen] += 1
        take = 2 * (take - chosen)
    lengths[order] = sums
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, symbol)."""
    codes = np.zeros(len(lengths), dtype=np.uint64)
    code = 0
    for length in range(1, int(lengths.max(initial=0)) + 1):
        code <<= 1
        symbols = np.flatnonzero(lengths == length)
        codes[symbols] = code + np.arange(len(symbols), dtype=np.uint64)
        code += len(symbols)
    return codes


def pack(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Bit offsets of every ``CHECKPOINT``-th id, and the bits."""
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    starts = ends - size
    total = int(ends[-1]) if len(ends) else 0
    words = np.zeros(total // 32 + 2, dtype=np.uint64)
    if len(ids):
        # A code lies in one or two words of 32 bits; codes of one word are adjacent, so their sum is their union.
        at = starts >> 5
        placed = codes[ids] << (64 - (starts & 31) - size).astype(np.uint64)
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        words[at[first]] += np.add.reduceat(placed >> np.uint64(32), first)
        words[at[first] + 1] += np.add.reduceat(placed & np.uint64(0xFFFFFFFF), first)
    return starts[::CHECKPOINT], words.astype(">u4").tobytes()[: (total + 7) // 8]


class Decoder:
    """One table from the next ``LIMIT`` bits to a symbol and its length."""

    def __init__(self, lengths: np.ndarray):
        self.width = max(1, int(lengths.max(initial=1)))
        symbols = np.flatnonzero(lengths)
        symbols = symbols[np.lexsort((symbols, lengths[symbols]))]
        fill = np.int64(1) << (self.width - lengths[symbols].astype(np.int64))
        self.symbol = np.zeros(1 << self.width, dtype=np.uint32)
        self.length = np.zeros(1 << self.width, dtype=np.uint8)
        used = int(fill.sum())
        self.symbol[:used] = np.repeat(symbols, fill)
        self.length[:used] = np.repeat(lengths[symbols], fill)

    def unpack(self, bits: bytes, checkpoints: np.ndarray, count: int) -> np.ndarray:
        """The ids of a block; every checkpoint's run is decoded in step with the others."""
        raw = np.frombuffer(bits + b"\0" * 8, dtype=np.uint8).astype(np.uint32)
        next32 = (raw[:-3] << np.uint32(24)) | (raw[1:-2] << np.uint32(16)) | (raw[2:-1] << np.uint32(8)) | raw[3:]
        out = np.empty((len(checkpoints), CHECKPOINT), dtype=np.uint32)
        at, last = checkpoints.astype(np.int64), len(next32) - 1
        mask = np.uint32((1 << self.width) - 1)
        for step in range(CHECKPOINT):
            # Past its last id the final run reads padding, which is cut off below.
            window = (next32[np.minimum(at >> 3, last)] >> (32 - self.width - (at & 7)).astype(np.uint32)) & mask
            out[:, step] = self.symbol[window]
            at = at + self.length[window]
        return out.reshape(-1)[:count]


@lru_cache(maxsize=2)
def _decoder(lengths: bytes) -> Decoder:
    return Decoder(np.frombuffer(lengths, dtype=np.uint8))


forgets(_decoder.cache_clear)


def encoded(docs: DataFrame, path: str, spaced: bool, end_id: int) -> DataFrame:
    """``docs`` (doc_id and more) with ``ids`` in place of ``text``: little-endian, of two bytes where a batch has no larger ids, else of four; and their number ``n``."""
    kept = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, spaced)
        for batch in batches:
            for first, after, data, offsets in blocks(batch.column("text")):
                ids, sizes = with_end(*encode.encode(data, offsets), end_id)
                ids = ids.astype("<u2" if ids.max() < 1 << 16 else "<u4")
                own = [batch.column(c).slice(first, after - first) for c in kept]
                yield pa.RecordBatch.from_arrays([*own, binary_column(ids, np.append(0, np.cumsum(sizes))), pa.array(sizes.astype(np.int64))], [*kept, "ids", "n"])

    types = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept]
    return docs.mapInArrow(run, ", ".join([*types, "ids binary", "n long"]))


def _ids(column: pa.Array, sizes: np.ndarray) -> np.ndarray:
    """Ids of all rows of ``encoded``, one row after the other."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)
    wide = np.diff(bounds) > 2 * sizes
    # Rows of one width stand together, in few runs.
    cuts = np.r_[0, np.flatnonzero(wide[1:] != wide[:-1]) + 1, len(wide)]
    return np.concatenate(
        [raw[bounds[a] : bounds[b]].view("<u4" if wide[a] else "<u2").astype(np.uint32) for a, b in zip(cuts[:-1], cuts[1:])]
    )


def id_counts(rows: DataFrame) -> DataFrame:
    """(id, n) over all rows of ``encoded``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(0, dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            seen = np.bincount(_ids(batch.column(0), batch.column(1).to_numpy()), minlength=len(totals))
            seen[: len(totals)] += totals
            totals = seen
        used = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(totals[used])], ["id", "n"])

    return rows.select("ids", "n").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_ids(docs: DataFrame, folder: str, path: str, spaced: bool = True, end_id: int = 2, vocabulary: int = 1 << 17) -> None:
    """Encode ``doc_id, text`` rows and write the format to ``folder``.

    Each text is encoded once; counts, order and blocks are made from its ids, which are kept in the shared folder. Only if
    keys are null or come again is the text kept too, as their order. ``vocabulary`` bounds the ids and so the counts that reach the driver.
    """
    spark = docs.sparkSession
    counts = np.zeros(vocabulary, dtype=np.int64)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    tied = not docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty()
    rows = staged(encoded(docs.withColumn("tie", F.col("text")) if tied else docs, path, spaced, end_id))
    for row in id_counts(rows).collect():
        counts[row["id"]] = row["n"]
    lengths = code_lengths(counts)
    known = [(int(s), int(lengths[s])) for s in np.flatnonzero(lengths)]
    spark.createDataFrame(known, "symbol int, length int").coalesce(1).write.parquet(f"{folder}/codebook")
    codes = canonical_codes(lengths)

    parts = partitions(spark)
    # Range bounds from the key column alone; sampling inside repartitionByRange would read all ids once more.
    bounds = rows.where("doc_id is not null").approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.2 / parts) if parts > 1 else []
    bounds = sorted({int(x) for x in bounds})
    number = F.coalesce(sum((F.col("doc_id") > b).cast("int") for b in bounds), F.lit(0)) if bounds else F.lit(0)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = {"range": None, "block": 0, "before": 0}
        held: list[tuple[list, np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            keys = [k for part in held for k in part[0]]
            sizes, ids = np.concatenate([p[1] for p in held]), np.concatenate([p[2] for p in held])
            held.clear()
            checkpoints, bits = pack(ids, lengths, codes)
            row = [state["range"], state["block"], state["before"], keys, sizes.tolist(), len(ids), checkpoints.astype("<i8").tobytes(), bits]
            yield pa.RecordBatch.from_pydict({n: [v] for n, v in zip(arrow.names, row)}, schema=arrow)
            state["block"] += 1
            state["before"] += len(ids)

        for batch in batches:
            if not batch.num_rows:
                continue
            numbers, keys, sizes = batch.column(0).to_numpy(), batch.column(1).to_pylist(), batch.column(3).to_numpy()
            ids, ends = _ids(batch.column(2), sizes), np.append(0, np.cumsum(sizes))
            row = 0
            while row < len(keys):
                if numbers[row] != state["range"]:
                    yield from flush()
                    state.update(range=int(numbers[row]), block=0, before=0)
                same = int(np.searchsorted(numbers, numbers[row], side="right"))
                room = BLOCK_IDS - sum(len(p[2]) for p in held)
                full = int(np.searchsorted(ends, ends[row] + room, side="right")) - 1
                stop = min(same, max(full, row + (not held)))
                if stop > row:
                    held.append((keys[row:stop], sizes[row:stop], ids[ends[row] : ends[stop]]))
                row = stop
                if row < len(keys) and numbers[row] == state["range"]:
                    yield from flush()
        yield from flush()

    order = ["tie"] if tied else []
    arrow = pa.schema(
        [("range", pa.int32()), ("block", pa.int32()), ("before", pa.int64()), ("keys", pa.list_(pa.int64())),
         ("sizes", pa.list_(pa.int64())), ("n_ids", pa.int64()), ("checkpoints", pa.binary()), ("bits", pa.binary())]
    )
    (
        rows.select(number.cast("int").alias("range"), "doc_id", "ids", "n", *order)
        .repartition(parts, "range").sortWithinPartitions("range", "doc_id", *order)
        .select("range", "doc_id", "ids", "n").mapInArrow(write, BLOCK_SCHEMA)
        .write.option("compression", "none").parquet(f"{folder}/blocks")
    )


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of all documents; ``start`` counts the ids of all documents before, ``ids`` are
    little-endian unsigned 32-bit."""
    book = spark.read.parquet(f"{folder}/codebook").collect()
    lengths = np.zeros(max((r["symbol"] for r in book), default=0) + 1, dtype=np.uint8)
    for row in book:
        lengths[row["symbol"]] = row["length"]
    table = lengths.tobytes()
    found = spark.read.parquet(f"{folder}/blocks")
    # One row per range: their number is a setting, not the data's size.
    totals = sorted((r["range"], r["n"]) for r in found.groupBy("range").agg(F.sum("n_ids").alias("n")).collect())
    before = dict(zip([r for r, _ in totals], np.cumsum([0] + [n for _, n in totals]).tolist()))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _decoder(table)
        for batch in batches:
            for row in batch.to_pylist():
                ids = decoder.unpack(row["bits"], np.frombuffer(row["checkpoints"], dtype="<i8"), row["n_ids"])
                sizes = np.array(row["sizes"], dtype=np.int64)
                ends = np.cumsum(sizes)
                start = before[row["range"]] + row["before"] + ends - sizes
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["keys"], pa.int64()), pa.array(start), pa.array(sizes), binary_column(ids.astype("<u4"), np.append(0, ends))],
                    ["doc_id", "start", "n_tokens", "ids"],
                )

    return found.select("range", "before", "keys", "sizes", "n_ids", "checkpoints", "bits").mapInArrow(
        decode, "doc_id long, start long, n_tokens long, ids binary"
    )

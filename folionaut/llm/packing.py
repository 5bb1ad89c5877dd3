"""Packing of token sequences by vector bin packing with the dot-product heuristic.

A sequence has room for so many tokens, segments (pieces of documents) and loss-bearing tokens at once. The next piece of
an open sequence is the one, of those that fit in all three, whose demand has the largest dot product with the room
left, both as shares of the limits. If none fits, the longest is cut to the room. A sequence that can't be filled is cut
back to a power of two, which needs no padding, and what was cut off starts again.

Each Spark partition packs its own documents in the order they come, with a bounded pool of waiting pieces; a lost task
gives the same pieces again. Every id lies in one piece. Null and empty texts are the end id alone; an empty table gives
no pieces; ``prompt_column`` names a column with the number of leading ids that bear no loss (null: 0).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folionaut.llm.arrays import blocks
from folionaut.llm.encoding import binary_column, encoder, with_end


@dataclass(frozen=True)
class Limits:
    tokens: int = 4096
    segments: int = 128
    loss: int = 4096


#: Sequences' worth of ids that wait for fitting partners before packing starts.
POOL = 64


class Packer:
    """The waiting pieces of one partition. Pieces are (document, start, length, ids that bear no loss)."""

    def __init__(self, limits: Limits = Limits()):
        self.limits = limits
        self.document = np.empty(0, dtype=np.int64)
        self.start, self.length, self.quiet = self.document.copy(), self.document.copy(), self.document.copy()
        self.sequences = 0

    def add(self, documents: np.ndarray, lengths: np.ndarray, prompts: np.ndarray) -> None:
        kept = self.length > 0
        join = lambda old, new: np.concatenate([old[kept], new])
        self.document, self.start = join(self.document, documents), join(self.start, np.zeros_like(lengths))
        self.length, self.quiet = join(self.length, lengths), join(self.quiet, np.clip(prompts, 0, lengths))

    def packed(self, everything: bool) -> Iterator[list[tuple[int, int, int]]]:
        """Sequences of (document, start, length), while the pool is full or, at the end, not empty."""
        waiting = int(self.length.sum())
        while waiting > 0 and (everything or waiting >= POOL * self.limits.tokens):
            sequence = self._fill()
            waiting -= sum(n for _, _, n in sequence)
            yield sequence

    def _take(self, i: int, n: int) -> tuple[int, int, int]:
        piece = int(self.document[i]), int(self.start[i]), n
        self.start[i] += n
        self.length[i] -= n
        self.quiet[i] = max(0, self.quiet[i] - n)
        return piece

    def _fill(self) -> list[tuple[int, int, int]]:
        top = self.limits
        room, segments, loss = top.tokens, top.segments, top.loss
        taken: list[tuple[int, int, int]] = []
        owners: list[int] = []
        bearing = self.length - self.quiet
        while room > 0 and segments > 0:
            fits = (self.length > 0) & (self.length <= room) & (bearing <= loss)
            score = self.length * (room / top.tokens**2) + bearing * (loss / top.loss**2) + segments / top.segments**2
            i = int(np.argmax(np.where(fits, score, -1.0)))
            if fits[i]:
                n = int(self.length[i])
            else:
                most = np.minimum(np.minimum(self.length, room), self.quiet + loss)
                i = int(np.argmax(np.where(most > 0, self.length, 0)))
                n = int(most[i])
                if n <= 0:
                    break
            quiet = min(n, int(self.quiet[i]))
            taken.append(self._take(i, n))
            owners.append(i)
            bearing[i] = self.length[i] - self.quiet[i]
            room, segments, loss = room - n, segments - 1, loss - (n - quiet)
        size = top.tokens - room
        surplus = size - (1 << (size.bit_length() - 1)) if room else 0
        while surplus > 0:
            document, start, n = taken.pop()
            back = min(n, surplus)
            self._return(owners.pop(), back)
            surplus -= back
            if n > back:
                taken.append((document, start, n - back))
        return taken

    def _return(self, i: int, n: int) -> None:
        """Give back the last ``n`` ids taken from piece ``i``; ids that bear no loss lead a piece, so these count as bearing."""
        self.start[i] -= n
        self.length[i] += n


def pack(docs: DataFrame, path: str, spaced: bool, end_id: int, limits: Limits = Limits(), prompt_column: str | None = None) -> DataFrame:
    """``doc_id, start, length, doc_tokens, sequence_id, offset, ids`` of every piece; ``ids`` are little-endian unsigned 32-bit."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    prompt = F.coalesce(F.col(prompt_column).cast("long"), F.lit(0)) if prompt_column else F.lit(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(path, spaced), Packer(limits)
        base = TaskContext.get().partitionId() << 36
        held: dict[int, tuple] = {}  # of documents with waiting ids: key, ids
        known = 0

        def rows(everything: bool) -> Iterator[pa.RecordBatch]:
            key, start, length, total, sequence, offset, parts = [], [], [], [], [], [], []
            for pieces in packer.packed(everything):
                at = 0
                for document, begin, n in pieces:
                    name, ids = held[document]
                    key.append(name)
                    start.append(begin)
                    length.append(n)
                    total.append(len(ids))
                    sequence.append(base + packer.sequences)
                    offset.append(at)
                    parts.append(ids[begin : begin + n])
                    at += n
                packer.sequences += 1
            for document in set(held) - set(packer.document[packer.length > 0].tolist()):
                del held[document]
            for lot in range(0, len(key), 2000):
                some = slice(lot, lot + 2000)
                bounds = np.append(0, np.cumsum(length[some]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[some], keys), *(pa.array(x[some], pa.int64()) for x in (start, length, total, sequence, offset)),
                     binary_column(np.concatenate(parts[some]).astype("<u4"), bounds)],
                    ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
                )

        keys = pa.int64()
        for batch in batches:
            keys = batch.column(0).type
            for first, after, data, offsets in blocks(batch.column(1)):
                ids, sizes = with_end(*encode.encode(data, offsets), end_id)
                ends = np.cumsum(sizes)
                names = batch.column(0).slice(first, after - first).to_pylist()
                # A copy per document, so that one waiting piece doesn't hold a whole block.
                held.update((known + i, (name, ids[e - n : e].copy())) for i, (name, e, n) in enumerate(zip(names, ends, sizes)))
                packer.add(known + np.arange(len(sizes)), sizes, batch.column(2).to_numpy()[first:after])
                known += len(sizes)
                yield from rows(False)
        yield from rows(True)

    return docs.select("doc_id", "text", prompt.alias("quiet")).mapInArrow(
        run, f"doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    )

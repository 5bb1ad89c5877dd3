"""Spans of documents that repeat benchmark items, found with a generalised suffix automaton of the items' words.

Words are runs of letters, digits and characters outside ASCII after A-Z became a-z. A window is ``window`` consecutive
words of an item; an item of fewer words, but not none, is one window. Documents stream through the automaton, which
knows at each word the longest suffix that occurs in an item; where it reaches a window, the window's words are hit.
Runs of words whose neighbouring pairs all occur in items are found with arrays first; only those runs are streamed.

Items are read in blocks of bounded size, one automaton and one pass over the documents each, so the broadcast is
bounded for any number of items. Null and empty texts have no words; null items are ignored; items with equal texts are
all reported; an empty item table hits nothing; repeated rows are each judged; other columns pass as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folionaut.llm.arrays import blocks, codes, spans, text_buffers

WINDOW = 10
#: Item text of one automaton; about 100 times this in a worker's memory.
ITEM_BYTES = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_GAP = np.ones(256, dtype=bool)
_GAP[ord("0") : ord("9") + 1] = _GAP[ord("a") : ord("z") + 1] = _GAP[128:] = False


def item_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes, starts and ends of all words of a block, and per row the index of its first word (one more at the end)."""
    low = _LOWER[data]
    starts, ends = spans(_GAP[low], offsets)
    return codes(low, starts, ends), starts, ends, np.searchsorted(starts, offsets)


class Automaton:
    """Suffix automaton of several word sequences, with the items of every window."""

    def __init__(self, names: list[str], texts: list[str], window: int = WINDOW):
        self.window = window
        word, _, _, first = item_words(*_rows(texts))
        self.vocabulary = np.unique(word)
        ids = np.searchsorted(self.vocabulary, word)
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        sequences = [(n, ids[first[i] : first[i + 1]].tolist()) for i, n in enumerate(names) if first[i + 1] > first[i]]
        pairs = [ids[first[i] : first[i + 1]] for i in range(len(names))]
        self.pairs = np.unique(np.concatenate([p[:-1] * len(self.vocabulary) + p[1:] for p in pairs])) if pairs else np.empty(0, np.int64)
        self.shortest = min([window, *(len(s) for _, s in sequences)])
        for _, sequence in sequences:
            self._add(sequence)
        self.items: dict[int, set[str]] = {}  # of the state of each full window
        self.short: dict[int, list[tuple[int, str]]] = {}  # items that are one short window: length and name
        for name, sequence in sequences:
            if len(sequence) < window:
                state = 0
                for w in sequence:
                    state = self.next[state][w]
                self.short.setdefault(state, []).append((len(sequence), name))
                continue
            for _, state, length in self._stream(sequence):
                if length >= window:
                    self.items.setdefault(self._of_window(state), set()).add(name)

    def _state(self, size: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.size.append(size)
        return len(self.size) - 1

    def _split(self, at: int, symbol: int, target: int) -> int:
        """A copy of ``target`` for the sequences that reach it from ``at`` by their last ``size[at] + 1`` symbols."""
        copy = self._state(self.size[at] + 1)
        self.next[copy] = dict(self.next[target])
        self.link[copy] = self.link[target]
        self.link[target] = copy
        while at != -1 and self.next[at].get(symbol) == target:
            self.next[at][symbol] = copy
            at = self.link[at]
        return copy

    def _add(self, sequence: list[int]) -> None:
        last = 0
        for symbol in sequence:
            known = self.next[last].get(symbol)
            if known is not None:
                last = known if self.size[known] == self.size[last] + 1 else self._split(last, symbol, known)
                continue
            new, at = self._state(self.size[last] + 1), last
            while at != -1 and symbol not in self.next[at]:
                self.next[at][symbol] = new
                at = self.link[at]
            if at != -1:
                target = self.next[at][symbol]
                self.link[new] = target if self.size[target] == self.size[at] + 1 else self._split(at, symbol, target)
            last = new

    def _stream(self, sequence: list[int]) -> Iterator[tuple[int, int, int]]:
        """Position, state and longest matching length after each word."""
        state = length = 0
        for i, symbol in enumerate(sequence):
            while state and symbol not in self.next[state]:
                state = self.link[state]
                length = self.size[state]
            if symbol in self.next[state]:
                state, length = self.next[state][symbol], length + 1
            yield i, state, length

    def _of_window(self, state: int) -> int:
        while self.size[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def hits(self, sequence: list[int]) -> tuple[list[list[int]], set[str]]:
        """Merged ranges of hit words (end exclusive) and the items whose windows occur."""
        found: list[tuple[int, int]] = []
        names: set[str] = set()
        for i, state, length in self._stream(sequence):
            if length >= self.window:
                found.append((i + 1 - self.window, i + 1))
                names |= self.items.get(self._of_window(state), set())
            at = state if self.short else 0
            while at > 0:
                for size, name in self.short.get(at, ()):
                    if size <= length:
                        found.append((i + 1 - size, i + 1))
                        names.add(name)
                at = self.link[at]
        merged: list[list[int]] = []
        for start, end in sorted(found):
            if merged and start <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], end)
            else:
                merged.append([start, end])
        return merged, names

    def scan(self, word: np.ndarray, first: np.ndarray) -> dict[int, tuple[list[list[int]], set[str]]]:
        """For each row with hits: ranges of its words, and items."""
        if not len(self.vocabulary) or not len(word):
            return {}
        ids = np.minimum(np.searchsorted(self.vocabulary, word), len(self.vocabulary) - 1)
        known = self.vocabulary[ids] == word
        pair = ids[:-1] * len(self.vocabulary) + ids[1:]
        joined = known[:-1] & known[1:]
        if len(self.pairs):
            joined &= self.pairs[np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)] == pair
        else:
            joined[:] = False
        joined[first[(first > 0) & (first < len(word))] - 1] = False
        begin = np.flatnonzero(known & ~np.r_[False, joined])
        end = np.flatnonzero(known & ~np.r_[joined, False]) + 1
        long = end - begin >= self.shortest
        begin, end = begin[long], end[long]
        out: dict[int, tuple[list[list[int]], set[str]]] = {}
        for row, b, e in zip((np.searchsorted(first, begin, side="right") - 1).tolist(), begin.tolist(), end.tolist()):
            merged, names = self.hits(ids[b:e].tolist())
            if merged:
                own = out.setdefault(row, ([], set()))
                own[0].extend([b - int(first[row]) + x, b - int(first[row]) + y] for x, y in merged)
                own[1].update(names)
        return out


def _rows(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = text_buffers(pa.array(texts, pa.string()))
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def automata(items: DataFrame, window: int = WINDOW, item_bytes: int = ITEM_BYTES) -> list[Automaton]:
    """Automata of ``item_id, text`` rows, each of about ``item_bytes`` of text."""
    usable = items.where("text is not null").select(F.col("item_id").cast("string").alias("name"), "text")
    total = usable.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, ceil(total / item_bytes))
    out = []
    for part in range(parts):
        rows = usable.where(F.pmod(F.hash("name"), F.lit(parts)) == part).collect()
        out.append(Automaton([str(r["name"]) for r in rows], [r["text"] for r in rows], window))
    return out


def with_hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """All columns of ``docs`` with ``_n_words``, ``_n_hit``, ``_items`` (sorted names) and ``_hit_ranges`` (of words, flat
    pairs, end exclusive); columns of ``docs`` with these names are replaced."""
    spark = docs.sparkSession
    out = docs.withColumns({
        "_n_words": F.lit(0).cast("long"), "_items": F.array().cast("array<string>"), "_hit_ranges": F.array().cast("array<long>"),
    })
    names, at = out.columns, out.columns.index("text")
    for automaton in automata(items, window, item_bytes):
        out = out.mapInArrow(_pass(spark.sparkContext.broadcast(automaton), names, at), out.schema)
    # Ranges are flat pairs, so ends less starts are the odd less the even entries.
    signed = F.transform("_hit_ranges", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x))
    return out.withColumn("_n_hit", F.aggregate(signed, F.lit(0).cast("long"), lambda total, x: total + x))


def _pass(shared, names: list[str], at: int):
    """One automaton over Arrow batches; adds to what earlier ones found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value
        for batch in batches:
            count, found = [], {}
            for first_row, _, data, offsets in blocks(batch.column(at)):
                word, _, _, first = item_words(data, offsets)
                count.append(np.diff(first))
                found.update({first_row + r: v for r, v in automaton.scan(word, first).items()})
            columns = {n: batch.column(i) for i, n in enumerate(names)}
            if found:
                ranges, items = columns["_hit_ranges"].to_pylist(), columns["_items"].to_pylist()
                for row, (new, more) in found.items():
                    ranges[row] = _union(ranges[row], new)
                    items[row] = sorted({*items[row], *more})
                columns["_hit_ranges"] = pa.array(ranges, columns["_hit_ranges"].type)
                columns["_items"] = pa.array(items, columns["_items"].type)
            columns["_n_words"] = pa.array(np.concatenate([*count, np.empty(0, dtype=np.int64)]), pa.int64())
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names)

    return run


def _union(flat: list[int], more: list[list[int]]) -> list[int]:
    """Flat pairs of the merged ranges."""
    out: list[int] = []
    for start, end in sorted([*zip(flat[::2], flat[1::2]), *map(tuple, more)]):
        if out and start <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [start, end]
    return out


def _cutter(at: int):
    """Texts without their hit words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranges, texts = batch.column(batch.schema.get_field_index("_hit_ranges")).to_pylist(), batch.column(at).to_pylist()
            for row, flat in enumerate(ranges):
                if flat:
                    data, offsets = _rows([texts[row]])
                    _, starts, ends, _ = item_words(data, offsets)
                    raw, kept, last = data.tobytes(), [], 0
                    for a, b in zip(flat[::2], flat[1::2]):
                        kept.append(raw[last : starts[a]])
                        last = ends[b - 1]
                    texts[row] = b"".join([*kept, raw[last:]]).decode("utf-8", "replace")
            columns = [batch.column(i) for i in range(batch.num_columns)]
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return run


def decontaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_share: float = 0.5) -> DataFrame:
    """``docs`` without hit words; documents whose share of hit words exceeds ``max_share`` are left out."""
    carried = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "text")
    hit = with_hits(carried, items, window).where(F.col("_n_hit") <= F.lit(max_share) * F.col("_n_words"))
    cut = hit.select("row", "text", "_hit_ranges")
    rest = cut.mapInArrow(_cutter(cut.columns.index("text")), cut.schema)
    return rest.select(F.col("row").withField("text", F.col("text")).alias("row")).select("row.*")

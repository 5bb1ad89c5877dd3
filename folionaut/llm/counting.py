"""Exact token counts from compiled finite-state transducers.

Two deterministic machines stand for a byte-level BPE vocabulary.

``Boundaries`` cuts text into the pieces the vocabulary's pattern finds. Its input is the class of a character with the
little look-ahead the pattern needs; a transition says whether a piece starts. A block of text is split into chunks; each
chunk becomes a map from entry state to exit state, the maps are composed by a parallel prefix scan, and the chunks are
then run from their now known states, all in step.

``Merges`` counts the ids of a piece. Its state after a prefix is what later bytes can still change: the longest suffix
that starts some token, and for each place in it where such a token may begin, the last token there and the count there
relative to the count so far. Its transitions carry the change of the count (negative when tokens merge). It rests on the
fact that a sequence of tokens is the encoding of its bytes if and only if each neighbouring pair is. States are compiled
when first met and kept per worker.

Null and empty texts have no tokens; special strings count one each, as the library does by default; repeated rows are
each counted; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from folionaut.llm.arrays import blocks, codes
from folionaut.llm.workers import forgets

#: States and remembered pieces per worker before its memory starts anew; the longest piece that is remembered.
MAX_STATES = 200_000
MAX_PIECES = 1_000_000
KEPT_BYTES = 64
CHUNK = 256

# Input symbols of the boundary machine.
LETTER, NUMBER, OTHER, SHORT, LONG, JOINED, LONE, INNER, PAD = range(9)
FRESH = 16  # added for the first character of a text: the machine starts anew

# Its states: after a finished piece, in a run of letters, numbers or others, after a space that joins what follows, in
# white space, and in a contraction with so many characters to go.
END, LETTERS, NUMBERS, OTHERS, SPACE, BLANK, LEFT1, LEFT2 = range(8)
STATES = 8


def _boundary_tables() -> tuple[np.ndarray, np.ndarray]:
    """Next state, and whether a piece starts, by state and symbol."""
    after = np.zeros((STATES, 2 * FRESH), dtype=np.uint8)
    starts = np.zeros((STATES, 2 * FRESH), dtype=bool)
    runs = {LETTER: LETTERS, NUMBER: NUMBERS, OTHER: OTHERS, SHORT: OTHERS, LONG: OTHERS}
    for state in range(STATES):
        for symbol in range(PAD):
            if state in (LEFT1, LEFT2):
                to, new = (END if state == LEFT1 else LEFT1), False
            elif symbol in runs and (state == SPACE or state == runs[symbol]):
                to, new = runs[symbol], False
            elif symbol in (SHORT, LONG):
                to, new = (LEFT1 if symbol == SHORT else LEFT2), True
            elif symbol in runs:
                to, new = runs[symbol], True
            elif symbol == JOINED:
                to, new = SPACE, True
            elif symbol == LONE:
                to, new = END, True
            else:
                to, new = BLANK, state != BLANK
            after[state, symbol], starts[state, symbol] = to, new
        after[state, PAD] = state
    after[:, FRESH:] = after[END, :FRESH]
    starts[:, FRESH:] = starts[END, :FRESH]
    return after, starts


_AFTER, _STARTS = _boundary_tables()


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """Letter, number, other, or 9 for white space and 10 for the space itself, by code point."""
    kinds = np.full(0x110000, OTHER, dtype=np.uint8)
    for point in range(0x110000):
        category = unicodedata.category(chr(point))[0]
        if category == "L":
            kinds[point] = LETTER
        elif category == "N":
            kinds[point] = NUMBER
    kinds[[*range(0x09, 0x0E), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = 9
    kinds[0x20] = 10
    return kinds


def symbols(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Input symbols of texts given as code points; ``first`` are the places where a text starts (none is empty)."""
    kind = _kinds()[points]
    last = np.zeros(len(points), dtype=bool)
    last[first[1:] - 1] = True
    last[-1:] = True
    ahead = np.append(kind[1:], 0)
    blank = kind >= 9
    out = np.where(blank, INNER, kind).astype(np.uint8)
    solid_next = blank & ~last & (ahead < 9)
    out[solid_next] = np.where(kind[solid_next] == 10, JOINED, LONE)
    for at in np.flatnonzero(points == ord("'")).tolist():
        if last[at]:
            continue
        one = points[at + 1]
        if one in _ONE:
            out[at] = SHORT
        elif not last[at + 1] and (int(one), int(points[at + 2])) in _TWO:
            out[at] = LONG
    out[first] += FRESH
    return out


_ONE = {ord(c) for c in "stmd"}
_TWO = {(ord(a), ord(b)) for a, b in ("re", "ve", "ll")}


def piece_starts(inputs: np.ndarray) -> np.ndarray:
    """Places where pieces start, by state maps of chunks and their prefix scan."""
    lanes = max(1, -(-len(inputs) // CHUNK))
    grid = np.full(lanes * CHUNK, PAD, dtype=np.uint8)
    grid[: len(inputs)] = inputs
    grid = np.ascontiguousarray(grid.reshape(lanes, CHUNK).T)
    maps = np.tile(np.arange(STATES, dtype=np.uint8), (lanes, 1))
    for step in grid:
        maps = _AFTER[maps, step[:, None]]
    reach = 1
    while reach < lanes:  # composition is associative: after each round a map spans twice as many chunks
        maps[reach:] = np.take_along_axis(maps[reach:], maps[:-reach].astype(np.int64), axis=1)
        reach *= 2
    state = np.concatenate([[END], maps[:-1, END]]).astype(np.uint8)
    found = np.empty((CHUNK, lanes), dtype=bool)
    for i, step in enumerate(grid):
        found[i] = _STARTS[state, step]
        state = _AFTER[state, step]
    return np.flatnonzero(found.T.ravel()[: len(inputs)])


def _byte_letters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in plain}
    for i, b in enumerate(b for b in range(256) if b not in set(plain)):
        table[chr(256 + i)] = b
    return table


class Merges:
    """The counting machine of one vocabulary."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        letters = _byte_letters()
        as_bytes = lambda token: bytes(letters[c] for c in token)
        self.specials = [t["content"] for t in model["added_tokens"] if t["special"]]
        self.rank: dict[tuple[bytes, bytes], int] = {}
        self.tokens = {bytes([b]) for b in range(256)}
        for i, merge in enumerate(model["model"]["merges"]):
            left, right = map(as_bytes, merge.split(" ") if isinstance(merge, str) else merge)
            self.rank[left, right] = i
            self.tokens.add(left + right)
        self.begun = {t[:n] for t in self.tokens for n in range(1, len(t))} | {b""}
        self.valid: dict[tuple[bytes, bytes], bool] = {}
        self.remembered: dict[int, int] = {}
        self._forget()

    def _forget(self) -> None:
        self.valid.clear()
        start = (b"", ((None, 0),))
        self.states, self.number, self.edges = [start], {start: 0}, [{}]

    def encoded(self, text: bytes) -> list[bytes]:
        """Merge by rank, leftmost first."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            best, at = min((self.rank.get((a, b), 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _fits(self, left: bytes, right: bytes) -> bool:
        """Whether the two tokens stay apart next to each other."""
        known = self.valid.get((left, right))
        if known is None:
            known = self.valid[left, right] = self.encoded(left + right) == [left, right]
        return known

    def _compile(self, state: int, byte: int) -> tuple[int, int]:
        """Next state and change of the count."""
        window, places = self.states[state]
        window += bytes([byte])
        # places[i] belongs to the place before window[i]: last token and relative count, or None if no token starts there.
        for i in range(len(window)):
            token, place = window[i:], places[i]
            if place is not None and token in self.tokens and (place[0] is None or self._fits(place[0], token)):
                break
        change = place[1] + 1
        skip = next(i for i in range(len(window) + 1) if window[i:] in self.begun)
        kept = [
            (p[0], p[1] - change) if p is not None and window[i:] in self.begun else None for i, p in enumerate(places) if i >= skip
        ]
        new = (window[skip:], (*kept, (token, 0)))
        number = self.number.get(new)
        if number is None:
            number = self.number[new] = len(self.states)
            self.states.append(new)
            self.edges.append({})
        self.edges[state][byte] = number, change
        return number, change

    def count(self, piece: bytes) -> int:
        """The number of ids of a piece."""
        state = total = 0
        edges = self.edges
        for byte in piece:
            step = edges[state].get(byte) or self._compile(state, byte)
            state = step[0]
            total += step[1]
        return total

    def counts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of ids of each piece; equal pieces are run once."""
        if len(self.states) > MAX_STATES:
            self._forget()
        if len(self.remembered) > MAX_PIECES:
            self.remembered.clear()
        unique, first, inverse = np.unique(codes(data, starts, ends), return_index=True, return_inverse=True)
        raw, found, get = data.tobytes(), [], self.remembered.get
        for code, s, e in zip(unique.tolist(), starts[first].tolist(), ends[first].tolist()):
            n = get(code)
            if n is None:
                n = self.count(raw[s:e])
                if e - s <= KEPT_BYTES:
                    self.remembered[code] = n
            found.append(n)
        return np.array(found, dtype=np.int64)[inverse]

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The number of ids of each text of a block."""
        rows = len(offsets) - 1
        totals = np.zeros(rows, dtype=np.int64)
        raw = data.tobytes()
        # Texts are cut at special strings; what stands between is a text of its own.
        cuts, held = [offsets], np.zeros(len(data), dtype=bool)
        for special in self.specials:
            needle, at = special.encode(), raw.find(special.encode())
            while at >= 0:
                row = int(np.searchsorted(offsets, at, side="right")) - 1
                if at + len(needle) <= offsets[row + 1] and not held[at : at + len(needle)].any():
                    totals[row] += 1
                    held[at : at + len(needle)] = True
                    cuts.append(np.array([at, at + len(needle)]))
                    at = raw.find(needle, at + len(needle))
                else:
                    at = raw.find(needle, at + 1)
        begin = np.unique(np.concatenate(cuts))
        begin = begin[begin < len(data)]
        if not len(begin):
            return totals
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        points = np.frombuffer(raw.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        starts = lead[piece_starts(symbols(points, np.searchsorted(lead, begin)))]
        ends = np.append(starts[1:], len(data))
        plain = ~held[starts]
        if not plain.all():
            ends = np.minimum(ends, np.append(begin, len(data))[np.searchsorted(begin, starts, side="right")])
            starts, ends = starts[plain], ends[plain]
        number = self.counts(data, starts, ends)
        row = np.searchsorted(offsets, starts, side="right") - 1
        return totals + np.bincount(row, weights=number, minlength=rows).astype(np.int64)


@lru_cache(maxsize=2)
def machine(path: str) -> Merges:
    """The worker's machine of a vocabulary file."""
    return Merges(path)


forgets(machine.cache_clear)


def token_counts(docs: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, n_tokens) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = machine(path)
        for batch in batches:
            for first, after, data, offsets in blocks(batch.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, after - first), pa.array(np.diff(offsets)), pa.array(counter.texts(data, offsets))],
                    [key, "n_bytes", "n_tokens"],
                )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, "text").mapInArrow(run, f"`{key}` {kind}, n_bytes long, n_tokens long")

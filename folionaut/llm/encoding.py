"""Exact token ids of whole texts from the tokenizers library, with each distinct unit of text encoded once per worker.

Both public vocabularies cut a text wherever white space follows other text, whatever stands around, so the ids of a
text are the ids of its units one after the other. A unit is a run of white space with the text that follows it
(``byte_bpe_50k.json``) or that text alone (``word_bpe_49k.json``, which drops white space). Texts with white space
outside ASCII are one unit each. Units are told apart by 64-bit codes.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa

from folionaut.llm.arrays import SPACE, codes, ranges, spans
from folionaut.llm.workers import forgets

#: Units kept per worker before its memory starts anew (about 40 bytes each), and the longest unit that is kept.
KEPT_UNITS = 3_000_000
KEPT_BYTES = 64

_WIDE_LEAD = np.zeros(256, dtype=bool)
_WIDE_LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def wide_space(data: np.ndarray) -> np.ndarray:
    """Byte positions of white space outside ASCII (U+0085, U+00A0, U+1680, U+2000-200A, 2028, 2029, 202F, 205F, 3000)."""
    at = np.flatnonzero(_WIDE_LEAD[data])
    if not len(at):
        return at
    padded = np.concatenate([data, np.zeros(2, dtype=np.uint8)])
    lead, second, third = padded[at], padded[at + 1], padded[at + 2]
    general = (second == 0x80) & (((third >= 0x80) & (third <= 0x8A)) | np.isin(third, [0xA8, 0xA9, 0xAF]))
    found = (
        ((lead == 0xC2) & ((second == 0x85) | (second == 0xA0)))
        | ((lead == 0xE1) & (second == 0x9A) & (third == 0x80))
        | ((lead == 0xE2) & (general | ((second == 0x81) & (third == 0x9F))))
        | ((lead == 0xE3) & (second == 0x80) & (third == 0x80))
    )
    return at[found]


class Encoder:
    """Ids of blocks of texts. ``spaced`` keeps white space with the text after it."""

    def __init__(self, path: str, spaced: bool):
        # One thread each: Spark runs one worker per core.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.spaced = spaced
        self._forget()

    def _forget(self) -> None:
        # Sorted codes and the slot of each: a tenth of a dictionary's size, and looked up for a whole block at once.
        self.codes, self.slots = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int32)
        self.flat = np.empty(1 << 16, dtype=np.uint32)
        self.begin = np.empty(1 << 16, dtype=np.int64)
        self.count = np.empty(1 << 16, dtype=np.int64)
        self.used = self.units = 0

    def _add(self, encoded: list[list[int]]) -> int:
        """Append the ids of units; gives the first one's slot."""
        first, sizes = self.units, np.fromiter(map(len, encoded), dtype=np.int64, count=len(encoded))
        total = int(sizes.sum())
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while first + len(encoded) > len(self.begin):
            self.begin = np.concatenate([self.begin, np.empty_like(self.begin)])
            self.count = np.concatenate([self.count, np.empty_like(self.count)])
        self.flat[self.used : self.used + total] = np.fromiter((i for ids in encoded for i in ids), dtype=np.uint32, count=total)
        self.begin[first : first + len(encoded)] = self.used + np.cumsum(sizes) - sizes
        self.count[first : first + len(encoded)] = sizes
        self.used += total
        self.units += len(encoded)
        return first

    def units_of(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the units of a block."""
        gap = SPACE[data]
        wide = wide_space(data)
        if not self.spaced:
            starts, ends = spans(gap, offsets)
            whole = np.unique(np.searchsorted(offsets, wide, side="right") - 1) if len(wide) else wide
            if len(whole):
                row = np.searchsorted(offsets, starts, side="right") - 1
                keep = ~np.isin(row, whole)
                starts = np.sort(np.concatenate([starts[keep], offsets[whole]]))
                ends = np.sort(np.concatenate([ends[keep], offsets[whole + 1]]))
            return starts, ends
        cut = gap.copy()
        cut[1:] &= ~gap[:-1]
        for row in np.unique(np.searchsorted(offsets, wide, side="right") - 1) if len(wide) else ():
            cut[offsets[row] : offsets[row + 1]] = False
        inner = offsets[:-1][offsets[:-1] < offsets[1:]]
        cut[inner] = True
        starts = np.flatnonzero(cut)
        return starts, np.append(starts[1:], len(data))

    def _slots(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots of the distinct units of a block, and for each unit its place among them."""
        if self.units > KEPT_UNITS:
            self._forget()
        unique, first, inverse = np.unique(codes(data, starts, ends), return_index=True, return_inverse=True)
        at = np.searchsorted(self.codes, unique)
        known = np.zeros(len(unique), dtype=bool)
        inside = at < len(self.codes)
        known[inside] = self.codes[at[inside]] == unique[inside]
        slots = np.empty(len(unique), dtype=np.int64)
        slots[known] = self.slots[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            raw = data.tobytes()
            begin, end = starts[first[new]], ends[first[new]]
            texts = [raw[s:e].decode("utf-8", "replace") for s, e in zip(begin.tolist(), end.tolist())]
            encoded = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            slots[new] = self._add(encoded) + np.arange(len(new))
            short = new[end - begin <= KEPT_BYTES]
            self.codes = np.insert(self.codes, at[short], unique[short])
            self.slots = np.insert(self.slots, at[short], slots[short].astype(np.int32))
        return slots, inverse

    def counts(self, data: np.ndarray, offsets: np.ndarray, minimum: int) -> np.ndarray:
        """How often each id occurs in a block, at least ``minimum`` entries."""
        slots, inverse = self._slots(data, *self.units_of(data, offsets))
        weight = np.bincount(inverse, minlength=len(slots))
        sizes = self.count[slots]
        ids = self.flat[ranges(self.begin[slots], sizes)]
        return np.bincount(ids, weights=np.repeat(weight, sizes), minlength=minimum).astype(np.int64)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of a block one after the other, and each row's number of ids."""
        starts, ends = self.units_of(data, offsets)
        slots, inverse = self._slots(data, starts, ends)
        slots, row_first = slots[inverse], np.searchsorted(starts, offsets)
        sizes = self.count[slots]
        ids = self.flat[ranges(self.begin[slots], sizes)]
        totals = np.concatenate([[0], np.cumsum(sizes)])
        return ids, np.diff(totals[row_first])


@lru_cache(maxsize=4)
def encoder(path: str, spaced: bool) -> Encoder:
    """The worker's encoder of a vocabulary file; workers are reused, so its memory serves many tasks."""
    return Encoder(path, spaced)


forgets(encoder.cache_clear)


def with_end(ids: np.ndarray, sizes: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Append ``end_id`` to each row's ids."""
    bounds = np.cumsum(sizes)
    return np.insert(ids, bounds, np.uint32(end_id)), sizes + 1


def binary_column(buffer: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Arrow binary values from a buffer of items and item offsets."""
    width = buffer.dtype.itemsize
    offsets = pa.py_buffer((np.asarray(bounds, dtype=np.int64) * width).tobytes())
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, offsets, pa.py_buffer(buffer.tobytes())]).cast(pa.binary())

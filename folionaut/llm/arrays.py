"""Words of Arrow text columns as numpy arrays: bounds, owners and 64-bit codes, block by block in bounded memory."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from folionaut.llm.workers import forgets

#: Text bytes handled at once; one longer document makes a block of its own.
BLOCK_BYTES = (2 << 20) - 64
#: The same for operators of many temporary arrays.
SMALL_BLOCK_BYTES = (1 << 18) - 64

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)

#: The white space of ``[\x20\x09-\x0D]``.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


@lru_cache(maxsize=2)
def _power_table(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, by doubling."""
    tables = []
    for base in (_BASE, _INVERSE):
        table = np.ones(size, dtype=np.uint64)
        known = 1
        while known < size:
            step = np.uint64(pow(base, known, 1 << 64))
            more = min(known, size - known)
            table[known : known + more] = table[:more] * step
            known += more
        tables.append(table)
    return tables[0], tables[1]


forgets(_power_table.cache_clear)


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Power tables of at least ``size`` entries."""
    return _power_table(max(1 << 16, 1 << int(size).bit_length()))


def mix(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit codes so that every bit depends on all bits; distinct codes stay distinct."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values = values ^ (values >> np.uint64(27))
    values = values * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit code of each byte span: a polynomial over the bytes and the length, mixed. Equal bytes, equal codes."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    raw = (sums[ends] - sums[starts]) * down[starts]
    return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def windows(values: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """Code of every run of ``width`` consecutive values (``len(values) - width + 1`` of them)."""
    count = len(values) - width + 1
    if count <= 0:
        return np.empty(0, dtype=np.uint64)
    base = (_BASE + 2 * salt) & ((1 << 64) - 1)
    out = np.zeros(count, dtype=np.uint64)
    for offset in range(width):
        out = out * np.uint64(base) + values[offset : offset + count]
    return mix(out)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a text column; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    return raw, bounds


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of at most ``limit`` bytes: first row, row after the last, bytes, offsets from 0."""
    if not len(column):
        return
    raw, bounds = text_buffers(column)
    first = 0
    while first < len(column):
        after = int(np.searchsorted(bounds, bounds[first] + limit, side="right")) - 1
        after = min(max(after, first + 1), len(column))
        yield first, after, raw[bounds[first] : bounds[after]], bounds[first : after + 1] - bounds[first]
        first = after


def spans(gap: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes outside ``gap``, never across two rows."""
    size = len(gap)
    before = np.ones(size + 1, dtype=bool)
    before[1:] = gap
    before[offsets] = True
    after = np.ones(size + 1, dtype=bool)
    after[:size] = gap
    after[offsets] = True
    solid = ~gap
    return np.flatnonzero(solid & before[:size]), np.flatnonzero(solid & after[1:]) + 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """White-space separated words: starts, ends, and per row the index of its first word (one more entry at the end)."""
    starts, ends = spans(SPACE[data], offsets)
    return starts, ends, np.searchsorted(starts, offsets)


def ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All indices ``first[i] .. first[i] + count[i] - 1``, one range after the other."""
    total = int(count.sum())
    if not total:
        return np.empty(0, dtype=np.int64)
    ends = np.cumsum(count)
    return np.repeat(first - (ends - count), count) + np.arange(total)

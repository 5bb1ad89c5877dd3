"""Periodic runs of words: stretches that repeat a short passage again and again, found exactly.

A run is a stretch of consecutive words whose smallest period is ``q``, of at least ``LEAST`` words and ``REPEATS``
periods, that no neighbouring word extends.

1. *Recursive frequency splitting.* Each word of a qualifying run stands in it at least ``REPEATS`` times. A word that
   occurs less often within the current segment therefore joins no run and splits the segment; pieces shorter than
   ``LEAST`` go. What is left is counted anew, until nothing splits. All segments of a block of texts take each step together.
2. *Lag scan* of the surviving segments. Comparing a segment with itself at every lag would take the square of its length.
   Periods of ``[s, 2s)`` for ``s = 1, 2, 4, ...`` are found together instead: within such a run, a window of ``2s`` words
   comes again next at exactly the smallest period, as two periods of a string that long would have a common divisor as
   period. So each position has one lag per scale, that of the window's next occurrence, and a stretch of positions with
   one lag is a run. Windows get exact numbers by doubling, (window, window after it); positions whose window does not
   come again leave the search. That takes ``n log n`` steps per scale, whatever the texts hold.

Words are ``[^\\x20\\x09-\\x0D]+`` and told apart by 64-bit codes. Null, empty and blank texts have no words and no runs.
Each row is judged for itself: repeated rows and missing ids give rows of their own. A text longer than a block is a block
of its own: memory grows with one text, not with the table. An empty table gives an empty result. Other columns than the
id and the text are not read, so their names don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folionaut.llm.arrays import blocks, codes, ranges, words

LEAST = 24
REPEATS = 3

_RUNS = "array<struct<start:long,length:long,period:long>>"


def split(code: np.ndarray, first: np.ndarray, least: int = LEAST, repeats: int = REPEATS) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stable segments of word codes; ``first`` bounds the texts."""
    starts, stops = first[:-1], first[1:]
    long = stops - starts >= least
    done_starts, done_stops = [], []
    starts, stops = starts[long], stops[long]
    while len(starts):
        size = stops - starts
        at = ranges(starts, size)
        segment = np.repeat(np.arange(len(starts)), size)
        _, kind = np.unique(code[at], return_inverse=True)
        _, place, count = np.unique(segment * (int(kind.max()) + 1) + kind, return_inverse=True, return_counts=True)
        rare = count[place] < repeats
        whole = np.bincount(segment[rare], minlength=len(starts)) == 0
        done_starts.append(starts[whole])
        done_stops.append(stops[whole])
        # Pieces between rare words, of those segments that were split.
        left = ~rare & ~whole[segment]
        new = np.append(True, (np.diff(at) != 1) | (np.diff(segment) != 0))
        before, after = np.append(False, left[:-1]), np.append(left[1:], False)
        begin = left & (~before | new)
        end = left & (~after | np.append(new[1:], True))
        starts, stops = at[begin], at[end] + 1
        keep = stops - starts >= least
        starts, stops = starts[keep], stops[keep]
    if not done_starts:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    starts, stops = np.concatenate(done_starts), np.concatenate(done_stops)
    order = np.argsort(starts)
    return starts[order], stops[order]


def scan(code: np.ndarray, starts: np.ndarray, stops: np.ndarray, least: int = LEAST, repeats: int = REPEATS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and smallest period of all runs within the segments, by start and period."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = stops - starts
    at = ranges(starts, size)
    if not len(at):
        empty = np.empty(0, dtype=np.int64)
        return empty, empty, empty
    segment = np.repeat(np.arange(len(starts)), size)
    end = np.repeat(stops, size)
    # number[i]: which window of ``width`` words begins at word i; windows of different segments differ. -1: none, or one
    # that doesn't come again.
    number = np.full(int(stops.max()) + 1, -1, dtype=np.int64)
    _, kind = np.unique(code[at], return_inverse=True)
    _, number[at] = np.unique(segment * (int(kind.max()) + 1) + kind, return_inverse=True)
    width, scale = 1, 1
    while len(at):
        # Windows of 2 * width words, from pairs.
        fits = at + 2 * width <= end
        at, end = at[fits], end[fits]
        after = number[np.minimum(at + width, len(number) - 1)]
        both = (number[at] >= 0) & (after >= 0)
        at, end, after = at[both], end[both], after[both]
        if not len(at):
            break
        _, pair = np.unique(number[at] * (int(after.max()) + 1) + after, return_inverse=True)
        width *= 2
        order = np.argsort(pair, kind="stable")
        same = pair[order][1:] == pair[order][:-1]
        here, there = at[order[:-1][same]], at[order[1:][same]]
        # Next occurrences at a distance of this scale, by lag and position.
        lag = there - here
        fit = (lag >= scale) & (lag < 2 * scale)
        here, lag = here[fit], lag[fit]
        if len(here):
            by = np.lexsort((here, lag))
            here, lag = here[by], lag[by]
            cut = np.flatnonzero(np.append(True, (np.diff(here) != 1) | (np.diff(lag) != 0)))
            last = np.append(cut[1:], len(here)) - 1
            begin, period = here[cut], lag[cut]
            length = here[last] - begin + width + period
            good = length >= np.maximum(least, repeats * period)
            found.append((begin[good], length[good], period[good]))
        again = np.zeros(len(at), dtype=bool)
        again[order[:-1][same]] = True
        again[order[1:][same]] = True
        number[:] = -1
        at, end = at[again], end[again]
        number[at] = pair[again]
        scale *= 2
    if not found:
        empty = np.empty(0, dtype=np.int64)
        return empty, empty, empty
    begin, length, period = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((period, begin))
    return begin[order], length[order], period[order]


def _strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """The run of the greatest length / period, compared exactly; the first of equal ones."""
    best = runs[0]
    for run in runs[1:]:
        if run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def with_runs(docs: DataFrame, id_column: str = "doc_id", least: int = LEAST, repeats: int = REPEATS) -> DataFrame:
    """(id, n_words, runs, strongest run as start, length, period, collapsed) of each row, also without runs.

    ``runs`` are in order of start and period. ``collapsed`` is the text's words joined by one space, without those that a
    run holds after its first period.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, after, data, offsets in blocks(batch.column(1)):
                w_starts, w_ends, first = words(data, offsets)
                code = codes(data, w_starts, w_ends)
                begin, length, period = scan(code, *split(code, first, least, repeats), least, repeats)
                owner = np.searchsorted(first, begin, side="right") - 1
                local = begin - first[owner]
                bounds = np.searchsorted(owner, np.arange(after - row + 1))
                gone = np.zeros(len(code) + 1, dtype=np.int64)
                np.add.at(gone, begin + period, 1)
                np.add.at(gone, begin + length, -1)
                stay = np.cumsum(gone)[:-1] == 0
                left = np.diff(np.append(0, np.cumsum(stay))[first])
                # Each kept word with one space after it; a text's last space is left out.
                n = (w_ends - w_starts)[stay] + 1
                ends = np.cumsum(n)
                out = np.append(data, np.uint8(32))[ranges(w_starts[stay], n)]
                out[ends - 1] = 32
                edge = np.append(0, ends)[np.append(0, np.cumsum(left))]
                texts = [out[a : max(a, b - 1)].tobytes() for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]
                best: list[tuple] = []
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                    own = list(zip(local[a:b].tolist(), length[a:b].tolist(), period[a:b].tolist()))
                    best.append(_strongest(own) if own else (None, None, None))
                triples = pa.StructArray.from_arrays([pa.array(local), pa.array(length), pa.array(period)], ["start", "length", "period"])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(row, after - row), pa.array(np.diff(first)), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), triples),
                        *(pa.array([t[i] for t in best], pa.int64()) for i in range(3)), pa.array(texts, pa.string()),
                    ],
                    [id_column, "n_words", "runs", "start", "length", "period", "collapsed"],
                )

    source = docs.select(F.col(f"`{id_column}`").cast("long").alias(id_column), "text")
    return source.mapInArrow(run, f"`{id_column}` long, n_words long, runs {_RUNS}, start long, length long, period long, collapsed string")


def listed(runs: Column | str) -> Column:
    """``start,length,period`` of each run with a line feed after it."""
    line = lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n"))
    return F.array_join(F.transform(runs, line), "")


def looped(found: Column, start: Column, period: Column) -> Column:
    """The words of an array, joined by one space, where the ``period`` words at ``start`` (from 0) go on to the end."""
    rest = F.size(found) - start
    block = F.slice(found, start + 1, F.least(period, rest))
    again = F.flatten(F.array_repeat(block, F.ceil(rest / period).cast("int")))
    return F.array_join(F.concat(F.slice(found, F.lit(1), start), F.slice(again, F.lit(1), rest)), " ")

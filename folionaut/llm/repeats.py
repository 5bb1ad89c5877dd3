"""Repeated passages across documents, found with prefix-partitioned suffix trees over words.

A passage repeats if ``WINDOW`` consecutive words of it also start earlier (in a document of a smaller id, or earlier in
the same one). All words of such windows are removed; windows are judged on the input.

1. Every window holds one anchor: of its runs of ``PREFIX`` words the one of the smallest code, the leftmost of equals.
   Equal windows have equal anchors. Anchors are the prefixes under which suffixes are grouped; those that occur once
   in all documents lead to leaves and are left out.
2. Windows under a repeated prefix go, as runs of text, to the group of that prefix. A prefix that more than
   ``group_limit`` suffixes share is lengthened to the whole window, which splits its suffixes over all groups. What
   repeats inside one task is settled there, and only the earliest of equals is shipped.
3. A group sorts its suffixes by doubling prefixes up to ``WINDOW`` words: the internal nodes of its suffix tree at that
   depth. All leaves of a node but the earliest are repeats; runs of them are the maximal repeats.

Words are told apart by 64-bit codes, windows within a task by 128 bits. Null and empty texts have no words; documents of
fewer words than a window stay whole; rows with one id count as copies of one document; rows with a null id stay whole
and repeat nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folionaut.llm.arrays import blocks, codes, ranges, windows, words
from folionaut.llm.encoding import binary_column
from folionaut.llm.session import partitions, staged

WINDOW = 20
PREFIX = 8
#: Anchors that a task contracts and ships at once.
LOT = 1 << 20
#: Prefixes that can be lengthened, at most; a prefix is too common above this share of all anchors, or GROUP_LIMIT.
MAX_COMMON = 100_000
GROUP_LIMIT = 20_000

#: Places of documents: a lot has the documents of one bucket, as differences, and a place for each.
_LOTS = "bucket int, docs binary, spots binary"
_SHIPPED = "bucket int, spots binary, keys binary, docs binary, firsts binary, counts binary, text binary, bounds binary"
_FIELDS = [f.split()[0] for f in _SHIPPED.split(", ")]


def _row(**given) -> pa.RecordBatch:
    """Rows of ``_SHIPPED``: ``bucket`` and other columns as arrays, the rest null."""
    n = len(given["bucket"])
    return pa.RecordBatch.from_arrays(
        [x if isinstance(x := given.get(f), pa.Array) else pa.array(x if x is not None else [None] * n, pa.binary()) for f in _FIELDS],
        _FIELDS,
    )


def _read(value: pa.Scalar, kind) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), dtype=kind) if value.is_valid else np.empty(0, dtype=kind)


def _column(batch: pa.RecordBatch, name: str, kind) -> np.ndarray:
    """All values of a binary column, one after the other."""
    return np.concatenate([np.empty(0, dtype=kind), *(_read(v, kind) for v in batch.column(batch.schema.get_field_index(name)))])


def anchored(code: np.ndarray, first: np.ndarray, window: int, prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows of a block's documents, the place of each one's anchor, and the codes of all prefixes."""
    count = np.maximum(np.diff(first) - window + 1, 0)
    start = ranges(first[:-1], count)
    key = windows(code, prefix)
    if not len(start):
        return start, start, key
    best, place = key[start].copy(), start.copy()
    for step in range(1, window - prefix + 1):
        other = key[start + step]
        less = other < best
        best[less], place[less] = other[less], start[less] + step
    return start, place, key


def _steps(docs: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Differences of neighbours, from 0 at each of ``at``: small numbers, which compress."""
    out = np.diff(docs, prepend=0).astype(np.int64)
    out[at] = docs[at]
    return out


def _lots(doc: np.ndarray, spots: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Lots of places, one for each bucket of documents."""
    if len(doc):
        home = doc % buckets
        order = np.lexsort((spots, doc, home))
        at = np.searchsorted(home[order], np.arange(buckets + 1))
        full = np.flatnonzero(np.diff(at))
        span = np.append(at[full], len(doc))
        yield _row(
            bucket=pa.array(full.astype(np.int32)), docs=binary_column(_steps(doc[order], at[full]), span),
            spots=binary_column(spots[order].astype(np.int32), span),
        )


def _only_lots(rows: pa.RecordBatch) -> pa.RecordBatch:
    return rows.select(["bucket", "docs", "spots"])


def gathered(lots: DataFrame, name: str) -> DataFrame:
    """(doc_id, ``name``): all places of each document."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(np.empty(0, np.int64), np.empty(0, np.int32))]
        for batch in batches:
            parts += [(np.cumsum(_read(d, np.int64)), _read(s, np.int32)) for d, s in zip(batch.column(0), batch.column(1))]
        doc, spot = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(doc, kind="stable")
        doc, spot = doc[order], spot[order]
        bounds = _groups(doc)
        for at in range(0, len(bounds) - 1, 5000):
            own = bounds[at : at + 5001]
            yield pa.RecordBatch.from_arrays([pa.array(doc[own[:-1]]), binary_column(spot[own[0] : own[-1]], own - own[0])], ["doc_id", name])

    spread = lots.repartition(partitions(lots.sparkSession), "bucket").select("docs", "spots")
    return spread.mapInArrow(gather, f"doc_id long, {name} binary")


def _groups(values: np.ndarray) -> np.ndarray:
    """Bounds of runs of equal values."""
    return np.append(np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else [], len(values)).astype(np.int64)


def repeated_prefixes(docs: DataFrame, window: int, prefix: int, group_limit: int, common_share: float) -> DataFrame:
    """Lots of the anchors that occur more than once, and rows of ``keys`` with the prefixes that are too common.

    ``common_share`` is the share of a bucket's anchors above which a prefix counts as too common.
    """
    buckets = partitions(docs.sparkSession)

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            key, doc, spot = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order = np.lexsort((spot, doc, key))
            key, doc, spot = key[order], doc[order], spot[order]
            bounds = _groups(key)
            lead, count = bounds[:-1], np.diff(bounds)
            rest = np.ones(len(key), dtype=bool)
            rest[lead] = False
            yield from _lots(doc[rest], spot[rest], buckets)
            key, doc, spot = key[lead], doc[lead], spot[lead]
            home = (key % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((spot, doc, home))
            at = np.searchsorted(home[order], np.arange(buckets + 1))
            full = np.flatnonzero(np.diff(at))
            span = np.append(at[full], len(key))
            pack = lambda x: binary_column(x[order], span)
            yield _row(
                bucket=pa.array(full.astype(np.int32)), keys=pack(key), docs=binary_column(_steps(doc[order], at[full]), span),
                firsts=pack(spot.astype(np.int32)), counts=pack(count.astype(np.int32)),
            )

        for batch in batches:
            for first_row, after, data, offsets in blocks(batch.column(1)):
                starts, ends, first = words(data, offsets)
                _, place, key = anchored(codes(data, starts, ends), first, window, prefix)
                place = np.unique(place)
                row = np.searchsorted(first, place, side="right") - 1
                ids = batch.column(0).slice(first_row, after - first_row).to_numpy()
                held.append((key[place], ids[row], place - first[row]))
                if sum(len(k) for k, _, _ in held) >= LOT:
                    yield from flush()
        if held:
            yield from flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, ...]] = [(np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 3)]
        for batch in batches:
            lots = batch.filter(pa.compute.is_valid(batch["spots"]))
            if lots.num_rows:
                yield pa.RecordBatch.from_arrays([*_only_lots(lots).columns, pa.nulls(lots.num_rows, pa.binary())], names)
            batch = batch.filter(pa.compute.is_null(batch["spots"]))
            docs_ = [np.cumsum(_read(v, np.int64)) for v in batch["docs"]]
            if docs_:
                counts = (_column(batch, n, np.int32).astype(np.int64) for n in ("firsts", "counts"))
                parts.append((_column(batch, "keys", np.uint64), np.concatenate(docs_), *counts))
        key, doc, spot, count = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(key, kind="stable")
        key, doc, spot, count = key[order], doc[order], spot[order], count[order]
        bounds = _groups(key)
        if len(key):
            sums = np.add.reduceat(count, bounds[:-1])
            again = np.repeat(sums > 1, np.diff(bounds))
            for rows in _lots(doc[again], spot[again], buckets):
                yield pa.RecordBatch.from_arrays([*_only_lots(rows).columns, pa.nulls(rows.num_rows, pa.binary())], names)
            common = key[bounds[:-1]][sums > max(group_limit, common_share * int(sums.sum()))]
            if len(common):
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int32()), *[pa.nulls(1, pa.binary())] * 2, pa.array([common.tobytes()], pa.binary())], names)

    names = ["bucket", "docs", "spots", "keys"]
    return docs.mapInArrow(ship, _SHIPPED).repartition(buckets, "bucket").mapInArrow(meet, f"{_LOTS}, keys binary")


def _numbered(values: np.ndarray) -> np.ndarray:
    """The place of each value among the distinct ones, in sorted order."""
    order = np.argsort(values)
    new = np.zeros(len(values), dtype=np.uint64)
    new[1:] = values[order[1:]] != values[order[:-1]]
    out = np.empty(len(values), dtype=np.uint64)
    out[order] = np.cumsum(new)
    return out


def tree_repeats(code: np.ndarray, starts: np.ndarray, window: int, doc: np.ndarray, spot: np.ndarray) -> np.ndarray:
    """Of the suffixes at ``starts``, those that share their first ``window`` words with one of a smaller (doc, spot).

    ``code`` are the words of all runs. The node of each suffix at depths 1, 2, 4, ... and then ``window`` is the number
    of its prefix of that many words in sorted order; suffixes of one node at depth ``window`` are the leaves below it.
    """
    node = _numbered(code)
    depth = 1
    while depth < window:
        step = min(depth, window - depth)
        # Numbers of both halves in one: the count of positions is far below 2^32.
        node = _numbered((node[: len(node) - step] << np.uint64(32)) | node[step:])
        depth += step
    own = node[starts]
    order = np.lexsort((spot, doc, own))
    bounds = _groups(own[order])
    lead = np.repeat(order[bounds[:-1]], np.diff(bounds))
    later = (doc[order] != doc[lead]) | (spot[order] != spot[lead])
    return np.sort(order[later])


def _rest(docs: DataFrame, common: np.ndarray, window: int, prefix: int) -> DataFrame:
    """Lots of the starts of the windows to remove, from (doc_id, text, marks) rows with their repeated anchors."""
    buckets = partitions(docs.sparkSession)

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = batch.column(2)
            for first_row, after, data, offsets in blocks(batch.column(1)):
                ids = batch.column(0).slice(first_row, after - first_row).to_numpy()
                starts, ends, first = words(data, offsets)
                code = codes(data, starts, ends)
                start, place, key = anchored(code, first, window, prefix)
                wanted = np.zeros(len(code) + 1, dtype=bool)
                for row in range(after - first_row):
                    spots = first[row] + _read(marks[first_row + row], np.int32)
                    wanted[spots[spots < first[row + 1]]] = True
                use = wanted[place]
                start, place = start[use], place[use]
                if not len(start):
                    continue
                row = np.searchsorted(first, start, side="right") - 1
                doc, spot = ids[row], start - first[row]
                a, b = windows(code, window), windows(code, window, salt=1)
                order = np.lexsort((spot, doc, b[start], a[start]))
                same = np.zeros(len(order), dtype=bool)
                same[1:] = (a[start][order][1:] == a[start][order][:-1]) & (b[start][order][1:] == b[start][order][:-1])
                head = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
                equal = same & (doc[order] == doc[head]) & (spot[order] == spot[head])
                later = np.zeros(len(start), dtype=bool)
                later[order[same & ~equal]] = True
                skip = np.zeros(len(start), dtype=bool)
                skip[order[same]] = True
                yield from _lots(doc[later], spot[later], buckets)
                # Runs: neighbouring windows of one anchor. Those of too common prefixes stand alone under all their words.
                start, place, doc, spot = start[~skip], place[~skip], doc[~skip], spot[~skip]
                lone = np.isin(key[place], common)
                begin = np.ones(len(start), dtype=bool)
                begin[1:] = (start[1:] != start[:-1] + 1) | (place[1:] != place[:-1]) | lone[1:]
                lead = np.flatnonzero(begin)
                size = np.diff(np.append(lead, len(start)))
                home = (np.where(lone[lead], a[start[lead]], key[place[lead]]) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(home, kind="stable")
                lead, size, home = lead[order], size[order], home[order]
                low, high = starts[start[lead]], ends[start[lead] + size + window - 2]
                text = data[ranges(low, high - low)]
                at = _groups(home)
                stop = np.append(0, np.cumsum(high - low))
                pack = lambda x: binary_column(x, at)
                yield _row(
                    bucket=pa.array(home[at[:-1]].astype(np.int32)), docs=pack(doc[lead]), firsts=pack(spot[lead].astype(np.int32)),
                    counts=pack(size.astype(np.int32)), bounds=pack((high - low).astype(np.int32)), text=binary_column(text, stop[at]),
                )

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, ...]] = []
        total = 0
        for batch in batches:
            lots = batch.filter(pa.compute.is_valid(batch["spots"]))
            if lots.num_rows:
                yield _only_lots(lots)
            shipped = batch.filter(pa.compute.is_null(batch["spots"]))
            for text, docs_, firsts, counts, bounds in zip(*(shipped[f] for f in ("text", "docs", "firsts", "counts", "bounds"))):
                # Only word codes are kept of each shipped row.
                data = _read(text, np.uint8)
                starts, ends, first = words(data, np.append(0, np.cumsum(_read(bounds, np.int32))))
                size = _read(counts, np.int32).astype(np.int64)
                code = codes(data, starts, ends)
                doc, spot = np.repeat(_read(docs_, np.int64), size), ranges(_read(firsts, np.int32).astype(np.int64), size)
                parts.append((code, total + ranges(first[:-1], size), doc, spot.astype(np.int32)))
                total += len(code)
        if not parts:
            return
        code, where, doc, spot = (np.concatenate(x) for x in zip(*parts))
        parts.clear()
        found = tree_repeats(code, where, window, doc, spot)
        for rows in _lots(doc[found], spot[found], buckets):
            yield _only_lots(rows)

    return docs.mapInArrow(ship, _SHIPPED).repartition(buckets, "bucket").mapInArrow(settle, _LOTS)


def without_repeats(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """``doc_id, n_words, n_removed, text``: the words that are kept, joined by one space."""
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = source.where("doc_id is not null")
    marked = staged(repeated_prefixes(keyed, window, prefix, group_limit, partitions(spark) / MAX_COMMON))
    # At most MAX_COMMON prefixes can each hold more than that share of a bucket.
    common = np.concatenate([np.empty(0, np.uint64), *(np.frombuffer(r["keys"], np.uint64) for r in marked.where("keys is not null").collect())])
    marks = gathered(marked.where("keys is null"), "marks")
    # Both joins below read the same shuffled texts.
    spread = keyed.repartition(partitions(spark), "doc_id")
    removed = _rest(spread.join(marks, "doc_id").select("doc_id", "text", "marks"), common, window, prefix)
    cuts = gathered(removed, "cuts")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts_ = batch.column(2)
            for first_row, after, data, offsets in blocks(batch.column(1)):
                starts, ends, first = words(data, offsets)
                gone = np.zeros(len(starts) + 1, dtype=np.int64)
                for row in range(after - first_row):
                    spots = first[row] + _read(cuts_[first_row + row], np.int32)
                    spots = spots[spots < first[row + 1]]
                    np.add.at(gone, spots, 1)
                    np.add.at(gone, np.minimum(spots + window, first[row + 1]), -1)
                stay = np.cumsum(gone)[:-1] == 0
                count = np.diff(first)
                left = np.diff(np.append(0, np.cumsum(stay))[first])
                # Each kept word with one space after it; a text's last space is then left out.
                s, n = starts[stay], (ends - starts)[stay] + 1
                padded = np.append(data, np.uint8(32))
                out = padded[ranges(s, n)]
                stops = np.cumsum(n)
                out[stops - 1] = 32
                bounds = np.append(0, stops)[np.append(0, np.cumsum(left))]
                text = binary_column(out, bounds)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first_row, after - first_row), pa.array(count), pa.array(count - left), text], ["doc_id", "n_words", "n_removed", "text"]
                )

    kept = spread.join(cuts, "doc_id", "left").select("doc_id", "text", "cuts").unionAll(
        source.where("doc_id is null").select("doc_id", "text", F.lit(None).cast("binary").alias("cuts"))
    )
    out = kept.mapInArrow(keep, "doc_id long, n_words long, n_removed long, text binary")
    text = F.col("text").cast("string")
    return out.withColumn("text", F.when(F.length(text) > 0, F.expr("substring(cast(text as string), 1, length(cast(text as string)) - 1)")).otherwise(text))

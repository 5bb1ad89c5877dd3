"""Exact Jaccard similarity join of documents' word shingles: links, and the components they make.

Jaccard distance is a metric, so distances to pivots bound distances between documents. Most pairs of documents share no
shingle at all and are at distance 1 of each other and of any pivot, which bounds nothing; so documents first meet in
regions of their own kind, and pivots do their work inside these:

1. A pair linked at the threshold differs in at most ``D`` shingles, given their sizes. Shingles are dealt by hash into
   ``D + 1`` parts, so at least one part is equal in both. Documents with an equal part (within overlapping size classes)
   meet, and those connected by such meetings make a region. Regions hold all links, and hardly anything else. Equal
   parts are contracted where they are made, so a group that holds a third of all rows is shipped once per task.
   Of documents with equal shingle sets one goes on, and a region of one set needs no join.
2. A region falls apart where its documents share no rare shingle: with shingles in order of how many documents of the
   region hold them, linked documents share one among their first ``n - ceil(threshold * n) + 1``, so those that do, and
   what is connected by them, are joined with each other, and nothing else. Chance meetings end here.
3. What is left is joined exactly: balls around pivots link their members at once; documents then belong to the Voronoi
   regions of the pivots, boundary documents also to each region that the triangle inequality leaves possible, and
   these are joined recursively. Pairs already connected, kept apart by the distances to a pivot, or without a common
   rare shingle are not compared.
4. A region too large for one task falls apart in step 2 over all tasks, again and again while that helps; what is still too
   large is joined by rounds of pivots over all its documents at once, in blocks.

Shingles are told apart by 64-bit codes. A part of very few shingles may come from a line that many texts share. With
fewer than ``SAFE_PARTS`` parts it counts only together with an equal part under a second (and third) way of dealing,
which a linked pair must have as well. With more parts those of at most one shingle are left out: a linked pair is then
missed only if its differing shingles hit every other part, each about once, a chance below 1e-13.

Null and empty texts have no shingles and no links; a text of fewer words than a shingle is one shingle; equal texts are
linked; rows with a null id are not linked; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folionaut.llm.arrays import SMALL_BLOCK_BYTES, blocks, codes, mix, ranges, windows, words
from folionaut.llm.components import components
from folionaut.llm.encoding import binary_column
from folionaut.llm.session import partitions, staged
from folionaut.llm.workers import only

#: Ratio of the sizes of a class.
CLASS_RATIO = 1.5
#: With fewer parts, those of so few shingles are combined with the parts of a second dealing, and then of a third.
SAFE_PARTS = 40
WEAK_PARTS = (2, 1)
#: Signatures contracted and shipped at once by a task, and their buckets for each shuffle partition.
LOT = 1 << 18
BUCKET = 1 << 19
#: Tasks that read the buckets. Each connects the documents of its buckets anew, so with more tasks edges come in more copies.
MEETING_TASKS = 24
#: Connected documents that a task keeps while it reads its buckets.
FOREST = 1 << 20
#: Bytes of a signature that are shipped. Equal signatures stay equal; a pair that meets by chance is compared, no more.
SHIPPED = 5
#: Shingles of a region that are compared with a pivot, or put in order, at once.
COMPARED = 1 << 18
#: Shingles of a region that one task joins; larger regions are joined by rounds of pivots.
REGION_SHINGLES = 8_000_000
#: Pivots of one region and round, and their shingles in all.
PIVOTS = 32
PIVOT_SHINGLES = 1_000_000
#: How often regions too large for one task are split by rare shingles, and the share of shingles left at which that ends.
SPLITS = 4
WORTH = 0.9

#: What tells shingle sets apart: size and two sums of mixed codes.
SET = ["n_shingles", "sum", "more"]
SET_FIELDS = "n_shingles long, sum long, more long"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle codes of each text in ascending order, one text after the other, and their bounds."""
    low = _LOWER[data]
    starts, ends, first = words(low, offsets)
    code = codes(low, starts, ends)
    count = np.diff(first)
    row = np.repeat(np.arange(len(count)), count)
    found = windows(code, width)
    inside = row[: len(found)] == row[width - 1 :] if len(found) else np.empty(0, dtype=bool)
    values, owner = [found[inside]], [row[: len(found)][inside]]
    for length in range(1, width):
        short = first[:-1][count == length]
        whole = np.zeros(len(short), dtype=np.uint64)
        for k in range(length):
            whole = mix(whole + code[short + k])
        values.append(mix(whole + np.uint64(length)))
        owner.append(np.flatnonzero(count == length))
    values, owner = np.concatenate(values), np.concatenate(owner)
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), dtype=bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[new], np.append(0, np.cumsum(np.bincount(owner[new], minlength=len(count))))


@lru_cache(maxsize=8)
def _classes(percent: int) -> tuple[np.ndarray, np.ndarray]:
    """First size of each size class, and its number of parts."""
    lows = [1]
    while lows[-1] < 1 << 40:
        lows.append(max(lows[-1] + 1, int(lows[-1] * CLASS_RATIO), -(-lows[-1] * 100 // percent)))
    bounds = np.array(lows, dtype=np.int64)
    return bounds[:-1], 2 * (bounds[1:] - 1) * (100 - percent) // (100 + percent) + 1


def _dealt(values: np.ndarray, local: np.ndarray, base: np.ndarray, k: np.ndarray, family: int) -> tuple[np.ndarray, np.ndarray]:
    """Code and size of every part of every document, empty parts too, under one way of dealing shingles."""
    spread = mix(values + np.uint64((0x5851F42D4C957F2D * (2 * family + 1)) & ((1 << 64) - 1)))
    slot = base[local] + (spread % k[local].astype(np.uint64)).astype(np.int64)
    order = np.argsort(slot, kind="stable")
    slot = slot[order]
    first = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
    sums = np.zeros(base[-1], dtype=np.uint64)
    sums[slot[first]] = np.add.reduceat(mix(spread[order] + np.uint64(1)), first)
    number = np.arange(base[-1]) - np.repeat(base[:-1], k)
    return mix(sums + mix(number.astype(np.uint64))), np.bincount(slot, minlength=base[-1])


def signatures(values: np.ndarray, bounds: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes by which linked documents meet, and the row of each."""
    size = np.diff(bounds)
    lows, parts = _classes(percent)
    own = np.searchsorted(lows, size, side="right") - 1
    out, rows = [np.empty(0, dtype=np.uint64)], [np.empty(0, dtype=np.int64)]
    # Each document in its own size class, and in the next one if a document there can be linked with it.
    for step in (0, 1):
        kind = own + step
        asked = (size > 0) & ((step == 0) | (100 * size >= percent * lows[np.minimum(kind, len(lows) - 1)]))
        few = parts[np.minimum(kind, len(parts) - 1)] < SAFE_PARTS
        for use in (np.flatnonzero(asked & ~few), np.flatnonzero(asked & few)):
            if not len(use):
                continue
            k, n = parts[kind[use]], size[use]
            own_values, local = values[ranges(bounds[use], n)], np.repeat(np.arange(len(use)), n)
            base = np.append(0, np.cumsum(k))
            owner = np.repeat(np.arange(len(use)), k)
            salt = mix(kind[use].astype(np.uint64) << np.uint64(40))
            code, filled = _dealt(own_values, local, base, k, 0)
            code = mix(code + salt[owner])
            if k[0] >= SAFE_PARTS:
                out.append(code[filled > 1])
                rows.append(use[owner[filled > 1]])
                continue
            for family, weak in enumerate((*WEAK_PARTS, -1), start=1):
                strong = filled > weak
                out.append(code[strong])
                rows.append(use[owner[strong]])
                if weak < 0 or strong.all():
                    break
                # A part of so few shingles says little alone: it counts together with each part of another dealing.
                at, prior = owner[~strong], code[~strong]
                more, count = _dealt(own_values, local, base, k, family)
                spots = ranges(base[at], k[at])
                code, filled = mix(mix(np.repeat(prior, k[at])) + more[spots]), count[spots]
                owner = np.repeat(at, k[at])
    return np.concatenate(out), np.concatenate(rows)


def _shipped(code: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The upper ``SHIPPED`` bytes of each code, as one binary value for each range of ``bounds``."""
    upper = code.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :SHIPPED]
    return binary_column(np.ascontiguousarray(upper).ravel(), bounds * SHIPPED)


def _unshipped(value: pa.Buffer) -> np.ndarray:
    """Codes of one shipped binary value; the bytes left behind read as 0."""
    upper = np.zeros((value.size // SHIPPED, 8), dtype=np.uint8)
    upper[:, :SHIPPED] = np.frombuffer(value, dtype=np.uint8).reshape(-1, SHIPPED)
    return upper.view(">u8").ravel().astype(np.uint64)


def _contract(code: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct codes with their smallest id, and the distinct edges from other ids to it."""
    order = np.lexsort((ids, code))
    code, ids = code[order], ids[order]
    new = np.ones(len(code), dtype=bool)
    new[1:] = code[1:] != code[:-1]
    head = ids[new][np.cumsum(new) - 1]
    edge = np.unique(np.column_stack([head, ids])[head != ids], axis=0)
    return code[new], ids[new], edge


def _keys(values: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """Size and two sums of mixed codes of each set, the columns of ``SET``."""
    full = np.flatnonzero(np.diff(bounds))
    keys = [np.diff(bounds)]
    for salt in (0, 0xA0761D6478BD642F):
        sums = np.zeros(len(bounds) - 1, dtype=np.uint64)
        if len(full):
            sums[full] = np.add.reduceat(mix(values ^ np.uint64(salt)), bounds[full])
        keys.append(sums.view(np.int64))
    return keys


def sizes(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, and the columns of ``SET``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("jaccard")
        for batch in batches:
            for first, after, data, offsets in blocks(batch.column(1), SMALL_BLOCK_BYTES):
                keys = _keys(*shingle_sets(data, offsets, width))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, after - first), *map(pa.array, keys)], ["doc_id", *SET])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, {SET_FIELDS}")


class Forest:
    """What a task's edges have connected so far. Beyond ``FOREST`` ids it starts anew, which costs edges and no connection."""

    def __init__(self) -> None:
        self.ids, self.parent = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)

    def parts(self) -> list[np.ndarray]:
        """The ids of each tree, ascending."""
        order = np.argsort(self.parent, kind="stable")
        return np.split(self.ids[order], np.flatnonzero(np.diff(self.parent[order])) + 1) if len(order) else []

    def add(self, edge: np.ndarray) -> np.ndarray:
        """Edges, at most one for each id, that connect with those given before what ``edge`` connects with them."""
        if len(self.ids) > FOREST:
            self.__init__()
        # New ids are put between those held, which are not sorted again.
        new = np.unique(edge)
        at = np.searchsorted(self.ids, new)
        fresh = np.ones(len(new), dtype=bool)
        inside = at < len(self.ids)
        fresh[inside] = self.ids[at[inside]] != new[inside]
        new, at = new[fresh], at[fresh]
        ids = np.insert(self.ids, at, new)
        now = np.arange(len(self.ids)) + np.cumsum(np.bincount(at, minlength=len(self.ids) + 1))[: len(self.ids)]
        before = np.arange(len(ids))
        before[now] = now[self.parent]
        # Edges between roots; each root points to the smallest of its own, until nothing moves.
        parent, ends = before.copy(), np.searchsorted(ids, edge)
        while True:
            a, b = parent[ends[:, 0]], parent[ends[:, 1]]
            low, high = np.minimum(a, b), np.maximum(a, b)
            ends, low, high = ends[low != high], low[low != high], high[low != high]
            if not len(ends):
                break
            np.minimum.at(parent, high, low)
            while not np.array_equal(parent, above := parent[parent]):
                parent = above
        moved = np.flatnonzero((before == np.arange(len(ids))) & (parent != before))
        self.ids, self.parent = ids, parent
        return np.column_stack([ids[parent[moved]], ids[moved]])


def meetings(docs: DataFrame, width: int, percent: int, shingles: int = 0) -> DataFrame:
    """(a, b): edges that connect all documents with an equal signature.

    Signatures are about as many as ``shingles``; buckets follow from that. A task reads its buckets one after the other, so it
    holds a bounded number of signatures at any size of the table. Documents meet in very many buckets, and one meeting
    is enough: of all the edges in a task's buckets those stay that connect what the ones before did not.
    """
    homes = partitions(docs.sparkSession)
    buckets = homes * max(1, -(-shingles // (BUCKET * homes)))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("jaccard")
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            code, ids, edge = _contract(*(np.concatenate(x) for x in zip(*held)))
            held.clear()
            home = (code % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((ids, home))
            bounds = np.searchsorted(home[order], np.arange(buckets + 1))
            full = np.flatnonzero(np.diff(bounds))
            # Ids of a bucket ascend; their differences are small numbers, which compress.
            ids = ids[order]
            step = np.diff(ids, prepend=0)
            step[bounds[full]] = ids[bounds[full]]
            span = np.append(bounds[full], len(code))
            yield pa.RecordBatch.from_arrays(
                [pa.array(full, pa.int32()), _shipped(code[order], span), binary_column(step.astype(np.int64), span)], ["bucket", "codes", "ids"]
            )
            if len(edge):
                pairs = binary_column(np.ascontiguousarray(edge).ravel(), np.array([0, edge.size]))
                yield pa.RecordBatch.from_arrays([pa.array([int(edge[0, 0] % buckets)], pa.int32()), pa.array([None], pa.binary()), pairs], ["bucket", "codes", "ids"])

        for batch in batches:
            for first, after, data, offsets in blocks(batch.column(1), SMALL_BLOCK_BYTES):
                ids = batch.column(0).slice(first, after - first).to_numpy()
                code, row = signatures(*shingle_sets(data, offsets, width), percent)
                held.append((code, ids[row]))
                if sum(len(c) for c, _ in held) >= LOT:
                    yield from flush()
        if held:
            yield from flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("jaccard")
        code: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        edges: list[np.ndarray] = []
        forest = Forest()

        def flush() -> Iterator[pa.RecordBatch]:
            if code:
                edges.append(_contract(np.concatenate(code), np.concatenate(ids))[2])
            if edges:
                edge = forest.add(np.unique(np.concatenate(edges), axis=0))
                yield pa.RecordBatch.from_arrays([pa.array(edge[:, 0]), pa.array(edge[:, 1])], ["a", "b"])
            for held in (code, ids, edges):
                held.clear()

        current = None
        for batch in batches:
            for bucket, c, i in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                if bucket != current:
                    yield from flush()
                    current = bucket
                if c.is_valid:
                    code.append(_unshipped(c.as_buffer()))
                    ids.append(np.cumsum(np.frombuffer(i.as_buffer(), dtype=np.int64)))
                else:
                    edges.append(np.frombuffer(i.as_buffer(), dtype=np.int64).reshape(-1, 2))
        yield from flush()

    source = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    made = source.mapInArrow(make, "bucket int, codes binary, ids binary")
    dealt = made.repartition(homes, "bucket").sortWithinPartitions("bucket").coalesce(MEETING_TASKS)
    return dealt.mapInArrow(meet, "a long, b long")


class Region:
    """Shingle sets of one region, and the components found so far."""

    def __init__(self, values: np.ndarray, bounds: np.ndarray, percent: int):
        self.bounds, self.size = bounds, np.diff(bounds)
        # Shingles by number, four bytes each; the codes themselves are not kept.
        order = np.argsort(values)
        ordered = values[order]
        new = np.ones(len(values), dtype=bool)
        new[1:] = ordered[1:] != ordered[:-1]
        del ordered
        self.elements = int(new.sum())
        self.flat = np.empty(len(values), dtype=np.int32)
        self.flat[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
        self.percent = percent
        self.reach = 1 - percent / 100 + 1e-9
        self.parent = np.arange(len(self.size))
        self.mark = np.zeros(self.elements, dtype=bool)
        self.index: tuple[np.ndarray, ...] | None = None

    def rare(self) -> tuple[np.ndarray, ...]:
        """The rarest shingles of each set that another set has among its own rarest too: shingles by set and the bounds of
        the sets, sets by shingle and the bounds of the shingles. Sets at or above the threshold have one in common."""
        if self.index is None:
            held = np.bincount(self.flat, minlength=self.elements).astype(np.int32)
            counted = self.size - -(-self.percent * self.size // 100) + 1
            found, rows, first = [np.empty(0, dtype=np.int32)], [np.empty(0, dtype=np.int64)], 0
            while first < len(self.size):
                after = max(first + 1, int(np.searchsorted(self.bounds, self.bounds[first] + COMPARED, side="right")) - 1)
                flat, size = self.flat[self.bounds[first] : self.bounds[after]], self.size[first:after]
                own = np.repeat(np.arange(len(size)), size)
                order = np.lexsort((flat, held[flat], own))
                place = np.arange(len(flat)) - np.repeat(self.bounds[first:after] - self.bounds[first], size)
                flat = flat[order]
                use = (place < np.repeat(counted[first:after], size)) & (held[flat] > 1)
                found.append(flat[use])
                rows.append(own[use] + first)
                first = after
            shingle, row = np.concatenate(found), np.concatenate(rows)
            both = np.bincount(shingle, minlength=self.elements)[shingle] > 1
            shingle, row = shingle[both], row[both]
            # Shingles are numbered anew, so that the index follows what it holds.
            shingle = np.unique(shingle, return_inverse=True)[1]
            order = np.argsort(shingle, kind="stable")
            ends = np.append(0, np.cumsum(np.bincount(shingle))) if len(shingle) else np.zeros(1, dtype=np.int64)
            self.index = shingle, np.searchsorted(row, np.arange(len(self.size) + 1)), row[order], ends
        return self.index

    def apart(self) -> list[np.ndarray]:
        """Sets that are connected by their rarest shingles, those alone left out: no set is linked with one elsewhere."""
        _, _, row, ends = self.rare()
        head = np.repeat(row[ends[:-1]], np.diff(ends)) if len(row) else row
        forest = Forest()
        forest.add(np.unique(np.column_stack([head, row])[head != row], axis=0))
        return forest.parts()

    def candidates(self, row: int) -> np.ndarray:
        """All sets that have one of the rarest shingles of ``row`` among their own."""
        shingle, own, rows, ends = self.rare()
        mine = shingle[own[row] : own[row + 1]]
        return np.unique(rows[ranges(ends[mine], ends[mine + 1] - ends[mine])])

    def roots(self, rows: np.ndarray) -> np.ndarray:
        found = self.parent[rows]
        while not np.array_equal(found, above := self.parent[found]):
            found = above
        self.parent[rows] = found
        return found

    def root(self, x: int) -> int:
        return int(self.roots(np.array([x]))[0])

    def distances(self, pivot: int, rows: np.ndarray) -> np.ndarray:
        """Distances to ``rows``; those within the threshold are linked."""
        mark, held = self.mark, self.flat[self.bounds[pivot] : self.bounds[pivot + 1]]
        mark[held] = True
        n = self.size[rows]
        shared, ends, first = np.empty(len(rows), dtype=np.int64), np.cumsum(n), 0
        while first < len(rows):
            after = max(first + 1, int(np.searchsorted(ends, ends[first] - n[first] + COMPARED, side="right")))
            own = n[first:after]
            hit = mark[self.flat[ranges(self.bounds[rows[first:after]], own)]]
            shared[first:after] = np.add.reduceat(hit, np.cumsum(own) - own, dtype=np.int64)
            first = after
        mark[held] = False
        union = n + self.size[pivot] - shared
        self.parent[self.roots(rows[100 * shared >= self.percent * union])] = self.root(pivot)
        return 1 - shared / union

    def join(self, rows: np.ndarray) -> None:
        """Find all links between ``rows`` (ascending), or others that connect the same documents."""
        if len(rows) < 2:
            return
        split = len(rows) > 2 * PIVOTS
        table: list[np.ndarray] = []
        covered = np.zeros(len(rows), dtype=bool)
        nearest = np.full(len(rows), np.inf)
        while not covered.all() and not (split and len(table) == PIVOTS):
            # The next pivot is the document farthest from those before.
            at = int(np.argmax(np.where(covered, -1.0, nearest)))
            table.append(self.distances(int(rows[at]), rows))
            nearest = np.minimum(nearest, table[-1])
            covered |= table[-1] <= self.reach
            covered[at] = True
        near = np.array(table)
        if split and not covered.all():
            members = near <= nearest + 2 * self.reach
            # Worth it only if boundary copies don't outgrow what the split saves.
            if members.sum() <= 2 * len(rows) and members.sum(axis=1).max() < 0.8 * len(rows):
                for own in members:
                    part = rows[own]
                    if len(np.unique(self.roots(part))) > 1:
                        self.join(part)
                return
        # Few documents, or pivots that don't separate them: compare what the distances leave open, smaller components first.
        label = self.roots(rows)
        known, count = np.unique(label, return_counts=True)
        for i in np.flatnonzero(label != known[count.argmax()]).tolist():
            # Far fewer than all documents, so none of these steps grows with the region.
            near_by = self.candidates(int(rows[i]))
            met = np.minimum(np.searchsorted(rows, near_by), len(rows) - 1)
            met = met[rows[met] == near_by]
            met = met[self.roots(rows[met]) != self.root(int(rows[i]))]
            met = met[(np.abs(near[:, met] - near[:, i : i + 1]) <= self.reach).all(axis=0)]
            if len(met):
                self.distances(int(rows[i]), rows[met])


def _distinct_sets(texts: Iterable[pa.Array], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Shingle codes and bounds of the distinct sets that are not empty, for each text of all arrays the number of its set,
    or -1, and the columns of ``SET`` of the sets.

    Block after block, copies are let go as they are seen, so memory follows the distinct sets, however many copies a
    region holds.
    """
    known: dict[tuple[int, int, int], int] = {}
    kept, number = [np.empty(0, dtype=np.uint64)], [np.empty(0, dtype=np.int64)]
    for _, _, data, offsets in (block for array in texts for block in blocks(array, SMALL_BLOCK_BYTES)):
        values, bounds = shingle_sets(data, offsets, width)
        size = np.diff(bounds)
        own, new = np.full(len(size), -1, dtype=np.int64), []
        for row, key in enumerate(zip(*(k.tolist() for k in _keys(values, bounds)))):
            if not key[0]:
                continue
            if (at := known.get(key)) is None:
                at = known[key] = len(known)
                new.append(row)
            own[row] = at
        new = np.array(new, dtype=np.int64)
        kept.append(values[ranges(bounds[new], size[new])])
        number.append(own)
    keys = np.array(list(known), dtype=np.int64).reshape(-1, 3)
    return np.concatenate(kept), np.append(0, np.cumsum(keys[:, 0])), np.concatenate(number), [np.ascontiguousarray(k) for k in keys.T]


def _join_region(percent: int, width: int):
    """One region's documents to their components. Texts pass batch by batch; only their distinct sets are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("jaccard")
        ids_: list[np.ndarray] = []

        def texts() -> Iterator[pa.Array]:
            for batch in batches:
                ids_.append(batch.column("doc_id").to_numpy().copy())
                yield batch.column("text")

        values, bounds, number, keys = _distinct_sets(texts(), width)
        ids, count = np.concatenate(ids_), len(bounds) - 1
        region = Region(values, bounds, percent)
        del values
        for part in region.apart():
            region.join(part)
        label = region.roots(np.arange(count))
        number, ids = number[number >= 0], ids[number >= 0]
        least = np.full(count, np.iinfo(np.int64).max)
        np.minimum.at(least, label[number], ids)
        yield pa.RecordBatch.from_arrays([pa.array(ids), *(pa.array(k[number]) for k in keys), pa.array(least[label[number]])], ["doc_id", *SET, "component"])

    return run


def _split(members: DataFrame, width: int, percent: int, shingles: int) -> DataFrame:
    """(node, region): ``members`` (node, region, n_shingles, text) in finer regions, those alone left out.

    Shingles are told apart by region and dealt to buckets, which count the members that hold each. Only those held by two
    or more go on to their members; the others come first in a member's order of rarity and meet nothing. The first
    shingles of a member in that order connect it with whatever else has them first.
    """
    homes = partitions(members.sparkSession)
    buckets = homes * max(1, -(-shingles // (BUCKET * homes)))

    def dealt(home: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
        """A row for each bucket with its part of the columns."""
        order = np.argsort(home, kind="stable")
        full, first = np.unique(home[order], return_index=True)
        span = np.append(first, len(home))
        return pa.RecordBatch.from_arrays(
            [pa.array(full.astype(np.int32)), *(binary_column(np.ascontiguousarray(c[order]).view(np.int64), span) for c in columns)],
            ["bucket", "nodes", "codes", "counts"][: 1 + len(columns)],
        )

    def grouped(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[list[np.ndarray]]:
        """The columns of one bucket after the other; rows without codes come as codes 0."""
        held: list[list[np.ndarray]] = []
        current = None
        for batch in batches:
            for bucket, *row in zip(batch.column(0).to_pylist(), *(batch.column(1 + k) for k in range(columns))):
                if bucket != current and held:
                    yield [np.concatenate(c) for c in zip(*held)]
                    held = []
                current = bucket
                held.append([np.frombuffer(c.as_buffer(), dtype=np.int64) for c in row])
        if held:
            yield [np.concatenate(c) for c in zip(*held)]

    def home_of(nodes: np.ndarray) -> np.ndarray:
        return (mix(nodes.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("jaccard")
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            nodes, codes_ = (np.concatenate(x) for x in zip(*held))
            held.clear()
            return dealt((codes_ % np.uint64(buckets)).astype(np.int64), nodes, codes_)

        for batch in batches:
            node, region = batch.column(0).to_numpy(), mix(batch.column(1).to_numpy().astype(np.uint64))
            for first, after, data, offsets in blocks(batch.column(2), SMALL_BLOCK_BYTES):
                values, bounds = shingle_sets(data, offsets, width)
                size = np.diff(bounds)
                held.append((np.repeat(node[first:after], size), mix(values ^ np.repeat(region[first:after], size))))
                if sum(len(n) for n, _ in held) >= LOT:
                    yield flush()
        if held:
            yield flush()

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("jaccard")
        for nodes, codes_ in grouped(batches, 2):
            order = np.argsort(codes_, kind="stable")
            nodes, codes_ = nodes[order], codes_[order]
            first = np.flatnonzero(np.r_[True, codes_[1:] != codes_[:-1]][: len(codes_)])
            count = np.repeat(np.diff(np.append(first, len(codes_))), np.diff(np.append(first, len(codes_))))
            nodes, codes_, count = nodes[count > 1], codes_[count > 1], count[count > 1]
            if len(nodes):
                yield dealt(home_of(nodes), nodes, codes_, count)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, size = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if len(nodes):
                yield dealt(home_of(nodes), nodes, np.zeros(len(nodes), dtype=np.int64), -size)

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("jaccard")
        for nodes, codes_, count in grouped(batches, 3):
            # A node's size, less than 0, comes before the counts of its shared shingles.
            order = np.lexsort((codes_, count, nodes))
            nodes, codes_, count = nodes[order], codes_[order], count[order]
            first = np.flatnonzero(np.r_[True, nodes[1:] != nodes[:-1]])
            several, size = np.diff(np.append(first, len(nodes))), -count[first]
            alone = size - (several - 1)
            use = np.arange(len(nodes)) - np.repeat(first, several) <= np.repeat(size - -(-percent * size // 100) + 1 - alone, several)
            use[first] = False
            yield pa.RecordBatch.from_arrays([pa.array(codes_[use]), pa.array(nodes[use])], ["code", "node"])

    made = members.select("node", "region", "text").mapInArrow(make, "bucket int, nodes binary, codes binary")
    counted = made.repartition(homes, "bucket").sortWithinPartitions("bucket").mapInArrow(shared, (fields := "bucket int, nodes binary, codes binary, counts binary"))
    both = counted.unionAll(members.select("node", "n_shingles").mapInArrow(measured, fields))
    first = staged(both.repartition(homes, "bucket").sortWithinPartitions("bucket").mapInArrow(rarest, "code long, node long"))
    heads = first.groupBy("code").agg(F.min("node").alias("head"))
    found = components(first.join(heads.hint("merge"), "code").select(F.col("head").alias("a"), F.col("node").alias("b")))
    return found.select(F.col("id").alias("node"), F.col("component").alias("region"))


def _large_regions(rows: DataFrame, percent: int, width: int) -> DataFrame:
    """(a, b) links that connect what is linked in regions too large for one task.

    ``rows`` are (region, doc_id, text). Each round takes pivots from each region, compares all its documents with them,
    and goes on with the documents outside the region's largest component that have been no pivot.
    """
    spark = rows.sparkSession

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, after, data, offsets in blocks(batch.column(2), SMALL_BLOCK_BYTES):
                values, bounds = shingle_sets(data, offsets, width)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, after - first), batch.column(1).slice(first, after - first), pa.array(np.diff(bounds)), binary_column(values, bounds)],
                    ["region", "doc_id", "n", "codes"],
                )

    members = staged(rows.select("region", "doc_id", "text").mapInArrow(sets, "region long, doc_id long, n long, codes binary").where("n > 0"))
    links, open_ = None, members.select("region", "doc_id", "n")
    done = spark.createDataFrame([], "doc_id long")
    while True:
        # A bounded number of pivots, in a fixed random order, whatever the number of regions and documents.
        wanted = open_.orderBy(F.xxhash64("doc_id"), "doc_id").limit(PIVOTS * 8)
        pivots, total = [], 0
        for r in members.join(F.broadcast(wanted.select("doc_id")), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").toLocalIterator():
            if pivots and total + r["n"] > PIVOT_SHINGLES:
                break
            pivots.append((r["region"], r["doc_id"], np.frombuffer(r["codes"], dtype=np.uint64)))
            total += r["n"]
        if not pivots:
            return links if links is not None else spark.createDataFrame([], "a long, b long")
        shared = spark.sparkContext.broadcast(pivots)

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                a, b = [], []
                for region, doc, codes_ in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                    own = np.frombuffer(codes_.as_buffer(), dtype=np.uint64)
                    for home, pivot, other in shared.value:
                        if home == region and pivot != doc and 100 * min(len(own), len(other)) >= percent * max(len(own), len(other)):
                            both = len(np.intersect1d(own, other, assume_unique=True))
                            if 100 * both >= percent * (len(own) + len(other) - both):
                                a.append(pivot)
                                b.append(doc)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        found = staged(members.select("region", "doc_id", "codes").mapInArrow(compare, "a long, b long"))
        links = found if links is None else links.unionAll(found)
        done = staged(done.unionAll(spark.createDataFrame([(d,) for _, d, _ in pivots], "doc_id long")))
        label = members.select("region", "doc_id", "n").join(components(links).withColumnRenamed("id", "doc_id"), "doc_id", "left")
        label = label.withColumn("component", F.coalesce("component", "doc_id"))
        counts = label.groupBy("region", "component").count()
        main = counts.groupBy("region").agg(F.max_by("component", F.struct("count", "component")).alias("main"))
        open_ = staged(
            label.join(main, "region").where("component <> main").join(done, "doc_id", "left_anti").select("region", "doc_id", "n")
        )


def _weights(members: DataFrame) -> DataFrame:
    return members.groupBy("region").agg(F.sum("n_shingles").alias("weight"), F.count("*").alias("sets"))


def _oversized(rows: DataFrame, width: int, percent: int, region_shingles: int) -> DataFrame:
    """(columns of ``SET``, component) of what is joined in regions too large for one task. ``rows`` are (region, doc_id, text)."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("jaccard")
        for batch in batches:
            for first, after, data, offsets in blocks(batch.column(2), SMALL_BLOCK_BYTES):
                keys = _keys(*shingle_sets(data, offsets, width))
                own = [batch.column(k).slice(first, after - first) for k in range(3)]
                yield pa.RecordBatch.from_arrays([*own, *map(pa.array, keys)], ["region", "doc_id", "text", *SET])

    kept = rows.select("region", "doc_id", "text").mapInArrow(keyed, f"region long, doc_id long, text string, {SET_FIELDS}").where("n_shingles > 0")
    # Rows are numbered as they are kept: an id may stand for several texts.
    texts = staged(kept.withColumn("node", F.monotonically_increasing_id()))
    large, fitting = texts.select("node", "region", "n_shingles"), []
    weight = before = large.agg(F.sum("n_shingles")).first()[0]
    for n in range(SPLITS):
        if n and weight > WORTH * before:
            break
        own = texts if not n else texts.drop("region").join(large.select("node", "region").hint("merge"), "node")
        finer = staged(_split(own, width, percent, weight).join(large.select("node", "n_shingles").hint("merge"), "node"))
        heavy = _weights(finer).where(F.col("weight") > region_shingles).select("region")
        fitting.append(finer.join(heavy, "region", "left_anti"))
        large = staged(finer.join(heavy, "region", "left_semi").select("node", "region", "n_shingles"))
        before, weight = weight, large.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
        if not weight:
            break
    placed = fitting[0]
    for more in fitting[1:]:
        placed = placed.unionByName(more)
    own = texts.select("node", "doc_id", "text").join(placed.select("node", "region").hint("merge"), "node")
    found = own.groupBy("region").applyInArrow(_join_region(percent, width), f"doc_id long, {SET_FIELDS}, component long").drop("doc_id")
    if weight:
        rest = texts.drop("region").join(large.select("node", "region").hint("merge"), "node")
        linked = components(_large_regions(rest.select("region", F.col("node").alias("doc_id"), "text"), percent, width))
        linked = texts.select("node", "doc_id", *SET).join(linked.withColumnRenamed("id", "node").hint("merge"), "node")
        least = linked.groupBy("component").agg(F.min("doc_id").alias("least"))
        found = found.unionByName(linked.join(least.hint("merge"), "component").select(*SET, F.col("least").alias("component")))
    return found


def joined(docs: DataFrame, width: int = 5, percent: int = 80, region_shingles: int = REGION_SHINGLES) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: documents link if ``100 * intersection >= percent * union``."""
    size = staged(sizes(docs, width))
    shingles = size.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    regions = components(meetings(docs, width, percent, shingles))
    placed = regions.select(F.col("id").alias("doc_id"), F.col("component").alias("region"))
    # Of equal sets the document of the smallest id is compared for all.
    full = size.where("doc_id is not null and n_shingles > 0")
    sets = staged(full.groupBy(*SET).agg(F.min("doc_id").alias("doc_id")).join(placed.hint("merge"), "doc_id", "left"))
    weight = staged(_weights(sets.where("region is not null")).where("sets > 1"))
    large = weight.where(F.col("weight") > region_shingles).select("region")
    # Both sides grow with the documents, so neither is broadcast at any size.
    # An inner join, which unlike a semi join stays above the grouping, so that a region of very many sets can be split.
    chosen = sets.select("doc_id", "region").distinct().join(weight.select("region").hint("merge"), "region")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen.hint("merge"), "doc_id")
    one = rows.join(large, "region", "left_anti").groupBy("region").applyInArrow(_join_region(percent, width), f"doc_id long, {SET_FIELDS}, component long")
    one = one.drop("doc_id")
    if not large.isEmpty():
        one = one.unionByName(_oversized(rows.join(large, "region", "left_semi"), width, percent, region_shingles))
    least = one.groupBy(*SET).agg(F.min("component").alias("component"))
    found = sets.select(*SET, "doc_id").join(least.hint("merge"), SET, "left").select(*SET, F.coalesce("component", "doc_id").alias("component"))
    of_docs = full.join(found.hint("merge"), SET).groupBy("doc_id").agg(F.min("component").alias("component"))
    return size.join(of_docs, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def representatives(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component, the one of the smallest id. Rows with one id are one document; rows
    without an id stay."""
    others = joined(docs, width, percent).where("doc_id <> component_id").select("doc_id")
    return docs.join(others.distinct().hint("merge"), "doc_id", "left_anti")

"""Lloyd's clustering of whole-number vectors with the dimensions dealt into column blocks.

Vectors are cut into blocks of ``WIDTH`` columns and lots of ``LOT`` rows; a block of a lot is one row of the block table,
which is written once. In each round

1. a task that holds blocks computes the exact partial squared distances of their rows to its slice of each centroid,
2. a reduction by lot adds the blocks of a lot and takes each row's nearest centroid (ties: the smaller number),
3. the assignments return to the blocks, whose columns are summed by block and cluster; each block's reducer turns sums
   and counts into its own slice of the new centroids, with exact floor division. A cluster without rows keeps its slice.

The driver sees the centroids alone: clusters times dimensions, both parameters. No task needs more than one lot of one
block and its slice, so neither many dimensions nor many rows meet in one place; lots are dealt by row number, so no
cluster, however large, and no repeated vector makes a task hot.

Components are whole numbers of absolute value at most ``LARGEST``, else the job ends with an error, since sums would leave
64 bits; nothing is clipped. Rows are clustered each for itself, repeated ones too. Other columns pass in ``row`` under
whatever names. An empty table gives an empty result; fewer start vectors than asked make fewer clusters.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folionaut.llm.session import staged

LOT = 1024
WIDTH = 32
LARGEST = 1 << 26


def whole(vector: Column, scale: int, dimensions: int) -> Column:
    """floor(scale * x) of each component; null where the vector is null, of another length, or holds null or non-finite ones."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when((F.size(vector) == dimensions) & ~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def _narrow(values: np.ndarray) -> np.ndarray:
    """The same non-negative numbers in the narrowest unsigned type that holds them, byte planes apart (they compress)."""
    top = int(values.max()) if values.size else 0
    kind = next(t for t in (np.uint16, np.uint32, np.uint64) if top <= np.iinfo(t).max)
    return values.astype(kind)


def _packed(values: np.ndarray) -> bytes:
    small = _narrow(values)
    planes = np.ascontiguousarray(small.reshape(-1, 1).view(np.uint8).T) if small.size else small
    return bytes([small.dtype.itemsize]) + planes.tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    width = raw[0]
    planes = np.frombuffer(raw, dtype=np.uint8, offset=1).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(f"u{width}").ravel().astype(np.int64)


def blocks_of(rows: DataFrame, dimensions: int, width: int = WIDTH) -> DataFrame:
    """(lot, block, n, cells) of rows (lot, place, x array<long>)."""

    def cut(group: pa.Table) -> pa.Table:
        order = np.argsort(group.column("place").to_numpy())
        x = group.column("x").combine_chunks().flatten().to_numpy().reshape(-1, dimensions)[order]
        if np.abs(x).max() > LARGEST:
            raise ValueError(f"a component is beyond {LARGEST}")
        count = ceil(dimensions / width)
        cells = []
        for block in range(count):
            part = x[:, block * width : (block + 1) * width]
            kind = np.int16 if np.abs(part).max() < 1 << 15 else np.int32
            cells.append(np.ascontiguousarray(part.astype(kind)).tobytes())
        lot = group.column("lot")[0].as_py()
        return pa.table({
            "lot": pa.array([lot] * count, pa.int64()), "block": pa.array(range(count), pa.int32()),
            "n": pa.array([len(x)] * count, pa.int32()), "cells": pa.array(cells, pa.binary()),
        })

    return rows.groupBy("lot").applyInArrow(cut, "lot long, block int, n int, cells binary")


def _cells(n: int, raw: bytes, columns: int) -> np.ndarray:
    kind = np.int16 if len(raw) == 2 * n * columns else np.int32
    return np.frombuffer(raw, dtype=kind).reshape(n, columns).astype(np.int64)


def assigned(blocks: DataFrame, centroids: np.ndarray, width: int = WIDTH) -> DataFrame:
    """(lot, clusters binary int32, distances binary int64): partial distances by block, added and compared by lot."""
    k, dimensions = centroids.shape

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for block, n, raw in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                own = centroids[:, block * width : (block + 1) * width]
                x = _cells(n, raw, own.shape[1])
                distance = np.empty((k, n), dtype=np.int64)
                for c in range(k):
                    step = x - own[c]
                    distance[c] = np.einsum("ij,ij->i", step, step)
                out.append(_packed(distance.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.binary())], ["lot", "n", "partial"])

    def add(group: pa.Table) -> pa.Table:
        n = group.column("n")[0].as_py()
        total = np.zeros(k * n, dtype=np.int64)
        for raw in group.column("partial").to_pylist():
            total += _unpacked(raw)
        total = total.reshape(k, n)
        nearest = total.argmin(axis=0)
        return pa.table({
            "lot": group.column("lot").slice(0, 1), "clusters": pa.array([nearest.astype(np.int32).tobytes()], pa.binary()),
            "distances": pa.array([total[nearest, np.arange(n)].tobytes()], pa.binary()),
        })

    partials = blocks.mapInArrow(partial, "lot long, n int, partial binary")
    return partials.groupBy("lot").applyInArrow(add, "lot long, clusters binary, distances binary")


def moved(blocks: DataFrame, assignments: DataFrame, centroids: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """The next centroids: each block's slice from its own sums."""
    k, dimensions = centroids.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per block that the task meets: partial sums of its columns, and counts, by cluster."""
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, n, raw, clusters in zip(*(batch.column(c).to_pylist() for c in ("block", "n", "cells", "clusters"))):
                columns = min(width, dimensions - block * width)
                own = held.setdefault(block, np.zeros((k, columns + 1), dtype=np.int64))
                x, cluster = _cells(n, raw, columns), np.frombuffer(clusters, dtype=np.int32)
                order = np.argsort(cluster, kind="stable")
                first = np.flatnonzero(np.append(True, np.diff(cluster[order]) != 0))
                found = cluster[order][first]
                own[found, :-1] += np.add.reduceat(x[order], first, axis=0)
                own[found, -1] += np.bincount(cluster, minlength=k)[found]
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())], ["block", "sums"])

    def update(group: pa.Table) -> pa.Table:
        block = group.column("block")[0].as_py()
        own = centroids[:, block * width : (block + 1) * width]
        # Python's integers: sums over all rows may leave 64 bits.
        total = np.zeros((k, own.shape[1] + 1), dtype=object)
        for raw in group.column("sums").to_pylist():
            total = total + np.frombuffer(raw, dtype=np.int64).reshape(total.shape).astype(object)
        full = total[:, -1] > 0
        new = own.astype(object)
        new[full] = total[full, :-1] // total[full, -1:]
        return pa.table({"block": group.column("block").slice(0, 1), "slice": pa.array([new.astype(np.int64).tobytes()], pa.binary())})

    joined = blocks.join(assignments.select("lot", "clusters"), "lot")
    slices = joined.mapInArrow(sums, "block int, sums binary").groupBy("block").applyInArrow(update, "block int, slice binary")
    out = centroids.copy()
    for r in slices.collect():
        out[:, r["block"] * width : (r["block"] + 1) * width] = np.frombuffer(r["slice"], dtype=np.int64).reshape(k, -1)
    return out


def numbered(rows: DataFrame, lot: int = LOT) -> DataFrame:
    """``rows`` with ``lot`` and ``place`` (from 0 in the lot), written once so that both stay what they are."""
    marked = staged(rows.withColumn("number", F.monotonically_increasing_id()))
    return marked.withColumn("lot", F.shiftright("number", lot.bit_length() - 1)).withColumn("place", F.pmod("number", F.lit(lot)).cast("int"))


def cluster(vectors: DataFrame, start: Column, k: int, rounds: int, dimensions: int, width: int = WIDTH) -> tuple[DataFrame, np.ndarray]:
    """Rows (row struct, x array<long>) of ``vectors`` with ``cluster`` and ``distance``, and the final centroids.

    Centroids start as the ``k`` vectors of the smallest ``start`` (null: last; ties: the smaller vector).
    """
    rows = numbered(vectors.where("x is not null"))
    chosen = rows.orderBy(F.asc_nulls_last(start), "x").select("x").limit(k).collect()
    if not chosen:
        return rows.select("row", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0), np.empty((0, dimensions), dtype=np.int64)
    centroids = np.array([r["x"] for r in chosen], dtype=np.int64)
    spread = staged(blocks_of(rows.select("lot", "place", "x"), dimensions, width))
    for _ in range(rounds):
        centroids = moved(spread, assigned(spread, centroids, width), centroids, width)
    found = assigned(spread, centroids, width)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lot, clusters, distances in zip(*(batch.column(c).to_pylist() for c in range(3))):
                c, d = np.frombuffer(clusters, dtype=np.int32), np.frombuffer(distances, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), lot)), pa.array(np.arange(len(c), dtype=np.int32)), pa.array(c), pa.array(d)], ["lot", "place", "cluster", "distance"])

    each = found.mapInArrow(unpack, "lot long, place int, cluster int, distance long")
    return rows.join(each, ["lot", "place"]).select("row", "cluster", "distance"), centroids

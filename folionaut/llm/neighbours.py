"""Approximate nearest neighbours by inner product over balanced posting lists.

Centroids come from a bounded sample; a centroid of too few vectors moves into the list of too many. Every vector is
indexed: it goes to its nearest list, and a vector near the boundary to the next ones as well. A query finds its lists by a best-first walk over a graph of the centroids and keeps those whose distance is
within a ratio of the nearest. Lists longer than ``PART`` are split; the pairs (query, part) and the vectors of a part
meet in one group.

How many lists a query reads, and how far, follows the data: a bounded set of the queries is answered by brute force over
all vectors, and the reading is widened until these queries find the wanted share of their neighbours (``calibrate``).

Inner products become distances by one more coordinate that gives all vectors the largest norm. Equal vectors are one
entry with their smallest ids, as many as can matter, so a vector that a third of all rows share costs one. Vectors that
are null, empty or zero or hold null or non-finite components take no part; ties go to the smaller id; with fewer
candidates than asked all found are returned; an empty table gives an empty result; vectors of unequal lengths raise.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, replace
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType


@dataclass(frozen=True)
class Settings:
    #: Vectors that centroids are fitted on, at most about so many.
    sample: int = 65_536
    #: Vectors per list, and lists at most.
    list_size: int = 128
    max_lists: int = 8_192
    #: Lists of a vector, and the most that its distance to one may exceed the nearest, as a ratio.
    copies: int = 4
    copy_ratio: float = 1.3
    #: Lists of a query, and the same ratio for them; both at least, since sampled queries widen them.
    lists: int = 64
    list_ratio: float = 1.5
    #: Share of their neighbours that the sampled queries must find, and how many of them there are.
    recall: float = 0.95
    probes: int = 256
    #: Centroids that the walk keeps in view.
    breadth: int = 96
    #: Vectors of one part of a list.
    part: int = 4_096
    #: Neighbours of a centroid in the graph.
    degree: int = 24


def usable(table: DataFrame) -> DataFrame:
    """(vec_id, v) of the vectors that take part, as doubles."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return table.select("vec_id", v.alias("v")).where("v is not null and vec_id is not null").where(fine & F.exists("v", lambda x: x != 0))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def classes(vectors: DataFrame, keep: int) -> DataFrame:
    """(class_id, ids, v): distinct vectors with their ``keep`` smallest ids. Each task adds at most ``keep`` ids to a vector."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[bytes, list[int]] = {}
        for batch in batches:
            for key, x in zip(batch.column(0).to_pylist(), _matrix(batch.column(1)) + 0.0):
                own = best.setdefault(x.tobytes(), [])
                if len(own) < keep or -own[0] > key:
                    (heapq.heappush if len(own) < keep else heapq.heapreplace)(own, -key)
        keys = list(best)
        for at in range(0, len(keys), 1000):
            some = keys[at : at + 1000]
            yield pa.RecordBatch.from_pydict(
                {"v": [np.frombuffer(k) for k in some], "ids": [[-i for i in best[k]] for k in some]},
                schema=pa.schema([("v", pa.list_(pa.float64())), ("ids", pa.list_(pa.int64()))]),
            )

    found = vectors.mapInArrow(local, "v array<double>, ids array<long>")
    merged = found.groupBy("v").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, keep).alias("ids"))
    return merged.select(F.get("ids", F.lit(0)).alias("class_id"), "ids", "v")


class Index:
    """Centroids with their graph; ``radius`` is the largest norm."""

    def __init__(self, sample: np.ndarray, rows: int, radius: float, settings: Settings):
        self.settings, self.radius = settings, radius
        points = self.lifted(sample)
        wanted = min(max(1, ceil(rows / settings.list_size)), settings.max_lists, len(points))
        self.centroids = self._fit(points, wanted)
        squared = ((self.centroids[:, None] - self.centroids[None]) ** 2).sum(-1) if len(self.centroids) <= 512 else self._distances(self.centroids)
        near = np.argsort(squared, axis=1, kind="stable")[:, 1 : settings.degree + 1]
        random = np.random.default_rng(7)
        far = random.integers(0, len(self.centroids), (len(self.centroids), 4))  # long links keep the graph in one piece
        self.graph = np.concatenate([near, far], axis=1)
        self.entries = np.unique(np.linspace(0, len(self.centroids) - 1, 16).astype(int))

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """Vectors with the coordinate that brings them to the largest norm."""
        rest = np.sqrt(np.maximum(self.radius**2 - (x**2).sum(axis=1), 0))
        return np.column_stack([x, rest])

    def asked(self, q: np.ndarray) -> np.ndarray:
        """Queries at the largest norm: distances then order lists as inner products do."""
        scaled = q * (self.radius / np.sqrt((q**2).sum(axis=1)))[:, None]
        return np.column_stack([scaled, np.zeros(len(q))])

    def _distances(self, x: np.ndarray) -> np.ndarray:
        """Squared distances to all centroids."""
        return np.maximum((x**2).sum(1)[:, None] - 2 * x @ self.centroids.T + (self.centroids**2).sum(1)[None], 0)

    def _fit(self, points: np.ndarray, wanted: int) -> np.ndarray:
        random = np.random.default_rng(11)
        self.centroids = points[random.choice(len(points), wanted, replace=False)].copy()
        for _ in range(8):
            near = np.concatenate([self._distances(points[i : i + 4096]).argmin(axis=1) for i in range(0, len(points), 4096)])
            sizes = np.bincount(near, minlength=wanted)
            sums = np.zeros_like(self.centroids)
            np.add.at(sums, near, points)
            self.centroids = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], self.centroids)
            # Balance: centroids of few points move to points of the fullest lists.
            mean = len(points) / wanted
            full, thin = np.flatnonzero(sizes > 2 * mean), np.flatnonzero(sizes < mean / 4)
            for a, b in zip(thin, full[np.argsort(-sizes[full])]):
                self.centroids[a] = points[random.choice(np.flatnonzero(near == b))]
        return self.centroids

    def lists_of(self, x: np.ndarray) -> Iterator[tuple[int, list[int]]]:
        """For each vector its lists, nearest first."""
        top = self.settings
        squared = self._distances(self.lifted(x))
        count = min(len(self.centroids), top.copies)
        order = np.argpartition(squared, count - 1, axis=1)[:, :count]
        for row, near in enumerate(order):
            near = near[np.argsort(squared[row, near], kind="stable")]
            limit = squared[row, near[0]] * top.copy_ratio**2
            chosen = [int(near[0])]
            for c in near[1:].tolist():
                if squared[row, c] > limit:
                    break
                chosen.append(c)
            yield row, chosen

    def lists_for(self, q: np.ndarray) -> Iterator[tuple[int, list[int]]]:
        """For each query the lists to read: a best-first walk over the centroid graph, pruned by distance ratio.

        A walk that keeps a large part of the centroids in view sees them all; their distances are then taken at once."""
        top = self.settings
        breadth = max(top.lists, top.breadth)
        if 4 * breadth >= len(self.centroids):
            for at in range(0, len(q), 256):
                squared = self._distances(self.asked(q[at : at + 256]))
                order = np.argsort(squared, axis=1, kind="stable")[:, : top.lists]
                for row, near in enumerate(order):
                    d = squared[row, near]
                    yield at + row, near[d <= d[0] * top.list_ratio**2].tolist()
            return
        for row, x in enumerate(self.asked(q)):
            seen = np.zeros(len(self.centroids), dtype=bool)
            found: list[tuple[float, int]] = []  # the best so far, farthest first
            ahead: list[tuple[float, int]] = []
            fresh = self.entries
            while True:
                seen[fresh] = True
                for d, c in zip(((self.centroids[fresh] - x) ** 2).sum(axis=1).tolist(), fresh.tolist()):
                    if len(found) < breadth:
                        heapq.heappush(found, (-d, c))
                    elif d < -found[0][0]:
                        heapq.heapreplace(found, (-d, c))
                    else:
                        continue
                    heapq.heappush(ahead, (d, c))
                if not ahead or (len(found) == breadth and ahead[0][0] > -found[0][0]):
                    break
                fresh = np.unique(self.graph[heapq.heappop(ahead)[1]])
                fresh = fresh[~seen[fresh]]
            best = sorted((-d, c) for d, c in found)
            yield row, [c for d, c in best[: top.lists] if d <= best[0][0] * top.list_ratio**2]


def build(distinct: DataFrame, settings: Settings = Settings()) -> Index | None:
    """Fit an index on a sample of ``classes``; None for an empty table."""
    size = F.size("v")
    facts = distinct.agg(
        F.count("*").alias("n"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).alias("radius"),
        F.min(size).alias("least"), F.max(size).alias("most"),
    ).first()
    if not facts["n"]:
        return None
    if facts["least"] != facts["most"]:
        raise ValueError(f"vectors of {facts['least']} to {facts['most']} components")
    share = ceil(facts["n"] / settings.sample)
    sample = distinct.where(F.pmod(F.xxhash64("class_id"), F.lit(share)) == 0).select("class_id", "v").toArrow().sort_by("class_id")
    return Index(_matrix(sample.column("v").combine_chunks()), facts["n"], facts["radius"], settings)


def _nearest_classes(distinct: DataFrame, probes: np.ndarray, keep: int) -> dict[int, list[tuple[float, int]]]:
    """For each row of ``probes`` its ``keep`` best (score, class_id) over all rows. Each task adds at most ``keep`` to a probe."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores, names = np.zeros((len(probes), 0)), np.zeros((len(probes), 0), dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            own = np.broadcast_to(batch.column(0).to_numpy(), (len(probes), batch.num_rows))
            scores, names = np.hstack([scores, probes @ _matrix(batch.column(1)).T]), np.hstack([names, own])
            if scores.shape[1] > keep:
                best = np.argpartition(-scores, keep - 1, axis=1)[:, :keep]
                scores, names = np.take_along_axis(scores, best, 1), np.take_along_axis(names, best, 1)
        if scores.size:
            at = np.repeat(np.arange(len(probes), dtype=np.int32), scores.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(scores.ravel()), pa.array(names.ravel())], ["probe", "score", "class_id"])

    found = distinct.select("class_id", "v").mapInArrow(run, "probe int, score double, class_id long")
    entries = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("down"), "class_id")))
    best = found.groupBy("probe").agg(F.slice(entries, 1, keep).alias("best")).collect()
    return {r["probe"]: [(-b["down"], b["class_id"]) for b in r["best"]] for r in best}


def calibrate(index: Index, posted: DataFrame, distinct: DataFrame, asked: DataFrame, k: int) -> None:
    """Widen the reading of ``index`` until sampled rows of ``asked`` find the wanted share of their true neighbours.

    Only the sampled queries, their neighbours and these neighbours' lists reach the driver."""
    top = index.settings
    rows = asked.orderBy(F.xxhash64("asked_id"), "asked_id").limit(top.probes).collect()
    if not rows:
        return
    probes = np.array([r["v"] for r in rows])
    if probes.shape[1] + 1 != index.centroids.shape[1]:
        raise ValueError(f"queries of {probes.shape[1]} components, vectors of {index.centroids.shape[1] - 1}")
    best = _nearest_classes(distinct, probes, k + 1)
    wanted = asked.sparkSession.createDataFrame(sorted({(c,) for own in best.values() for _, c in own}), "class_id long")
    homes = posted.select("class_id", "ids", "list").join(wanted, "class_id", "left_semi").groupBy("class_id")
    homes = {r["class_id"]: (r["ids"], r["lists"]) for r in homes.agg(F.first("ids").alias("ids"), F.collect_set("list").alias("lists")).collect()}
    truth = []  # for each probe the lists of each true neighbour
    for at, r in enumerate(rows):
        near = sorted((-score, i, c) for score, c in best.get(at, ()) for i in homes[c][0] if i != r["asked_id"])[:k]
        truth.append([homes[c][1] for _, _, c in near])
    total = sum(map(len, truth))
    if not total:
        return
    least = ceil(top.recall * total)
    squared = index._distances(index.asked(probes))
    ranks, ratios = [], []
    for own, near in zip(squared, truth):
        rank = np.empty(len(own), dtype=int)
        rank[np.argsort(own, kind="stable")] = np.arange(len(own))
        first = [min(lists, key=rank.__getitem__) for lists in near]
        ranks += rank[first].tolist()
        ratios += np.sqrt(own[first] / max(own.min(), 1e-300)).tolist()
    ratio = top.list_ratio
    if sum(x <= ratio for x in ratios) < least:
        # Half of what may be lost is left to the number of lists.
        ratio = sorted(ratios)[ceil((1 + top.recall) / 2 * total) - 1] * (1 + 1e-9)
    lists = max(top.lists, sorted(n for n, x in zip(ranks, ratios) if x <= ratio)[least - 1] + 1)
    while True:
        index.settings = replace(top, lists=lists, list_ratio=ratio, breadth=max(top.breadth, lists * 3 // 2))
        found = sum(not set(own).isdisjoint(read) for at, read in index.lists_for(probes) for own in truth[at])
        if found >= least or lists >= len(index.centroids):
            return
        lists = min(len(index.centroids), lists * 5 // 4 + 1)  # what the walk misses


def _listed(rows: DataFrame, shared, asked: bool) -> DataFrame:
    """Rows once for each of their lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            at, lists = [], []
            for row, own in (index.lists_for if asked else index.lists_of)(_matrix(batch.column(batch.num_columns - 1))):
                at += [row] * len(own)
                lists += own
            for lot in range(0, len(at), 4096):
                part = batch.take(pa.array(at[lot : lot + 4096]))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lists[lot : lot + 4096], pa.int32())], [*part.schema.names, "list"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("list", IntegerType())]))


def search(table: DataFrame, queries: DataFrame, k: int = 20, settings: Settings = Settings()) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each ``vec_id, embedding`` row of ``queries`` its ``k`` nearest rows of
    ``table`` other than itself."""
    from folionaut.llm.session import staged

    spark = table.sparkSession
    distinct = staged(classes(usable(table), k + 1))
    index = build(distinct, settings)
    own = usable(queries)
    if index is None:
        return own.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    # Equal queries are asked once, under the smallest id of their vector.
    asked = own.groupBy("v").agg(F.min("vec_id").alias("asked_id")).select("asked_id", "v")
    shared = spark.sparkContext.broadcast(index)
    posted = staged(_listed(distinct.select("class_id", "ids", "v"), shared, asked=False))
    # One row per list; their number is bounded by the settings.
    parts = {r["list"]: ceil(r["n"] / settings.part) for r in posted.groupBy("list").agg(F.count("*").alias("n")).collect()}
    number = F.get(F.split(F.lit(",".join(str(parts.get(c, 0)) for c in range(len(index.centroids)))), ",").cast("array<int>"), F.col("list"))
    cells = posted.select("class_id", "ids", "v", "list", F.pmod(F.xxhash64("class_id"), number).cast("int").alias("part"))
    calibrate(index, posted, distinct, asked, k)
    routed = _listed(asked, spark.sparkContext.broadcast(index), asked=True).withColumn("part", F.explode(F.sequence(F.lit(0), number - 1)))

    def near(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"asked_id": [], "ids": [], "score": []}
        if left.num_rows and right.num_rows:
            q, x = _matrix(left.column("v").combine_chunks()), _matrix(right.column("v").combine_chunks())
            names, ids = left.column("asked_id").to_pylist(), right.column("ids").combine_chunks()
            take = min(k + 1, len(x))
            for lot in range(0, len(q), 256):
                rough = q[lot : lot + 256] @ x.T
                # Products of a matrix round differently from place to place: keep what may tie, then multiply in one fixed order.
                least = -np.partition(-rough, take - 1, axis=1)[:, take - 1] - 1e-9 * index.radius**2
                for row, (line, low) in enumerate(zip(rough, least)):
                    chosen = np.flatnonzero(line >= low)
                    score = (q[lot + row] * x[chosen]).sum(axis=1)
                    first = np.array([ids[i].values[0].as_py() for i in chosen.tolist()])
                    chosen, score = (a[np.lexsort((first, -score))[:take]] for a in (chosen, score))
                    out["asked_id"] += [names[lot + row]] * len(chosen)
                    out["ids"] += [ids[i].as_py() for i in chosen.tolist()]
                    out["score"] += score.tolist()
        return pa.table(out, schema=pa.schema([("asked_id", pa.int64()), ("ids", pa.list_(pa.int64())), ("score", pa.float64())]))

    hits = routed.groupBy("list", "part").cogroup(cells.groupBy("list", "part")).applyInArrow(near, "asked_id long, ids array<long>, score double")
    entries = F.collect_set(F.struct((-F.col("score")).alias("down"), F.col("id")))
    best = (
        hits.select("asked_id", "score", F.explode("ids").alias("id"))
        .groupBy("asked_id").agg(F.slice(F.array_sort(entries), 1, k + 1).alias("best"))
    )
    names = own.join(asked, "v").select(F.col("vec_id").alias("query_id"), "asked_id")
    others = F.slice(F.filter("best", lambda b: b["id"] != F.col("query_id")), 1, k)
    return (
        names.join(best, "asked_id").select("query_id", F.posexplode(others).alias("place", "hit"))
        .select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("hit.id").alias("vec_id"), (-F.col("hit.down")).alias("score"))
    )

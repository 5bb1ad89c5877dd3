"""Exact duplicates, sharded clustering and periodic runs, held against plain versions."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from folionaut.llm import exactdedup, lloyd, periodic
from folionaut.llm.perfecthash import PerfectHash
from folionaut.llm.queries import QUERIES

from . import brute
from .conftest import SMALL


def random_digests(n, width=32, seed=1):
    return np.random.default_rng(seed).integers(0, 256, (n, width), dtype=np.uint8)


@pytest.mark.parametrize("n", [0, 1, 2, 63, 5000])
def test_perfect_hash_is_minimal_and_survives_dumping(n):
    digests = random_digests(n)
    table = PerfectHash.load(*PerfectHash.build(digests).dump(), 32)
    assert sorted(table.slots(digests).tolist()) == list(range(n))
    assert (table.slots(random_digests(500, seed=2)) < n).all()


def test_perfect_hash_where_the_hashed_bytes_are_equal():
    """Digests that differ in the middle only never part by hashing; they are found in order."""
    digests = random_digests(300)
    digests[:, :8], digests[:, -8:] = 7, 9
    table = PerfectHash.load(*PerfectHash.build(digests).dump(), 32)
    assert sorted(table.slots(digests).tolist()) == list(range(300))
    other = random_digests(5, seed=3)
    other[:, :8], other[:, -8:] = 7, 9
    assert (table.slots(other) == -1).all()


def plain_groups(rows):
    groups = defaultdict(list)
    for at, (doc, text) in enumerate(rows):
        groups[brute.low(text)].append((doc is not None, doc or 0, at))
    return groups


HISTORIES = [None, "true", "doc_id % 2 = 0", "doc_id < 9"]


@pytest.mark.parametrize("history", HISTORIES, ids=["none", "all", "even", "low"])
def test_exact_duplicates_of_edges(llm, edges, history):
    history = history and F.expr(history)
    rows = edges.select("doc_id", "text").collect()
    groups = plain_groups([(r["doc_id"], r["text"]) for r in rows])
    got = exactdedup.resolved(edges, history).select("doc.*", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("hash"))
    assert "a.b" in got.columns
    found = got.select("doc_id", "keep_id", "group_size", "kept", "hash").collect()
    assert len(found) == len(rows)
    by_hash = {hashlib.sha256(t.encode()).hexdigest(): g for t, g in groups.items()}
    kept = defaultdict(int)
    for r in found:
        group = by_hash[r["hash"]]
        known, best, _ = max(group)
        assert r["keep_id"] == (best if known else None) and r["group_size"] == len(group)
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
        kept[r["hash"]] += r["kept"]
    assert set(kept.values()) == {1}
    whole = exactdedup.deduplicated(edges, history)
    assert whole.columns == edges.columns and whole.count() == len(groups)


def test_exact_duplicates_of_nothing(nothing):
    assert exactdedup.resolved(nothing).count() == 0 and exactdedup.deduplicated(nothing, F.lit(True)).count() == 0


def test_an_index_serves_later_tables(llm, monkeypatch):
    """Many shards, an index kept as a table, one text in a third of all rows, tasks that ship in lots."""
    monkeypatch.setattr(exactdedup, "COMBINED", 50)
    texts = [f"t{i % 700}" if i % 3 else "HOT" for i in range(3000)]
    frame = llm.createDataFrame(list(enumerate(texts)), "id long, text string")
    rows = frame.select(exactdedup.digest("text").alias("digest"), "id", F.col("id").alias("row")).repartition(7)
    index = exactdedup.build_index(rows.where("id < 1500"), 5)
    assert index.count() == 5
    for least in (1500, 2000):
        later = exactdedup.absorb(rows.where(F.col("id") >= least), index, 5)
        got = {bytes(r["digest"]): (r["id"], r["n"]) for r in later.collect()}
        want = defaultdict(list)
        for i, t in enumerate(texts):
            if i < 1500 or i >= least:
                want[hashlib.sha256(t.lower().encode()).digest()].append(i)
        assert got == {d: (max(own), len(own)) for d, own in want.items()}


def plain_lloyd(vectors, k, rounds):
    """(cluster, distance) of each (id, vector), and the centroids, with Python's integers."""
    order = sorted(vectors, key=lambda v: hashlib.sha256(f"2:{v[0]}".encode()).hexdigest())
    centroids = [list(x) for _, x in order[:k]]

    def nearest(x):
        distance = [sum((a - b) ** 2 for a, b in zip(x, m)) for m in centroids]
        return min(range(len(distance)), key=lambda c: (distance[c], c)), min(distance)

    for _ in range(rounds):
        groups = defaultdict(list)
        for _, x in vectors:
            groups[nearest(x)[0]].append(x)
        for c, own in groups.items():
            centroids[c] = [sum(column) // len(own) for column in zip(*own)]
    return {i: nearest(x) for i, x in vectors}, centroids


@pytest.mark.parametrize(("dimensions", "width", "k", "high"), [(5, 2, 4, 6), (7, 7, 3, 50_000), (3, 32, 9, 3), (4, 1, 40, 1 << 26)])
def test_lloyd_against_plain(llm, dimensions, width, k, high):
    """Ties, clusters that lose all rows, numbers beyond 32 bits in sums, column blocks that don't divide the dimensions."""
    generator = np.random.default_rng(dimensions)
    rows = [(i, generator.integers(-high, high + 1, dimensions).tolist()) for i in range(60)]
    rows += [(100 + i, rows[0][1]) for i in range(20)]
    frame = llm.createDataFrame([((i,), x) for i, x in rows], "row struct<vec_id:long>, x array<long>").repartition(5)
    start = F.sha2(F.concat(F.lit("2:"), F.col("row.vec_id").cast("string")).cast("binary"), 256)
    each, centroids = lloyd.cluster(frame, start, k, 3, dimensions, width)
    want, means = plain_lloyd(rows, k, 3)
    assert {r["vec_id"]: (r["cluster"], r["distance"]) for r in each.select("row.*", "cluster", "distance").collect()} == want
    assert centroids.tolist() == means


def test_lloyd_lots_cross_batches(llm):
    """More rows than a lot and than an Arrow batch holds, in one task."""
    rows = [(i, [i % 97, -(i % 13)]) for i in range(5000)]
    frame = llm.createDataFrame([((i,), x) for i, x in rows], "row struct<vec_id:long>, x array<long>").coalesce(1)
    start = F.sha2(F.concat(F.lit("2:"), F.col("row.vec_id").cast("string")).cast("binary"), 256)
    each, _ = lloyd.cluster(frame, start, 6, 2, 2, 1)
    want, _ = plain_lloyd(rows, 6, 2)
    assert {r["vec_id"]: (r["cluster"], r["distance"]) for r in each.select("row.*", "cluster", "distance").collect()} == want


def test_lloyd_keeps_usable_vectors(llm):
    nan, inf = float("nan"), float("inf")
    given = [(1, [0.5, -0.001]), (2, None), (3, [1.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (None, [2.0, 2.0]), (1, [0.5, -0.001]), (7, [])]
    frame = llm.createDataFrame(given, "vec_id long, v array<float>").withColumn("cluster", F.lit("x"))
    usable = frame.select(F.struct("vec_id", "cluster").alias("row"), lloyd.whole(F.col("v"), 256, 2).alias("x"))
    each, centroids = lloyd.cluster(usable, F.col("row.vec_id"), 40, 2, 2)
    assert sorted((r["row"]["vec_id"] or 0, r["cluster"], r["distance"]) for r in each.collect()) == [(0, 2, 0), (1, 0, 0), (1, 0, 0)]
    assert centroids.tolist() == [[128, -1], [128, -1], [512, 512]]
    empty, none = lloyd.cluster(usable.limit(0), F.col("row.vec_id"), 40, 2, 2)
    assert empty.count() == 0 and none.shape == (0, 2)
    with pytest.raises(Exception, match="beyond"):
        lloyd.cluster(llm.createDataFrame([((1,), [1 << 40])], "row struct<vec_id:long>, x array<long>"), F.col("row.vec_id"), 1, 1, 1)


def plain_runs(words, least=24, repeats=3):
    """All runs by comparing the words at every lag."""
    n, found = len(words), {}
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            start, stop = i, j + q
            if stop - start >= max(least, repeats * q) and not any(s <= start and stop <= e and q % p == 0 for (s, e), p in found.items()):
                found[start, stop] = q
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def described(words):
    runs = plain_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return runs, best, " ".join(w for i, w in enumerate(words) if i not in gone)


def random_texts(seed):
    random_ = random.Random(seed)
    for letters, size in [(1, 40), (2, 200), (3, 300), (9, 200)] * 4:
        words = []
        while len(words) < size:
            passage = [random_.choice("abcdefghi"[:letters]) for _ in range(random_.randint(1, 40))]
            words += (passage * random_.randint(1, 9))[: random_.randint(1, 150)]
            words += [f"x{random_.randint(0, 50)}" for _ in range(random_.randint(0, 3))]
        yield words


@pytest.mark.parametrize("seed", range(6))
def test_runs_against_plain(llm, seed):
    texts = list(random_texts(seed))
    frame = llm.createDataFrame([(i, "\t".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in periodic.with_runs(frame).collect():
        runs, best, collapsed = described(texts[r["doc_id"]])
        assert [tuple(x) for x in r["runs"]] == runs and r["n_words"] == len(texts[r["doc_id"]])
        assert (r["start"], r["length"], r["period"]) == (best or (None, None, None)) and r["collapsed"] == collapsed


def test_nested_and_strange_runs(llm):
    inner = ["a"] * 30
    fibonacci = ["a", "b"]
    while len(fibonacci) < 700:
        fibonacci = fibonacci + fibonacci[: len(fibonacci) - len(fibonacci) * 382 // 1000]
    texts = [(inner + ["b"]) * 4, inner + ["b"] * 24, (["a", "b"] * 11 + ["a"]), ["a", "b"] * 12, fibonacci, (["a"] * 23 + ["b"]) * 3]
    frame = llm.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in periodic.with_runs(frame).collect():
        assert [tuple(x) for x in r["runs"]] == described(texts[r["doc_id"]])[0]


def test_splitting_recurses():
    """A word that is frequent in the whole, but not in the piece that a rare word leaves, splits that piece again."""
    code = np.array([1, 2] * 10 + [9] + [1, 3] * 10 + [1] * 3 + [8] + [4] * 30, dtype=np.uint64)
    starts, stops = periodic.split(code, np.array([0, len(code)]))
    assert [(a, b) for a, b in zip(starts.tolist(), stops.tolist())] == [(len(code) - 30, len(code))]


def test_runs_of_edges(llm, edges, nothing):
    got = periodic.with_runs(edges).collect()
    assert len(got) == edges.count() and periodic.with_runs(nothing).count() == 0
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    assert [(r["n_words"], r["runs"], r["collapsed"]) for d in (1, 2, 3) for r in by[d]] == [(0, [], "")] * 3
    assert len(by[5]) == 2 and len(by[None]) == 1
    assert [tuple(x) for x in by[9][0]["runs"]] == [(0, 30, 1)] and by[9][0]["collapsed"] == "Ab"
    # 120,000 words with a period of 977: one run, found without trying all lags.
    assert [tuple(x) for x in by[14][0]["runs"]] == [(0, 120_000, 977)]


def test_runs_query(llm, rows):
    got = {r["doc_id"]: r for r in QUERIES["op13_periodic_runs"](llm, SMALL).collect()}
    assert len(got) == len(rows)
    planted = 0
    for doc, text in rows:
        words = brute.SPACED.findall(text)
        h, n = zlib.crc32(str(doc).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            planted += 1
        if len(words) > 3000 and h % 10:
            continue  # the plain version takes the square of the length
        runs, best, collapsed = described(words)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        r = got[doc]
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *(best or (None,) * 3))
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if best else None)
        assert r["runs_sha256"] == hashlib.sha256(lines.encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(collapsed.encode()).hexdigest()
    assert planted > 5

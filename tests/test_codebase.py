"""Spans, graph context, roots, the validity gate and the card collection against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from folionaut.operators import context, gate, spans
from folionaut.plans import cardstore
from folionaut.sources.roots import with_roots


def plain_pairs(a, b):
    return sorted((i, j) for i, g, s, e in a for j, h, t, f in b if g == h and s <= f and e >= t and s <= e and t <= f)


@pytest.mark.parametrize("seed", range(3))
def test_overlap_of_all_lengths(spark, seed):
    random_ = random.Random(seed)

    def some(n):
        for i in range(n):
            start = random_.randint(0, 5000)
            yield i, random_.choice("xy"), start, start + random_.choice([-1, 0, 1, 15, 16, 17, 100, 4000, 100_000])

    a, b = list(some(150)), list(some(120))
    left = spark.createDataFrame(a, "i int, g string, s int, e int")
    right = spark.createDataFrame(b, "j int, g string, t int, f int")
    got = spans.overlapping(left, right, "g", ("s", "e"), ("t", "f")).select("i", "j").collect()
    assert sorted(map(tuple, got)) == plain_pairs(a, b)
    assert spans.overlapping(left.limit(0), right, "g", ("s", "e"), ("t", "f")).count() == 0


def test_a_whole_file_is_few_rows(spark):
    """One span over a million lines meets ten short ones: the join sees a handful of rows for it, not one per bucket."""
    one = spark.createDataFrame([(1, "x", 0, 1_000_000)], "i int, g string, s int, e int")
    few = spark.createDataFrame([(n, "x", n * 90_000, n * 90_000 + 3) for n in range(10)], "j int, g string, t int, f int")
    level = one.withColumn("_level", spans._level("s", "e"))
    at = level.withColumn("_at", F.col("_level")).select(F.size(spans._buckets("s", "e"))).first()[0]
    assert at <= 2 and spans.overlapping(one, few, "g", ("s", "e"), ("t", "f")).count() == 10


def test_context_of_a_hot_name(spark):
    """A name that thousands call shows the bound and says that there is more; edges inside one hit are shown once."""
    known = spark.createDataFrame(
        [("hot", "s", "function", "f", "f", 1, 5), ("in", "s", "function", "g", "f.g", 2, 3), ("v", "s", "variable", "v", "f.v", 2, 2)]
        + [(f"c{n}", "t", "function", f"c{n}", f"c{n}", n, n) for n in range(10, 3010)],
        "entity_id string, source_id string, kind string, name string, qualified_name string, line_start int, line_end int",
    )
    edges = [(f"e{n}", "calls", f"c{n}", f"c{n}", "hot", "f", "import_static", "t", n) for n in range(10, 3010)]
    edges += [("inner", "calls", "in", "f.g", "hot", "f", "local_static", "s", 3), ("imp", "imports", "m", "", None, "os", "unresolved", "s", 1), ("con", "contains", "hot", "f", "in", "f.g", "syntax", "s", 2)]
    resolved = spark.createDataFrame(edges, "relationship_id string, kind string, from_id string, owner_name string, target_id string, target_name string, resolution string, source_id string, line_start int")
    files = spark.createDataFrame([("s", "parsed", "python", "1"), ("t", "truncated", "python", "1")], "source_id string, status string, language string, parser_version string")
    hits = spark.createDataFrame([("a", "s", 2, 2), ("b", "gone", 1, 9), ("c", "s", None, None), ("d", "t", 10, 10)], "hit string, source_id string, line_start int, line_end int")
    got = {r["hit"]: r for r in context.graph_context(hits, files, known, resolved, 3).collect()}
    assert [e["entity_id"] for e in got["a"]["entities"]] == ["in", "hot"] and not got["a"]["entities_more"]
    assert [(e["relationship_id"], e["orientation"]) for e in got["a"]["relationships"]] == [("inner", "outgoing"), ("e10", "incoming"), ("e11", "incoming")]
    assert got["a"]["relationships_more"] and got["a"]["truncated"] and [i["target_name"] for i in got["a"]["imports"]] == ["os"]
    assert got["b"]["status"] == "pending_or_stale" and not got["b"]["available"] and got["b"]["entities"] == []
    assert got["c"]["available"] and got["c"]["entities"] == [] and len(got["c"]["imports"]) == 1 and not got["c"]["truncated"]
    assert got["d"]["available"] and got["d"]["truncated"] and [e["relationship_id"] for e in got["d"]["relationships"]] == ["e10"]


def test_roots(spark):
    roots = spark.createDataFrame([("a", "/x"), ("b", "/x/y/"), ("c", "/x/y"), ("all", "/"), (None, "/z")], "root_key string, root_path string")
    files = spark.createDataFrame([("/x/m.py",), ("/x/y/m.py",), ("/x/yy/m.py",), ("/z/m.py",), ("m.py",), ("/x/m.py",)], "path string")
    got = sorted((r["path"], r["root_key"], r["relative_path"]) for r in with_roots(files, roots).collect())
    assert got == [
        ("/x/m.py", "a", "m.py"), ("/x/m.py", "a", "m.py"), ("/x/y/m.py", "b", "m.py"), ("/x/yy/m.py", "a", "yy/m.py"), ("/z/m.py", "all", "z/m.py"), ("m.py", None, "m.py"),
    ]
    assert with_roots(files, roots.limit(0)).filter("root_key is not null").count() == 0


def test_gate_and_backfill(spark):
    sources = spark.createDataFrame(
        [("s1", "h1", "indexed", None, "py"), ("s2", "h2", "indexed", None, "py"), ("s3", "h3", "indexed", None, "py"), ("s4", "h4", "indexed", None, "py"),
         ("s5", "h5", "failed", None, "py"), ("s6", "h6", "indexed", "x", "py"), ("s7", "h7", "indexed", None, "none")],
        "source_id string, content_hash string, status string, deleted_at string, language string",
    )
    results = spark.createDataFrame(
        [("s1", "h1", "2", 1), ("s1", "h1", "2", 5), ("s2", "h1", "2", 1), ("s3", "h3", "1", 1), ("s5", "h5", "2", 1), ("s6", "h6", "2", 1)],
        "source_id string, content_hash string, parser_version string, parsed_at int",
    )
    parsers = spark.createDataFrame([("py", "2")], "language string, parser_version string")
    assert [tuple(r) for r in gate.valid_results(results, sources, parsers).collect()] == [("s1", "h1", "2", 5)]
    asked = {r["source_id"]: r["reason"] for r in gate.backfill(results, sources, parsers).collect()}
    assert asked == {"s2": "changed", "s3": "older_parser", "s4": "unparsed"}
    assert gate.stale_results(results, sources, parsers).count() == 4


def plain_settled(held, writes):
    """One write after the other."""
    owner, out = {c: s for s, c in held}, {}
    mine = dict(held)
    for no, source, outcome, card in sorted(writes):
        if outcome == "invalid" or (outcome == "card" and owner.get(card, source) != source):
            out[no] = False
            continue
        if source in mine:
            del owner[mine.pop(source)]
        if outcome == "card":
            owner[card], mine[source] = source, card
        out[no] = True
    return out, mine


@pytest.mark.parametrize("seed", range(5))
def test_cards_in_order_of_their_writes(spark, seed):
    random_ = random.Random(seed)
    ids = [f"c{n}" for n in range(12)]
    held = list(zip((f"s{n}" for n in range(8)), random_.sample(ids, 8)))
    sources = random_.sample([f"s{n}" for n in range(14)], 12)
    writes = [(n, s, random_.choice(["card"] * 6 + ["not_card", "invalid"]), random_.choice(ids)) for n, s in enumerate(sources)]
    if seed == 4:
        # A chain: each source takes the id of the one that moved on just before.
        held = [(f"s{n}", f"c{n}") for n in range(6)]
        writes = [(n, f"s{n}", "card", f"c{n - 1}" if n else "new") for n in range(6)]
    writes = [(n, s, o, c if o == "card" else None) for n, s, o, c in writes]
    before = spark.createDataFrame(held, "source_id string, card_id string")
    batch = spark.createDataFrame(writes, "write_no long, source_id string, outcome string, card_id string")
    settled = cardstore.settle(before, batch)
    want, mine = plain_settled(held, writes)
    assert {r["write_no"]: r["accepted"] for r in settled.collect()} == want
    after, rejected = cardstore.merged(before, batch, settled)
    assert {r["source_id"]: r["card_id"] for r in after.collect()} == mine
    assert rejected.count() == sum(not ok for ok in want.values())


def test_unusable_vectors(spark):
    rows = [(1, "d", [1.0, 0.0]), (2, "d", [0.0, 0.0]), (3, "d", [1.0]), (4, "d", None), (5, "d", [float("nan"), 1.0]), (6, "d", [None, 1.0]), (7, "d", [float("inf"), 1.0])]
    frame = spark.createDataFrame(rows, "card_id int, field_type string, embedding array<double>")
    assert sorted(r["card_id"] for r in cardstore.unusable_vectors(frame, 2).collect()) == [2, 3, 4, 5, 6, 7]

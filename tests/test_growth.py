"""Steps whose cost once grew faster than their tables, on rows of their own."""

import contextlib
import io
import random
import re
import time

import numpy as np
from pyspark.sql import functions as F

from folionaut.llm import jaccard
from folionaut.llm.session import prepare
from folionaut.operators import bm25, context, spans, walks
from folionaut.operators.durable import FREED, durable
from folionaut.sources import cardfiles, extract, markup, nesting, pycode


def plan(frame):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        frame.explain()
    return out.getvalue()


def test_sides_of_an_overlap_join_are_not_broadcast(spark):
    left = spark.range(50).select(F.lit("f").alias("on"), F.col("id").cast("int").alias("s"), (F.col("id") + 3).cast("int").alias("e"))
    right = left.toDF("on", "rs", "re")
    found = spans.overlapping(left, right, "on", ("s", "e"), ("rs", "re"))
    assert "Broadcast" not in plan(found)
    assert found.count() == sum(abs(a - b) <= 3 for a in range(50) for b in range(50))


def test_context_of_hits_broadcasts_nothing(spark):
    hits = spark.createDataFrame([("h", "s", 1, 3)], "hit string, source_id string, line_start int, line_end int")
    files = spark.createDataFrame([("s", "parsed", "python", "1")], "source_id string, status string, language string, parser_version string")
    known = spark.createDataFrame([("e", "s", "class", "A", "A", 1, 2)], "entity_id string, source_id string, kind string, name string, qualified_name string, line_start int, line_end int")
    resolved = spark.createDataFrame(
        [("r", "calls", "e", "A", None, "x", "unresolved", "s", 2)],
        "relationship_id string, kind string, from_id string, owner_name string, target_id string, target_name string, resolution string, source_id string, line_start int",
    )
    found = context.graph_context(hits, files, known, resolved, 2)
    assert "Broadcast" not in plan(found)
    (row,) = found.collect()
    assert [e["entity_id"] for e in row["entities"]] == ["e"] and [e["relationship_id"] for e in row["relationships"]] == ["r"]


def test_walks_compute_the_edges_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(value):
        seen.add(1)
        return value

    rows = [(f"r{n}", f"e{n}", f"e{n + 1}", "s", n, "calls") for n in range(6)]
    edges = spark.createDataFrame(rows, "relationship_id string, from_id string, target_id string, source_id string, line_start int, observed_kind string")
    edges = edges.withColumn("target_id", counted("target_id"))
    seeds = spark.createDataFrame([("a", "e0"), ("b", "e2")], "seed string, entity_id string")
    found = walks.walk_all(edges, seeds, "outgoing", ("calls",), 3, 10)
    assert found.reached.count() == 8 and seen.value == len(rows)


def test_syntax_of_few_files_is_held_at_once(spark):
    text = "def f():\n    g()\n"
    files = [(str(n), text if n % 7 else None if n % 2 else text * 40, f"m{n}.py", f"m{n}") for n in range(3 * pycode.FILES_AT_ONCE)]
    rows = spark.createDataFrame([f for f in files if f[1] is not None], "source_id string, text string, path string, module_key string").coalesce(1)
    sizes = pycode.parse_python(rows).select("source_id", F.size("entities").alias("n")).collect()
    assert sorted((r["source_id"], r["n"]) for r in sizes) == sorted((f[0], 1 + f[1].count("def")) for f in files if f[1] is not None)
    import pyarrow as pa

    pieces = list(pycode._pieces(pa.array([text] * 700 + ["x" * (2 * pycode.TEXT_AT_ONCE), None, ""])))
    assert [a for a, _ in pieces][1:] == [b for _, b in pieces][:-1] and pieces[0][0] == 0 and pieces[-1][1] == 703
    assert max(b - a for a, b in pieces) <= pycode.FILES_AT_ONCE and (700, 701) in pieces


def test_meetings_of_a_group_are_few(spark):
    """Near copies meet in many buckets; the edges that connect them are not all they could make."""
    draw = random.Random(3)
    base = [f"w{n}" for n in range(400)]
    texts = []
    for n in range(120):
        own = list(base)
        own[draw.randrange(400)] = f"x{n}"
        texts.append((n, " ".join(own)))
    prepare(spark)
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    edges = [(r["a"], r["b"]) for r in jaccard.meetings(docs, 4, 85, 400 * 120).collect()]
    assert len(edges) <= min(jaccard.partitions(spark), jaccard.MEETING_TASKS) * (len(texts) - 1)
    few = [(r["a"], r["b"]) for r in jaccard.meetings(docs.coalesce(1), 4, 85, 40 * jaccard.BUCKET).coalesce(1).collect()]
    forest = jaccard.Forest()
    for found in (edges, few):
        assert len(jaccard.Forest().add(np.array(found))) == len(texts) - 1
    assert len(forest.add(np.array(edges))) == len(texts) - 1 and len(forest.add(np.array(few))) == 0


def test_a_forest_connects_what_all_edges_connect():
    draw = random.Random(4)
    lots = [np.array([sorted(draw.sample(range(0, 900, 3), 2)) for _ in range(60)]) for _ in range(6)]
    forest, kept = jaccard.Forest(), []
    for lot in lots:
        kept.append(forest.add(lot))

    def groups(edges):
        label = {x: x for x in range(0, 900, 3)}
        for a, b in edges.tolist():
            low, high = sorted((label[a], label[b]))
            label = {x: low if y == high else y for x, y in label.items()}
        return label

    kept = np.concatenate(kept)
    assert groups(kept) == groups(np.concatenate(lots))
    assert len(kept) == len(set(range(0, 900, 3))) - len(set(groups(kept).values()))


def test_readers_run_once_however_their_blocks_are_used(spark):
    rows = spark.range(20).select("id", F.concat(F.lit("# a\n\ntext "), F.col("id").cast("string")).alias("text")).repartition(3, "id")
    read = extract.extract_blocks(rows.select("id", F.col("text").cast("binary").alias("content"), F.lit("md").alias("extension")))
    marked = rows.select("id", markup.markdown_blocks(F.col("text")).alias("blocks"))
    for frame in (read, marked):
        blocks = frame.select("id", F.posexplode("blocks").alias("place", "b")).select("id", "place", "b.text")
        assert plan(blocks).count("ArrowEvalPython") == 1
        assert blocks.count() == 40


def test_a_card_is_read_once(monkeypatch):
    texts = ["a: 1\nb: [x, 'y']\n", "", "a: &n x\nb: *n\n", "a: x * y\n", "a: 1\na: 2\n", "d: 2020-01-01\n", "x: [", "- 1\n- {k: null}\n", "m: {<<: {q: 1}, z: 2}\n"]
    want = [cardfiles.yaml_to_json(text) for text in texts]
    monkeypatch.setattr(cardfiles.yaml, "safe_load", None)
    monkeypatch.setattr(cardfiles.yaml, "load", None)
    assert [cardfiles.yaml_to_json(text) for text in texts] == want
    assert [value for value, _ in want] == [
        '{"a": 1, "b": ["x", "y"]}', "null", None, '{"a": "x * y"}', None, '{"d": {"other": "2020-01-01"}}', None, '[1, {"k": null}]', want[8][0],
    ]


def test_postings_shuffle_no_words(spark):
    """Rows that share their key still meet, with and without other rows; null keys are one key."""
    texts = [(1, "b a b"), (2, None), (3, "a"), (4, "c c A"), (None, "b x")]
    ddl = "seq long, text string"
    once = bm25.postings(spark.createDataFrame(texts, ddl), ("text",))
    assert "Exchange" not in plan(once)

    def listed(frame):
        return sorted(((r["seq"], r["length"], r["term"], r["tf"], r["positions"]) for r in frame.collect()), key=str)

    want = [(1, 3, "a", 1, [1]), (1, 3, "b", 2, [0, 2]), (3, 1, "a", 1, [0]), (4, 3, "a", 1, [2]), (4, 3, "c", 2, [0, 1]), (None, 2, "b", 1, [0]), (None, 2, "x", 1, [1])]
    assert listed(once) == sorted(want, key=str)
    again = [*texts, (1, "b a b"), (1, "b"), (None, "b x")]
    got = listed(bm25.postings(spark.createDataFrame(again, ddl), ("text",)))
    more = {(1, 3, "a"): (2, [1, 1]), (1, 3, "b"): (4, [0, 0, 2, 2]), (None, 2, "b"): (2, [0, 0]), (None, 2, "x"): (2, [1, 1])}
    assert got == sorted([(*w[:3], *more.get(w[:3], w[3:])) for w in want] + [(1, 1, "b", 1, [0])], key=str)


def test_overlap_summary_equals_all_pairs(spark):
    draw = random.Random(6)

    def rows(count, longest):
        made = []
        for n in range(count):
            start = draw.randrange(200)
            made.append((draw.choice(["a", "b", None]), start, start + draw.choice([0, 1, 7, longest, -1]), draw.choice([n, None]) if n % 9 == 0 else n))
        return [*made, *made[:5], ("a", None, 3, 1), ("a", 3, None, 2)]

    left, right = rows(150, 90), rows(200, 300)
    frames = [spark.createDataFrame(r, f"grp string, {s} int, {e} int, {i} long") for r, s, e, i in ((left, "s", "e", "l"), (right, "rs", "re", "r"))]
    found = spans.overlap_summary(*frames, "grp", ("s", "e"), ("rs", "re"), "r")
    assert "_at" not in found.columns
    want = []
    for g, s, e, i in left:
        near = [r for h, rs, re, r in right if None not in (g, s, e, rs, re) and g == h and s <= e and rs <= re and s <= re and e >= rs]
        known = [r for r in near if r is not None]
        if near:
            want.append((g, s, e, i, len(near), min(known, default=None), max(known, default=None)))
    got = [(r["grp"], r["s"], r["e"], r["l"], r["met"], r["low"], r["high"]) for r in found.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    # Many equal spans are many pairs, but few rows on the way.
    same = spark.range(3000).select(F.lit("g").alias("grp"), F.lit(5).alias("s"), F.lit(9).alias("e"), "id")
    every = spans.overlap_summary(same, same.toDF("grp", "rs", "re", "r"), "grp", ("s", "e"), ("rs", "re"), "r")
    assert every.groupBy("met", "low", "high").count().collect() == [(3000, 0, 2999, 3000)]


def test_tokens_of_a_file_are_not_shuffled(spark):
    """Texts are dealt out once; files given twice, without an id or with odd brackets keep their declarations."""
    nested = "class A {\n  void a() {\n    class B {\n      int b() {\n      }\n    }\n  }\n}\n"
    odd = "}\nclass C {\n}\n}\nclass D {\n  int d() {\n"
    texts = [("f", nested), ("t", "class E {\n}\n"), ("t", "class E {\n}\n"), ("o", odd), (None, "class F {\n  int f() {\n  }\n}\n"), ("n", None), ("e", "")]
    files = spark.createDataFrame(texts, "source_id string, text string").select(
        "source_id", F.lit("r").alias("root_key"), F.lit("p").alias("path"), F.lit("m").alias("module_key"), F.lit("java").alias("language"), "text"
    )
    declared = nesting.declarations(files)
    steps = plan(declared)
    assert steps.count("Exchange ") == 1 and "Join" not in steps and steps.count("Generate posexplode(regexp_extract_all") == 1
    got = [(r["source_id"], r["kind"], r["qualified_name"], r["ordinal"], r["line_start"], r["line_end"], r["parent_name"]) for r in declared.collect()]
    assert sorted(got, key=str) == sorted([
        ("f", "class", "A", 0, 1, 8, ""), ("f", "method", "A.a", 0, 2, 7, "A"), ("f", "class", "A.a.B", 0, 3, 6, "A.a"), ("f", "method", "A.a.B.b", 0, 4, 5, "A.a.B"),
        ("o", "class", "C", 0, 2, 3, ""), ("o", "class", "D", 0, 5, 5, ""), ("o", "function", "d", 0, 6, 6, ""),
        ("t", "class", "E", 0, 1, 3, ""), ("t", "class", "E", 1, 1, 3, ""), (None, "class", "F", 0, 1, 4, ""), (None, "function", "f", 0, 2, 3, ""),
    ], key=str)


def test_what_a_kept_table_shuffled_goes_with_it(spark):
    """Shuffle files otherwise stay until the driver collects its garbage."""

    def shuffled():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return set(re.findall(r"shuffle_\d+_\d+_\d+\.data", files.mkString(" ")))

    before, setting = shuffled(), spark.conf.get(FREED, None)
    rows = spark.range(5000).groupBy((F.col("id") % 1000).alias("key")).count()
    kept = durable(rows.repartition(5, "count", "key"))
    for _ in range(50):
        if not shuffled() - before:
            break
        time.sleep(0.2)
    assert not shuffled() - before
    assert spark.conf.get(FREED, None) == setting
    assert kept.count() == 1000 and rows.count() == 1000 and durable(rows).count() == 1000

"""Resolution rules on small code bases; the collection store and its stream."""

import pytest
from pyspark.sql import functions as F

from folionaut.functions import names
from folionaut.functions.embedding import HashEmbedder
from folionaut.operators import graph, traverse
from folionaut.operators.durable import durable
from folionaut.plans.requests import GraphRequest, SearchRequest
from folionaut.plans.search import search
from folionaut.plans.store import Collection
from folionaut.settings import FolioError
from folionaut.sources.listing import read_files
from folionaut.sources.pycode import parse_python
from folionaut.streaming.ingest import watch_folder


def code_base(spark, files):
    frame = spark.createDataFrame(list(files.items()), "path string, text string")
    language = names.language(F.col("path"))
    rows = frame.select(F.col("path").alias("source_id"), F.lit("r").alias("root_key"), "path", language.alias("language"), names.module_key(F.col("path"), language).alias("module_key"), "text")
    parsed = durable(parse_python(rows))
    known = durable(graph.entities(parsed))
    return parsed, known, durable(graph.resolve(durable(graph.observed_edges(parsed)), known))


def calls(known, edges, kind="calls"):
    target = known.select(F.col("entity_id").alias("target_id"), F.concat_ws(":", "source_id", "qualified_name").alias("t"))
    rows = edges.filter(F.col("kind") == kind).join(target, "target_id", "left").collect()
    return {(r["source_id"], r["owner_name"], r["target_name"]): (r["t"], r["resolution"]) for r in rows}


def test_alias_shadow_ambiguity_and_class_scope(spark):
    files = {
        "helpers.py": "def helper():\n    return 1\n",
        "pkg/__init__.py": "",
        "pkg/base.py": "class Base:\n    pass\n",
        "pkg/sub.py": "from .base import Base\nfrom . import base as b\nclass Sub(Base, b.Base, metaclass=Meta):\n    pass\n",
        "main.py": "from helpers import helper as load\nimport helpers\n\ndef run():\n    load()\n    helpers.helper()\n\ndef other(load):\n    load()\n    load.x()\n\n"
        "def same():\n    pass\n\ndef same():\n    same()\n\ndef a():\n    b()\n\ndef b():\n    a()\n\nclass C:\n    def helper(self):\n        pass\n\n    def go(self):\n        helper()\n        self.helper()\n",
        "broken.py": "def (",
    }
    parsed, known, edges = code_base(spark, files)
    found = calls(known, edges)
    assert found["main.py", "run", "load" if ("main.py", "run", "load") in found else "helpers.helper"][1] == "import_static"
    by_owner = {}
    for (source, owner, _), value in found.items():
        by_owner.setdefault((source, owner), []).append(value)
    assert sorted(by_owner["main.py", "run"]) == [("helpers.py:helper", "import_static")] * len(by_owner["main.py", "run"])
    assert all(value == (None, "unresolved") for value in by_owner["main.py", "other"])
    assert by_owner["main.py", "same"] == [(None, "ambiguous")]
    assert by_owner["main.py", "a"] == [("main.py:b", "local_static")] and by_owner["main.py", "b"] == [("main.py:a", "local_static")]
    assert sorted(by_owner["main.py", "C.go"], key=str) == [("main.py:C.helper", "local_static"), (None, "unresolved")]
    bases = calls(known, edges, "inherits")
    assert {value for value in bases.values()} == {("pkg/base.py:Base", "import_static")} and len(bases) >= 1
    assert {r["source_id"]: r["status"] for r in parsed.collect()}["broken.py"] == "parse_error"

    callers = traverse.traverse(known, edges, GraphRequest("callers", symbol="helpers.helper"))
    assert callers["status"] == "ok" and {e["owner_name"] for e in callers["relationships"]} == {"run"}
    cycle = traverse.traverse(known, edges, GraphRequest("callees", symbol="a", depth=5))
    assert len(cycle["relationships"]) == 2 and [e["name"] for e in cycle["entities"]] == ["a", "b"] and not cycle["truncated"]
    assert [len(chain) for chain in cycle["chains"]] == [1, 2]
    limited = traverse.traverse(known, edges, GraphRequest("neighbors", symbol="main.C", direction="both", depth=2, limit=1))
    assert limited["truncated"] and len(limited["relationships"]) == 1
    assert traverse.traverse(known, edges, GraphRequest("callers", symbol="same"))["status"] == "ambiguous"
    assert traverse.traverse(known, edges, GraphRequest("callers", symbol="nowhere"))["status"] == "not_found"
    everything = traverse.traverse(known, edges, GraphRequest("find", symbol="HELP"))
    assert {e["name"] for e in everything["candidates"]} >= {"helper", "helpers.py"}
    with pytest.raises(FolioError):
        GraphRequest("callers")


def test_only_current_parse_results_count(spark):
    parsed = spark.createDataFrame([("a", "h1", "v1"), ("b", "h2", "v1"), ("c", "h3", "v0"), ("d", "h4", "v1")], "source_id string, content_hash string, parser_version string")
    sources = spark.createDataFrame(
        [("a", "h1", "indexed", None), ("b", "other", "indexed", None), ("c", "h3", "indexed", None), ("d", "h4", "failed", None)],
        "source_id string, content_hash string, status string, deleted_at timestamp",
    )
    assert [r["source_id"] for r in graph.current_sources(parsed, sources, "v1").collect()] == ["a"]


def test_overlaps_equal_brute_force(spark):
    import random

    rng = random.Random(2)
    # One source holds a third of all spans.
    def spans(n):
        out = []
        for i in range(n):
            start = rng.randint(1, 900)
            out.append(("hot" if i % 3 == 0 else f"s{i % 5}", i, start, start + rng.randint(0, 300)))
        return out

    left, right = spans(120), spans(90)
    expected = sorted((a[1], b[1]) for a in left for b in right if a[0] == b[0] and a[2] <= b[3] and a[3] >= b[2])
    one = spark.createDataFrame(left, "source_id string, a int, s int, e int")
    two = spark.createDataFrame(right, "source_id string, b int, rs int, re int")
    got = graph.overlapping(one, two, "source_id", ("s", "e"), ("rs", "re")).select("a", "b").collect()
    assert sorted((r["a"], r["b"]) for r in got) == expected


def test_reachability_stops_at_the_depth(spark):
    edges = spark.createDataFrame([("calls", f"n{i}", f"n{i + 1}") for i in range(6)] + [("calls", "n3", "n0")], "kind string, from_id string, target_id string")
    seeds = spark.createDataFrame([("n0",)], "entity_id string")
    found = {r["entity_id"]: r["depth"] for r in traverse.reachable(edges, seeds, "outgoing", ("calls",), 4).collect()}
    assert found == {"n0": 0, "n1": 1, "n2": 2, "n3": 3, "n4": 4}
    back = traverse.reachable(edges, spark.createDataFrame([("n1",)], "entity_id string"), "incoming", ("calls",), 2)
    assert {r["entity_id"] for r in back.collect()} == {"n1", "n0", "n3"}


def names_of(collection, query, mode="keyword"):
    return [r["source_filename"] for r in search(collection.tables(), SearchRequest(query, mode), embedder=collection.embedder).results.collect()]


def test_collection_follows_its_files(spark, tmp_path):
    folder = tmp_path / "files"
    folder.mkdir()
    (folder / "a.md").write_text("# Offer\n\nA red lamp. Price: €25, rating 4.5.\n")
    (folder / "b.txt").write_text("blue chair price $30\nsecond line chair\n")
    (folder / "c.bin").write_bytes(b"\x00\x01")
    (folder / "d.docx").write_bytes(b"broken")
    (folder / ".hidden.txt").write_text("lamp")
    collection = Collection(spark, str(tmp_path / "store"), HashEmbedder())
    files = read_files(spark, str(folder))
    assert collection.index(files) == {"new": 3, "unsupported": 1}
    assert collection.index(files) == {"unchanged": 2, "previously_failed": 1, "unsupported": 1}
    status = {r["filename"]: (r["status"], r["version"]) for r in collection.sources().collect()}
    assert status == {"a.md": ("indexed", 1), "b.txt": ("indexed", 1), "c.bin": ("unsupported", 0), "d.docx": ("failed", 0)}
    assert names_of(collection, "chair") == ["b.txt"] and set(names_of(collection, "lamp chair", "hybrid")) == {"a.md", "b.txt"}

    before = {r["filename"]: r["source_id"] for r in collection.sources().collect()}
    (folder / "b.txt").write_text("green table\n")
    assert collection.index(read_files(spark, str(folder)))["changed"] == 1
    after = {r["filename"]: r for r in collection.sources().collect()}
    assert after["b.txt"]["source_id"] == before["b.txt"] and after["b.txt"]["version"] == 2
    assert names_of(collection, "chair") == [] and names_of(collection, "table") == ["b.txt"]
    assert collection.current("vectors").count() == collection.current("chunks").count() == 2

    collection.compact()
    assert set(names_of(collection, "table lamp")) == {"a.md", "b.txt"}
    (folder / "b.txt").unlink()
    collection.prune_missing(read_files(spark, str(folder)), str(folder))
    assert {r["filename"]: r["status"] for r in collection.sources().collect()}["b.txt"] == "missing"
    assert names_of(collection, "table lamp") == ["a.md"]
    collection.remove([after["a.md"]["source_id"]])
    assert names_of(collection, "table lamp") == []


def test_a_failed_reindex_keeps_the_statistics_rows(spark, tmp_path):
    folder = tmp_path / "files"
    folder.mkdir()
    (folder / "a.docx").write_bytes(b"")
    (folder / "a.md").write_text("lamp one")
    (folder / "b.md").write_text("lamp two three")
    collection = Collection(spark, str(tmp_path / "store"), HashEmbedder())
    collection.index(read_files(spark, str(folder)))
    failed = collection.sources().withColumn("status", F.when(F.col("filename") == "b.md", "failed").otherwise(F.col("status")))
    collection._commit_sources(durable(failed))
    tables = collection.tables()
    assert tables.statistics.first()["rows"] == 2 and names_of(collection, "lamp") == ["a.md"]


def test_stream_indexes_new_files_once(spark, tmp_path):
    folder, checkpoint = tmp_path / "in", str(tmp_path / "checkpoint")
    folder.mkdir()
    (folder / "a.md").write_text("first lamp")
    collection = Collection(spark, str(tmp_path / "store"), HashEmbedder())
    for _ in range(2):
        watch_folder(collection, str(folder), checkpoint, once=True).awaitTermination(120)
        assert names_of(collection, "lamp") == ["a.md"]
    (folder / "b.md").write_text("second lamp")
    watch_folder(collection, str(folder), checkpoint, once=True).awaitTermination(120)
    assert set(names_of(collection, "lamp")) == {"a.md", "b.md"} and collection.current("chunks").count() == 2


def test_source_code_collection_has_a_graph(spark, tmp_path):
    folder = tmp_path / "code"
    (folder / "pkg").mkdir(parents=True)
    (folder / "pkg" / "helpers.py").write_text("def helper():\n    return 1\n")
    (folder / "main.py").write_text("from pkg.helpers import helper as load\n\ndef run():\n    return load()\n")
    (folder / "view.ts").write_text("export function show(x) {\n  draw(x);\n}\nfunction draw(y) {\n}\n")
    (folder / "notes").write_text("plain words without a suffix\n")
    collection = Collection(spark, str(tmp_path / "store"), HashEmbedder(), kind="source_code")
    assert collection.index(read_files(spark, str(folder))) == {"new": 4}
    known, edges = collection.graph()
    found = traverse.traverse(known, edges, GraphRequest("callers", symbol="helper"))
    assert [e["owner_name"] for e in found["relationships"]] == ["run"] and found["relationships"][0]["resolution"] == "import_static"
    assert traverse.traverse(known, edges, GraphRequest("callees", symbol="show"))["entities"][1]["name"] == "draw"
    context = traverse.context_of_chunks(collection.current("chunks"), known, 5)
    assert {"run", "helper", "show"} <= {r["qualified_name"] for r in context.collect()}
    assert names_of(collection, "suffix") == ["notes"]


def test_operations_of_a_collection(spark, tmp_path):
    import base64

    collection = Collection(spark, str(tmp_path / "store"), HashEmbedder())
    with pytest.raises(FolioError):
        collection.tables()
    assert collection.upload("note.md", base64.b64encode(b"# Lamp\n\nred lamp lamps").decode()) == {"new": 1}
    with pytest.raises(FolioError):
        collection.upload("../x.md", "")
    assert collection.describe()["counts"] == {"sources": 1, "indexed_sources": 1, "failed_sources": 0, "chunks": 1}
    assert [r["term"] for r in collection.list_keywords("LAM").collect()] == ["lamp", "lamps"]
    assert [r["filename"] for r in collection.list_files(extension="md").collect()] == ["note.md"]
    assert [(r["status"], r["total"], r["completed"]) for r in collection.jobs().collect()] == [("completed", 1, 1)]
    collection.export_manifest(str(tmp_path / "manifest"))
    assert spark.read.json(str(tmp_path / "manifest")).first()["filename"] == "note.md"
    with pytest.raises(FolioError):
        collection.delete()
    collection.delete(confirm=True)
    assert collection.sources().count() == 0

"""Nested scopes, members and bases from bracket depth."""

from pyspark.sql import functions as F

from folionaut.functions import names
from folionaut.operators import graph
from folionaut.operators.durable import durable
from folionaut.sources import nesting, outline

FILES = {
    "lib/base.ts": "export interface Shape<T extends Map<string, T>> {\n  draw(): void\n}\nexport class Base {\n}\n",
    "app/main.ts": (
        "import { Base as B, Shape } from '../lib/base'\n// class No {\nclass Outer extends B implements Shape<Map<string, number>>, Gone {\n"
        "  text = `{ class Fake {`\n  run(a: number): void {\n    if (a) { this.run(a) }\n    function inner() {\n    }\n  }\n}\nfunction last() {\n}\nclass Open {\n"
    ),
    "a/One.java": "package p;\nclass One extends Two {\n  /* } \n } */\n  class In implements Face {\n    void go(int a) throws E {\n    }\n    void go(long a) {\n    }\n  }\n}\n",
    "b/Two.java": "package p;\nclass Two {\n  String s = \"\\\"{\";\n}\ninterface Face {\n}\n",
    "empty.java": "", "null.java": None, "plain.py": "class A:\n  pass\n",
}


def test_scopes_members_and_bases(spark):
    frame = spark.createDataFrame(list(FILES.items()), "path string, text string")
    kind = names.language(F.col("path"))
    files = outline.with_package(frame.select(
        F.col("path").alias("source_id"), F.lit("r").alias("root_key"), "path", kind.alias("language"), names.module_key(F.col("path"), kind).alias("module_key"), "text"
    ))
    declared = durable(nesting.declarations(files))
    rows = {(r["source_id"], r["kind"], r["qualified_name"], r["ordinal"]): (r["line_start"], r["line_end"]) for r in declared.collect()}
    assert rows == {
        ("lib/base.ts", "interface", "Shape", 0): (1, 3), ("lib/base.ts", "class", "Base", 0): (4, 5),
        ("app/main.ts", "class", "Outer", 0): (3, 10), ("app/main.ts", "method", "Outer.run", 0): (5, 9),
        ("app/main.ts", "function", "Outer.run.inner", 0): (7, 8), ("app/main.ts", "function", "last", 0): (11, 12), ("app/main.ts", "class", "Open", 0): (13, 13),
        ("a/One.java", "class", "One", 0): (2, 11), ("a/One.java", "class", "One.In", 0): (5, 10),
        ("a/One.java", "method", "One.In.go", 0): (6, 7), ("a/One.java", "method", "One.In.go", 1): (8, 9),
        ("b/Two.java", "class", "Two", 0): (2, 4), ("b/Two.java", "interface", "Face", 0): (5, 6),
    }
    found = graph.resolve(durable(nesting.edges(files, declared)), declared)
    target = declared.select(F.col("entity_id").alias("target_id"), F.concat_ws(":", "source_id", "qualified_name").alias("t"))
    edges = found.join(target, "target_id", "left").select("owner_name", "kind", "t", "resolution", "target_name").collect()
    assert {(e["owner_name"], e["kind"], e["t"] or e["target_name"], e["resolution"]) for e in edges if e["kind"] != "contains"} == {
        ("Outer", "inherits", "lib/base.ts:Base", "import_static"), ("Outer", "implements", "lib/base.ts:Shape", "import_static"),
        ("Outer", "type_base", "Gone", "unresolved"), ("One", "inherits", "b/Two.java:Two", "import_static"), ("One.In", "implements", "b/Two.java:Face", "import_static"),
    }
    inside = [(e["owner_name"], e["t"]) for e in edges if e["kind"] == "contains"]
    assert len(inside) == len(rows) and ("Outer.run", "app/main.ts:Outer.run.inner") in inside and ("", "b/Two.java:Face") in inside

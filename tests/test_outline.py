"""Outlines of languages without a parser: declarations, imports and resolved calls across files."""

import pytest
from pyspark.sql import functions as F

from folionaut.functions import names
from folionaut.operators import graph
from folionaut.operators.durable import durable
from folionaut.sources import outline

# language: files, then the expected (owner, target, resolution) of the calls to the helper
BASES = {
    "javascript": ({"lib/help.js": "export function helper() {\n  return 1\n}\n", "app/main.js": "import { helper as load, x } from '../lib/help'\nimport y from 'react'\nfunction run() {\n  if (load()) { y.z() }\n}\n"},
                   ("run", "lib/help.js:helper", "import_static")),
    "typescript": ({"help.ts": "export function helper(a: int) {\n}\n", "main.ts": "import * as h from './help';\nfunction run() {\n  h.helper();\n}\n"}, ("run", "help.ts:helper", "import_static")),
    "rust": ({"src/help.rs": "pub fn helper() {\n}\n", "src/main.rs": "use crate::help::{helper as load, other};\nfn run() {\n    load();\n}\n"}, ("run", "src/help.rs:helper", "import_static")),
    "java": ({"a/Help.java": "package util;\nclass Help {\n}\n", "b/Main.java": "package app;\nimport util.Help;\nclass Main {\n  int x = Help(1);\n}\n"}, ("Main", "a/Help.java:Help", "import_static")),
    "c_sharp": ({"Help.cs": "class Help {\n}\n", "Main.cs": "using H = Help.Help;\nclass Main {\n  int x = H(1);\n}\n"}, ("Main", "Help.cs:Help", "import_static")),
    "go": ({"util/help.go": "package util\nfunc helper() {\n}\n", "util/main.go": "package util\nimport (\n\t\"fmt\"\n\tq \"a/b\"\n)\nfunc run() {\n\thelper()\n\tfmt.Println()\n}\n"},
           ("run", "util/help.go:helper", "package_static")),
    "c": ({"inc/help.h": "int helper(int a) {\n}\n", "main.c": "#include \"inc/help.h\"\n#include <stdio.h>\nint helper2(int a) {\n}\nint run(int a) {\n  helper2(a);\n}\n"}, ("run", "main.c:helper2", "local_static")),
}


@pytest.mark.parametrize("language", sorted(BASES))
def test_calls_resolve_across_files(spark, language):
    files, expected = BASES[language]
    frame = spark.createDataFrame(list(files.items()), "path string, text string")
    kind = names.language(F.col("path"))
    rows = outline.with_package(
        frame.select(F.col("path").alias("source_id"), F.lit("r").alias("root_key"), "path", kind.alias("language"), names.module_key(F.col("path"), kind).alias("module_key"), "text")
    )
    known, edges = durable(outline.entities(rows)), durable(outline.edges(rows))
    resolved = graph.resolve(edges, known)
    target = known.select(F.col("entity_id").alias("target_id"), F.concat_ws(":", "source_id", "qualified_name").alias("t"))
    found = resolved.join(target, "target_id", "left").select("kind", "owner_name", "t", "resolution", "target_mode").collect()
    assert expected in {(r["owner_name"], r["t"], r["resolution"]) for r in found if r["kind"] == "calls"}
    if language == "c":
        assert ("", "inc/help.h:", "include_static") in {(r["owner_name"], r["t"], r["resolution"]) for r in found if r["kind"] == "depends_on"}
    if language == "javascript":
        modes = {(r["t"], r["target_mode"]) for r in found if r["kind"] == "depends_on"}
        assert ("lib/help.js:", "qualified") in modes and (None, "external") in modes

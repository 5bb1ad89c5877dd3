"""A code base written from the customers table: one module each, calling into the next one."""

from __future__ import annotations

from pyspark.sql import functions as F

from folionaut.functions import names
from folionaut.functions.text import stable_id
from folionaut.operators import graph, traverse, walks
from folionaut.operators.chunking import chunk_documents
from folionaut.operators.durable import durable
from folionaut.sources.plaintext import code_blocks
from folionaut.sources.pycode import parse_python
from suite.registry import query, table

# Module k imports its neighbour k + 1 (the last one: a module that does not exist).
CODE = """import os
from pkg{g1}.mod{n} import helper as dep, Base{n} as Parent


class Base{k}(Parent):
    def run(self, os):
        os.path()
        return self.step(dep)

    def step(self, value):
        return helper(value)


def helper(x):
    def inner(y):
        return dep(y)

    return inner(x)


def twin():
    return 1


def twin():
    return twin()
"""


def modules(spark, folder):
    customer = table(spark, folder, "customer", "c_custkey")
    k = F.col("c_custkey")
    n = k + 1
    text = F.lit(CODE)
    for mark, value in (("{g1}", n % 7), ("{n}", n), ("{k}", k)):
        text = F.replace(text, F.lit(mark), value.cast("string"))
    path = F.concat(F.lit("pkg"), (k % 7).cast("string"), F.lit("/mod"), k.cast("string"), F.lit(".py"))
    return customer.select(
        k.alias("k"), path.alias("source_id"), F.lit("root").alias("root_key"), path.alias("path"),
        names.language(path).alias("language"), names.module_key(path, names.language(path)).alias("module_key"), text.alias("text"),
    )


def parsed(spark, folder):
    return parse_python(modules(spark, folder))


def resolved(spark, folder, kinds=None):
    """Entities, and their edges resolved: those of the observed ``kinds``, or all. An edge is resolved without regard to others."""
    rows = durable(parsed(spark, folder))
    known, edges = durable(graph.entities(rows)), graph.observed_edges(rows)
    return known, graph.resolve(durable(edges.filter(F.col("kind").isin(*kinds)) if kinds else edges), known)


MODULES_SQL = """
mods AS (
  SELECT c_custkey AS k, 'pkg' || c_custkey % 7 || '/mod' || c_custkey || '.py' AS source_id,
         EXISTS (SELECT 1 FROM customer n WHERE n.c_custkey = c.c_custkey + 1) AS has_next,
         'pkg' || (c_custkey + 1) % 7 || '/mod' || (c_custkey + 1) || '.py' AS next_id FROM customer c)"""


@query(
    "graph_entities",
    "WITH" + MODULES_SQL + """,
shape(kind, name, qualified_name, line_start, line_end) AS (VALUES
  ('module', NULL, '', 1, 25), ('class', 'Base', 'Base', 5, 11), ('method', 'run', 'Base.run', 6, 8), ('parameter', 'self', 'Base.run.self', 6, 6),
  ('parameter', 'os', 'Base.run.os', 6, 6), ('method', 'step', 'Base.step', 10, 11), ('parameter', 'self', 'Base.step.self', 10, 10),
  ('parameter', 'value', 'Base.step.value', 10, 10), ('function', 'helper', 'helper', 14, 18), ('parameter', 'x', 'helper.x', 14, 14),
  ('function', 'inner', 'helper.inner', 15, 16), ('parameter', 'y', 'helper.inner.y', 15, 15), ('function', 'twin', 'twin', 21, 22), ('function', 'twin', 'twin', 25, 26))
SELECT source_id, kind, coalesce(replace(name, 'Base', 'Base' || k), source_id) AS name, replace(qualified_name, 'Base', 'Base' || k) AS qualified_name,
       line_start::INTEGER AS line_start, (CASE kind WHEN 'module' THEN 26 ELSE line_end END)::INTEGER AS line_end FROM mods, shape""",
)
def graph_entities(spark, folder):
    return graph.entities(parsed(spark, folder)).select("source_id", "kind", "name", "qualified_name", "line_start", "line_end")


@query(
    "graph_resolved_calls",
    "WITH" + MODULES_SQL + """,
calls(owner, line, target, kind) AS (VALUES
  ('Base.run', 7, 'none', 'local'), ('Base.run', 8, 'Base.step', 'local_static'), ('Base.step', 11, 'helper', 'local_static'),
  ('helper.inner', 16, 'next', 'import_static'), ('helper', 18, 'helper.inner', 'local_static'), ('twin', 26, 'many', 'ambiguous'))
SELECT source_id, replace(owner, 'Base', 'Base' || k) AS owner_name, line::INTEGER AS line_start,
  CASE target WHEN 'none' THEN NULL WHEN 'many' THEN NULL WHEN 'next' THEN CASE WHEN has_next THEN next_id || ':helper' END
    ELSE source_id || ':' || replace(target, 'Base', 'Base' || k) END AS target,
  CASE WHEN target = 'none' OR (target = 'next' AND NOT has_next) THEN 'unresolved' ELSE kind END AS resolution FROM mods, calls""",
)
def graph_resolved_calls(spark, folder):
    known, edges = resolved(spark, folder, ("calls",))
    target = known.select(
        F.col("entity_id").alias("target_id"), F.concat_ws(":", F.col("source_id"), F.col("qualified_name")).alias("target")
    )
    calls = edges.filter(F.col("kind") == "calls").join(target, "target_id", "left")
    return calls.select("source_id", "owner_name", "line_start", "target", "resolution")


@query(
    "graph_edge_counts",
    "WITH" + MODULES_SQL + """
SELECT 'calls' AS kind, 'local_static' AS resolution, 3 * count(*)::BIGINT AS edges FROM mods
UNION ALL SELECT 'calls', 'import_static', count(*) FILTER (has_next)::BIGINT FROM mods
UNION ALL SELECT 'calls', 'unresolved', (count(*) + count(*) FILTER (NOT has_next))::BIGINT FROM mods
UNION ALL SELECT 'calls', 'ambiguous', count(*)::BIGINT FROM mods
UNION ALL SELECT 'inherits', 'import_static', count(*) FILTER (has_next)::BIGINT FROM mods
UNION ALL SELECT 'inherits', 'unresolved', count(*) FILTER (NOT has_next)::BIGINT FROM mods
UNION ALL SELECT 'depends_on', 'import_static', 2 * count(*) FILTER (has_next)::BIGINT FROM mods
UNION ALL SELECT 'depends_on', 'unresolved', (count(*) + 2 * count(*) FILTER (NOT has_next))::BIGINT FROM mods
UNION ALL SELECT 'contains', 'syntax', 13 * count(*)::BIGINT FROM mods""",
)
def graph_edge_counts(spark, folder):
    _, edges = resolved(spark, folder, ("calls", "inherits", "type_base", "depends_on", "contains"))
    kinds = edges.filter(F.col("kind").isin("calls", "inherits", "depends_on", "contains"))
    return kinds.groupBy("kind", "resolution").agg(F.count("*").alias("edges"))


@query(
    "graph_reachable_dependencies",
    "WITH RECURSIVE" + MODULES_SQL + """,
walk AS (
  SELECT source_id, 0 AS depth, k FROM mods JOIN customer ON c_custkey = k WHERE c_acctbal >= 9700
  UNION ALL SELECT m.source_id, w.depth + 1, m.k FROM walk w JOIN mods m ON m.k = w.k + 1 WHERE w.depth < 5)
SELECT source_id, min(depth)::INTEGER AS depth FROM walk GROUP BY source_id""",
)
def graph_reachable_dependencies(spark, folder):
    known, edges = resolved(spark, folder, ("depends_on",))
    files = known.filter(F.col("qualified_name") == "").select("entity_id", "source_id")
    number = F.regexp_extract("source_id", r"mod(\d+)\.py", 1).cast("bigint")
    rich = table(spark, folder, "customer").filter(F.col("c_acctbal") >= 9700).select(F.col("c_custkey").alias("number"))
    seeds = files.withColumn("number", number).join(rich, "number", "left_semi")
    found = traverse.reachable(edges, seeds, "outgoing", ("depends_on",), 5)
    return found.join(files, "entity_id").select("source_id", "depth")


@query(
    "graph_walks",
    "WITH" + MODULES_SQL + """,
steps AS (SELECT unnest([0, 1, 2, 3]) AS depth)
SELECT a.k AS seed, b.source_id, depth::INTEGER AS depth FROM mods a CROSS JOIN steps JOIN mods b ON b.k = a.k + depth""",
)
def graph_walks(spark, folder):
    """What each file depends on within three steps: one walk for each file of the table, all at once."""
    known, edges = resolved(spark, folder, ("depends_on",))
    files = known.filter(F.col("qualified_name") == "").select("entity_id", "source_id")
    seeds = files.select(F.regexp_extract("source_id", r"mod(\d+)\.py", 1).cast("bigint").alias("seed"), "entity_id")
    lifted = edges.filter(F.col("kind") == "depends_on").withColumn("observed_kind", F.col("kind"))
    found = walks.walk_all(lifted, seeds, "outgoing", ("depends_on",), 3, 200)
    return found.reached.join(files, "entity_id").select("seed", "source_id", "depth")


@query(
    "graph_callers_of_helper",
    "WITH" + MODULES_SQL + """ SELECT source_id || ':helper' AS target, source_id || ':Base' || k || '.step' AS caller FROM mods
    UNION ALL SELECT next_id || ':helper', source_id || ':helper.inner' FROM mods WHERE has_next""",
)
def graph_callers_of_helper(spark, folder):
    known, edges = resolved(spark, folder, ("calls",))
    label = F.concat_ws(":", F.col("source_id"), F.col("qualified_name"))
    wanted = known.filter(F.col("qualified_name") == "helper").select("entity_id", label.alias("target"))
    found = traverse.neighbours(edges, wanted, "incoming", ("calls",))
    callers = known.select(F.col("entity_id").alias("next_id"), label.alias("caller"))
    return found.join(callers, "next_id").select("target", "caller")


def code_chunks(spark, folder):
    blocks = modules(spark, folder).select("source_id", code_blocks(F.col("text")).alias("blocks"))
    return chunk_documents(blocks, 40, 8, code=F.lit(True))


@query(
    "code_blocks",
    "WITH" + MODULES_SQL + """,
shape(heading, line_start, line_end) AS (VALUES (NULL, 1, 4), ('Base', 5, 5), ('run', 6, 9), ('step', 10, 13), ('helper', 14, 14), ('inner', 15, 20), ('twin', 21, 24), ('twin', 25, 26))
SELECT source_id, replace(heading, 'Base', 'Base' || k) AS heading, line_start::INTEGER AS line_start, line_end::INTEGER AS line_end FROM mods, shape""",
)
def code_block_lines(spark, folder):
    blocks = modules(spark, folder).select("source_id", F.inline(code_blocks(F.col("text"))))
    return blocks.select("source_id", "heading", "line_start", "line_end")


@query("graph_citations")
def graph_citations(spark, folder):
    known = durable(graph.entities(parsed(spark, folder)).select("entity_id", "source_id", "line_start", "line_end"))
    chunks = durable(code_chunks(spark, folder).select("source_id", "chunk_index", "line_start", "line_end"))
    found = traverse.citations(known, chunks, "entity_id")
    return found.select("entity_id", F.array_join("chunks", ",").alias("chunks"), "chunks_truncated")


@query("graph_context_of_chunks")
def graph_context_of_chunks(spark, folder):
    chunks = code_chunks(spark, folder).withColumn("chunk_id", stable_id(F.col("source_id"), F.col("chunk_index")))
    chunks = durable(chunks.select("source_id", "chunk_id", "line_start", "line_end"))
    known = graph.entities(parsed(spark, folder)).select("source_id", "entity_id", "kind", "qualified_name", "line_start", "line_end")
    found = traverse.context_of_chunks(chunks, durable(known), 20)
    return found.select("chunk_id", "qualified_name", "place")


SPANS_SQL = """
spans AS (SELECT l_orderkey AS grp, l_partkey AS id, (l_suppkey * 13 % 500)::INTEGER AS s, (l_suppkey * 13 % 500 + l_quantity * 5)::INTEGER AS e FROM lineitem)"""


@query(
    "overlapping_spans",
    "WITH" + SPANS_SQL + """ SELECT a.grp, a.id AS left_id, b.id AS right_id, count(*)::BIGINT AS pairs FROM spans a JOIN spans b
    ON a.grp = b.grp AND a.s <= b.e AND a.e >= b.s GROUP BY ALL""",
)
def overlapping_spans(spark, folder):
    start = (F.col("l_suppkey") * 13 % 500).cast("int")
    spans = table(spark, folder, "lineitem", "l_orderkey").select(
        F.col("l_orderkey").alias("grp"), F.col("l_partkey").alias("id"), start.alias("s"), (start + F.col("l_quantity") * 5).cast("int").alias("e")
    )
    other = spans.toDF("grp", "right_id", "rs", "re")
    pairs = graph.overlapping(spans.withColumnRenamed("id", "left_id"), other, "grp", ("s", "e"), ("rs", "re"))
    return pairs.groupBy("grp", "left_id", "right_id").agg(F.count("*").alias("pairs"))


SCRIPT = """import {{ helper as dep }} from './mod{n}';
import react from 'react';

export function helper(x) {{
  return twin(x);
}}

class View{k} {{
}}

function twin(y) {{
  if (y) {{ dep(y); react.use(y); }}
}}
"""


@query(
    "outline_resolved_calls",
    """WITH mods AS (
  SELECT c_custkey AS k, 'ui/mod' || c_custkey || '.ts' AS source_id, 'ui/mod' || (c_custkey + 1) || '.ts' AS next_id,
         EXISTS (SELECT 1 FROM customer n WHERE n.c_custkey = c.c_custkey + 1) AS has_next FROM customer c)
SELECT source_id, 'helper' AS owner_name, 5 AS line_start, source_id || ':twin' AS target, 'local_static' AS resolution FROM mods
UNION ALL SELECT source_id, 'twin', 12, CASE WHEN has_next THEN next_id || ':helper' END, CASE WHEN has_next THEN 'import_static' ELSE 'unresolved' END FROM mods
UNION ALL SELECT source_id, 'twin', 12, NULL, 'unresolved' FROM mods""",
)
def outline_resolved_calls(spark, folder):
    from folionaut.sources import outline

    k = F.col("c_custkey")
    text = F.lit(SCRIPT.replace("{{", "{").replace("}}", "}"))
    for mark, value in (("{n}", k + 1), ("{k}", k)):
        text = F.replace(text, F.lit(mark), value.cast("string"))
    path = F.concat(F.lit("ui/mod"), k.cast("string"), F.lit(".ts"))
    files = table(spark, folder, "customer", "c_custkey").select(
        path.alias("source_id"), F.lit("root").alias("root_key"), path.alias("path"), names.language(path).alias("language"),
        names.module_key(path, names.language(path)).alias("module_key"), text.alias("text"),
    )
    known, edges = durable(outline.entities(files)), durable(outline.edges(files))
    target = known.select(F.col("entity_id").alias("target_id"), F.concat_ws(":", "source_id", "qualified_name").alias("target"))
    calls = graph.resolve(edges, known).filter(F.col("kind") == "calls").join(target, "target_id", "left")
    return calls.select("source_id", "owner_name", "line_start", "target", "resolution")

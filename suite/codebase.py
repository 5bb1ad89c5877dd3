"""Graph context of hits, roots of files, validity of parse results, overlap of spans of all lengths."""

from __future__ import annotations

from pyspark.sql import functions as F

from folionaut.functions import names
from folionaut.operators import context, gate, graph, spans
from folionaut.operators.durable import durable
from folionaut.sources import nesting, outline
from folionaut.sources.roots import with_roots
from suite.graph import MODULES_SQL, code_blocks, modules, resolved
from suite.registry import query, table

LIMIT = 2


def context_hits(spark, folder):
    """Each block of each module is a hit."""
    blocks = modules(spark, folder).select("source_id", F.inline(code_blocks(F.col("text"))))
    return blocks.select(F.concat_ws(":", "source_id", "line_start").alias("hit"), "source_id", "line_start", "line_end")


def indexed_files(spark, folder):
    """Of every seventh module the content has changed since it was parsed."""
    files = modules(spark, folder).where(F.col("k") % 7 != 0)
    return files.select("source_id", F.lit("parsed").alias("status"), "language", F.lit("1").alias("parser_version"))


@query(
    "graph_context_of_hits",
    "WITH" + MODULES_SQL + f""",
hits(hs, he) AS (VALUES (1, 4), (5, 5), (6, 9), (10, 13), (14, 14), (15, 20), (21, 24), (25, 26)),
ents(qn, ls, le) AS (VALUES ('', 1, 26), ('Base', 5, 11), ('Base.run', 6, 8), ('Base.step', 10, 11), ('helper', 14, 18), ('helper.inner', 15, 16), ('twin', 21, 22), ('twin', 25, 26)),
shape(owner, os, line, kind, tname, target, ts, place) AS (VALUES
  ('Base', 5, 5, 'inherits', 'Parent', 'Base', 5, 'next'), ('Base', 5, 5, 'references', 'Parent', 'Base', 5, 'next'),
  ('Base.run', 6, 7, 'calls', 'os.path', '-', 0, 'none'), ('Base.run', 6, 7, 'references', 'os', '-', 0, 'none'),
  ('Base.run', 6, 8, 'calls', 'Base.step', 'Base.step', 10, 'own'), ('Base.run', 6, 8, 'references', 'dep', 'helper', 14, 'next'),
  ('Base.run', 6, 8, 'references', 'self', '-', 0, 'none'), ('Base.step', 10, 11, 'calls', 'helper', 'helper', 14, 'own'),
  ('Base.step', 10, 11, 'references', 'helper', 'helper', 14, 'own'), ('Base.step', 10, 11, 'references', 'value', '-', 0, 'none'),
  ('helper.inner', 15, 16, 'calls', 'dep', 'helper', 14, 'next'), ('helper.inner', 15, 16, 'references', 'dep', 'helper', 14, 'next'),
  ('helper.inner', 15, 16, 'references', 'y', '-', 0, 'none'), ('helper', 14, 18, 'calls', 'inner', 'helper.inner', 15, 'own'),
  ('helper', 14, 18, 'references', 'inner', 'helper.inner', 15, 'own'), ('helper', 14, 18, 'references', 'x', '-', 0, 'none'),
  ('twin', 25, 26, 'calls', 'twin', '-', 0, 'none'), ('twin', 25, 26, 'references', 'twin', '-', 0, 'none')),
edges AS (SELECT m.source_id, owner, os, line, kind, replace(tname, 'Base', 'Base' || k) AS tname, target, ts,
  CASE place WHEN 'own' THEN m.source_id WHEN 'next' THEN CASE WHEN has_next THEN next_id END END AS tsource FROM mods m, shape),
near AS (SELECT h.hs, h.he, m.source_id, m.k, e.*, row_number() OVER (PARTITION BY h.hs, m.source_id ORDER BY le - ls, ls) AS place
         FROM mods m, hits h JOIN ents e ON e.ls <= h.he AND e.le >= h.hs),
listed AS (SELECT source_id, hs, string_agg(replace(qn, 'Base', 'Base' || k), ',' ORDER BY place) FILTER (place <= {LIMIT}) AS entities, max(place) > {LIMIT} AS entities_more FROM near GROUP BY ALL),
met AS (
  SELECT n.source_id AS hsource, n.hs, n.place, 0 AS turn, e.* FROM near n JOIN edges e ON e.source_id = n.source_id AND e.owner = n.qn AND e.os = n.ls WHERE n.place <= {LIMIT}
  UNION ALL
  SELECT n.source_id, n.hs, n.place, 1, e.* FROM near n JOIN edges e ON e.tsource = n.source_id AND e.target = n.qn AND e.ts = n.ls WHERE n.place <= {LIMIT}),
once AS (SELECT *, row_number() OVER (PARTITION BY hsource, hs, source_id, line, kind, tname ORDER BY place, turn) AS seen FROM met),
ranked AS (SELECT *, row_number() OVER (PARTITION BY hsource, hs ORDER BY place, turn, source_id, line, kind, tname) AS r FROM once WHERE seen = 1),
related AS (SELECT hsource AS source_id, hs, string_agg(CASE turn WHEN 0 THEN '>' ELSE '<' END || kind || ':' || tname || '@' || line, ',' ORDER BY r) FILTER (r <= {LIMIT}) AS relationships,
  max(r) > {LIMIT} AS relationships_more FROM ranked GROUP BY ALL)
SELECT m.source_id || ':' || h.hs AS hit, k % 7 <> 0 AS available, CASE WHEN k % 7 <> 0 THEN 'parsed' ELSE 'pending_or_stale' END AS status,
  CASE WHEN k % 7 <> 0 THEN entities ELSE '' END AS entities, CASE WHEN k % 7 <> 0 THEN coalesce(relationships, '') ELSE '' END AS relationships,
  CASE WHEN k % 7 <> 0 THEN 'os,pkg' || (k + 1) % 7 || '.mod' || (k + 1) || '.Base' || (k + 1) ELSE '' END AS imports,
  k % 7 <> 0 AND entities_more AS entities_more, k % 7 <> 0 AND coalesce(relationships_more, false) AS relationships_more,
  k % 7 <> 0 AS imports_more, k % 7 <> 0 AS truncated
FROM mods m, hits h LEFT JOIN listed l ON l.source_id = m.source_id AND l.hs = h.hs LEFT JOIN related r ON r.source_id = m.source_id AND r.hs = h.hs""",
)
def graph_context_of_hits(spark, folder):
    """Three imports stand in each file, so with two shown each list of imports goes on."""
    known, edges = resolved(spark, folder, (*context.KINDS, "type_base", "imports"))
    edges = durable(edges.select("kind", *[c for c in context.EDGE if c not in ("orientation", "kind")]))
    found = context.graph_context(durable(context_hits(spark, folder)), indexed_files(spark, folder), known, edges, LIMIT)
    label = lambda e: F.concat(F.when(e["orientation"] == "outgoing", ">").otherwise("<"), e["kind"], F.lit(":"), e["target_name"], F.lit("@"), e["line_start"].cast("string"))
    return found.select(
        "hit", "available", "status", F.array_join(F.transform("entities", lambda e: e["qualified_name"]), ",").alias("entities"),
        F.array_join(F.transform("relationships", label), ",").alias("relationships"),
        F.array_join(F.transform("imports", lambda e: e["target_name"]), ",").alias("imports"),
        "entities_more", "relationships_more", "imports_more", "truncated",
    )


ROOTS_SQL = """
roots AS (SELECT 'r' || n_nationkey AS root_key, '/src/n' || n_nationkey AS root_path FROM nation
          UNION ALL SELECT 'v' || n_nationkey, '/src/n' || n_nationkey || '/vendor' FROM nation WHERE n_nationkey % 2 = 0),
files AS (SELECT c_custkey, '/src/n' || c_nationkey || CASE WHEN c_custkey % 3 = 0 THEN '/vendor' ELSE '' END
          || CASE WHEN c_custkey % 11 = 0 THEN 'ed' ELSE '' END || '/pkg/mod' || c_custkey % 50 || '.py' AS path FROM customer
          UNION ALL SELECT -s_suppkey, '/other/mod' || s_suppkey || '.py' FROM supplier)"""


@query(
    "source_roots",
    "WITH" + ROOTS_SQL + """,
best AS (SELECT f.path, arg_max(r.root_key, length(r.root_path)) AS root_key, max(length(r.root_path)) AS size
         FROM (SELECT DISTINCT path FROM files) f JOIN roots r ON starts_with(f.path, r.root_path || '/') GROUP BY f.path)
SELECT c_custkey AS file, f.path, root_key, CASE WHEN size IS NULL THEN f.path ELSE substr(f.path, size + 2) END AS relative_path,
       replace(regexp_replace(CASE WHEN size IS NULL THEN ltrim(f.path, '/') ELSE substr(f.path, size + 2) END, '\\.py$', ''), '/', '.') AS module_key
FROM files f LEFT JOIN best USING (path)""",
)
def source_roots(spark, folder):
    """Nested roots, files outside all of them, and the same module under many roots."""
    nation, customer = table(spark, folder, "nation"), table(spark, folder, "customer", "c_custkey")
    base = F.concat(F.lit("/src/n"), F.col("n_nationkey").cast("string"))
    roots = nation.select(F.concat(F.lit("r"), F.col("n_nationkey").cast("string")).alias("root_key"), F.concat(base, F.lit("/")).alias("root_path"))
    nested = nation.where("n_nationkey % 2 = 0").select(F.concat(F.lit("v"), F.col("n_nationkey").cast("string")), F.concat(base, F.lit("/vendor")))
    key = F.col("c_custkey")
    path = F.concat(
        F.lit("/src/n"), F.col("c_nationkey").cast("string"), F.when(key % 3 == 0, "/vendor").otherwise(""), F.when(key % 11 == 0, "ed").otherwise(""),
        F.lit("/pkg/mod"), (key % 50).cast("string"), F.lit(".py"),
    )
    outside = table(spark, folder, "supplier").select((-F.col("s_suppkey")).alias("file"), F.concat(F.lit("/other/mod"), F.col("s_suppkey").cast("string"), F.lit(".py")))
    files = customer.select(key.alias("file"), path.alias("path")).union(outside)
    return with_roots(files, roots.union(nested)).select("file", "path", "root_key", "relative_path", "module_key")


VERSIONS_SQL = """
sources AS (SELECT o_orderkey AS source_id, o_custkey % 50 AS content_hash, CASE WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'indexed' END AS status,
  CASE WHEN o_orderkey % 13 = 0 THEN o_orderdate END AS deleted_at,
  CASE o_orderkey % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'java' WHEN 2 THEN 'go' ELSE 'text' END AS language FROM orders),
parsers(language, parser_version) AS (VALUES ('python', '3'), ('java', '2'), ('go', '1')),
results AS (SELECT l_orderkey AS source_id, CASE WHEN l_linenumber % 2 = 0 THEN o_custkey % 50 ELSE l_suppkey % 50 END AS content_hash,
  (l_quantity::BIGINT % 3 + 1)::VARCHAR AS parser_version, l_linenumber AS parsed_at FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_orderkey % 5 <> 0),
wanted AS (SELECT source_id, content_hash, language, parser_version FROM sources JOIN parsers USING (language) WHERE status = 'indexed' AND deleted_at IS NULL)"""


def versions(spark, folder):
    """Orders as source files, their lines as runs of parsers over earlier and present contents."""
    orders, lines = table(spark, folder, "orders", "o_orderkey"), table(spark, folder, "lineitem", "l_orderkey")
    key = F.col("o_orderkey") % 4
    sources = orders.select(
        F.col("o_orderkey").alias("source_id"), (F.col("o_custkey") % 50).alias("content_hash"),
        F.when(F.col("o_orderstatus") == "P", "failed").otherwise("indexed").alias("status"),
        F.when(F.col("o_orderkey") % 13 == 0, F.col("o_orderdate")).alias("deleted_at"),
        F.when(key == 0, "python").when(key == 1, "java").when(key == 2, "go").otherwise("text").alias("language"),
    )
    parsers = spark.createDataFrame([("python", "3"), ("java", "2"), ("go", "1")], "language string, parser_version string")
    made = lines.where("l_orderkey % 5 <> 0").join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    results = made.select(
        F.col("l_orderkey").alias("source_id"),
        F.when(F.col("l_linenumber") % 2 == 0, F.col("o_custkey") % 50).otherwise(F.col("l_suppkey") % 50).alias("content_hash"),
        (F.col("l_quantity").cast("bigint") % 3 + 1).cast("string").alias("parser_version"), F.col("l_linenumber").alias("parsed_at"),
    )
    return results, sources, parsers


@query(
    "graph_valid_results",
    "WITH" + VERSIONS_SQL + """ SELECT source_id, r.content_hash, r.parser_version, max(parsed_at) AS parsed_at
    FROM results r JOIN wanted w USING (source_id, content_hash, parser_version) GROUP BY ALL""",
)
def graph_valid_results(spark, folder):
    return gate.valid_results(*versions(spark, folder)).select("source_id", "content_hash", "parser_version", "parsed_at")


@query(
    "graph_backfill",
    "WITH" + VERSIONS_SQL + """ SELECT source_id, content_hash, language, parser_version,
    CASE WHEN EXISTS (SELECT 1 FROM results r WHERE r.source_id = w.source_id AND r.content_hash = w.content_hash) THEN 'older_parser'
         WHEN EXISTS (SELECT 1 FROM results r WHERE r.source_id = w.source_id) THEN 'changed' ELSE 'unparsed' END AS reason
    FROM wanted w ANTI JOIN results r USING (source_id, content_hash, parser_version)""",
)
def graph_backfill(spark, folder):
    return gate.backfill(*versions(spark, folder))


@query(
    "overlapping_spans_of_all_lengths",
    """WITH a AS (SELECT l_suppkey % 20 AS grp, l_orderkey * 8 + l_linenumber AS id, (l_partkey * 7 % 9000)::INTEGER AS s,
      (l_partkey * 7 % 9000 + CASE WHEN l_orderkey % 200 = 0 THEN 9000 ELSE l_quantity END)::INTEGER AS e FROM lineitem WHERE l_linenumber = 1),
    b AS (SELECT ps AS grp, id, s, e FROM (SELECT o_custkey % 20 AS ps, o_orderkey AS id, (o_orderkey * 11 % 9000)::INTEGER AS s, (o_orderkey * 11 % 9000 + CASE WHEN o_orderkey % 300 = 0 THEN 20000 ELSE o_orderkey % 40 END)::INTEGER AS e FROM orders))
    SELECT a.id AS left_id, count(*)::BIGINT AS met, min(b.id) AS low, max(b.id) AS high FROM a JOIN b ON a.grp = b.grp AND a.s <= b.e AND a.e >= b.s GROUP BY a.id""",
)
def overlapping_spans_of_all_lengths(spark, folder):
    lines = table(spark, folder, "lineitem", "l_orderkey").where("l_linenumber = 1")
    start = F.col("l_partkey") * 7 % 9000
    a = lines.select(
        (F.col("l_suppkey") % 20).alias("grp"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("left_id"), start.cast("int").alias("s"),
        (start + F.when(F.col("l_orderkey") % 200 == 0, 9000).otherwise(F.col("l_quantity"))).cast("int").alias("e"),
    )
    key = F.col("o_orderkey")
    begin = key * 11 % 9000
    b = table(spark, folder, "orders", "o_orderkey").select(
        (F.col("o_custkey") % 20).alias("grp"), key.alias("right_id"), begin.cast("int").alias("rs"),
        (begin + F.when(key % 300 == 0, 20000).otherwise(key % 40)).cast("int").alias("re"),
    )
    found = spans.overlap_summary(a, b, "grp", ("s", "e"), ("rs", "re"), "right_id")
    return found.groupBy("left_id").agg(F.sum("met").alias("met"), F.min("low").alias("low"), F.max("high").alias("high"))


# Files of the query below: # stands for the number of a row, @ for the next one.
JAVA_FILE = """package p;
import p.Base@;
public interface Shape#<T extends Comparable<T>> {
  void draw();
}
/* class No { */
class Outer# extends Base@ implements Shape#<String> {
  String s = "{ class Fake {";
  static class Inner implements Shape# {
    void run(int a) throws Error {
      if (a > 0) { helper(); }
    }
  }
}
class Base# {
}
"""
SCRIPT_FILE = """import { Shape as S } from './m@';
export interface Shape {
}
export class Part extends Gone implements S {
  run(a: number): void {
    function inner() {
    }
  }
}
"""


def nested_files(spark, folder):
    """A Java file for each supplier and a TypeScript file for each customer; each one uses a type of the next."""

    def written(name: str, key: str, path: str, text: str):
        rows = table(spark, folder, name, key).select(F.col(key).cast("string").alias("k"), (F.col(key) + 1).cast("string").alias("next"))
        return rows.select(F.replace(F.lit(path), F.lit("#"), "k").alias("path"), F.replace(F.replace(F.lit(text), F.lit("#"), "k"), F.lit("@"), "next").alias("text"))

    rows = written("supplier", "s_suppkey", "java/F#.java", JAVA_FILE).unionByName(written("customer", "c_custkey", "src/m#.ts", SCRIPT_FILE))
    kind = names.language(F.col("path"))
    return outline.with_package(rows.select(
        F.col("path").alias("source_id"), F.lit("r").alias("root_key"), "path", kind.alias("language"), names.module_key(F.col("path"), kind).alias("module_key"), "text"
    ))


@query(
    "graph_nested_types",
    """WITH k AS (SELECT 'j' AS g, 'java/F' || s_suppkey || '.java' AS source_id, s_suppkey AS k, s_suppkey + 1 IN (SELECT s_suppkey FROM supplier) AS has_next FROM supplier
      UNION ALL SELECT 't', 'src/m' || c_custkey || '.ts', c_custkey, c_custkey + 1 IN (SELECT c_custkey FROM customer) FROM customer),
    shape(g, owner, kind, target, resolution, line_start, far) AS (VALUES
      ('j', '', 'contains', 'Shape#', 'syntax', 3, false), ('j', '', 'contains', 'Outer#', 'syntax', 7, false), ('j', 'Outer#', 'contains', 'Inner', 'syntax', 9, false),
      ('j', 'Outer#.Inner', 'contains', 'run', 'syntax', 10, false), ('j', '', 'contains', 'Base#', 'syntax', 15, false),
      ('j', 'Outer#', 'inherits', 'Base@', 'import_static', 7, true), ('j', 'Outer#', 'implements', 'Shape#', 'local_static', 7, false),
      ('j', 'Outer#.Inner', 'implements', 'Shape#', 'local_static', 9, false),
      ('t', '', 'contains', 'Shape', 'syntax', 2, false), ('t', '', 'contains', 'Part', 'syntax', 4, false), ('t', 'Part', 'contains', 'run', 'syntax', 5, false),
      ('t', 'Part.run', 'contains', 'inner', 'syntax', 6, false), ('t', 'Part', 'type_base', 'Gone', 'unresolved', 4, false), ('t', 'Part', 'implements', 'S', 'import_static', 4, true))
    SELECT source_id, replace(owner, '#', k::VARCHAR) AS owner_name, CASE WHEN far AND NOT has_next THEN 'type_base' ELSE kind END AS kind,
      replace(replace(target, '#', k::VARCHAR), '@', (k + 1)::VARCHAR) AS target_name, CASE WHEN far AND NOT has_next THEN 'unresolved' ELSE resolution END AS resolution, line_start
    FROM k JOIN shape USING (g)""",
)
def graph_nested_types(spark, folder):
    files = nested_files(spark, folder)
    declared = durable(nesting.declarations(files))
    found = graph.resolve(durable(nesting.edges(files, declared)), declared)
    return found.select("source_id", "owner_name", "kind", "target_name", "resolution", "line_start")

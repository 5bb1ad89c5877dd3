"""Structured text: pages, Markdown, separated values, transcripts and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from folionaut.functions import names, text as T
from folionaut.sources.markup import html_page, markdown_blocks
from folionaut.sources.plaintext import delimited_blocks
from folionaut.sources.transcript import duration_seconds, transcript_blocks
from suite.registry import query, table


@query("html_blocks")
def html_blocks(spark, folder):
    pages = table(spark, folder, "pages", "page_id").select("page_id", html_page(F.col("html")).alias("p"))
    return pages.select("page_id", F.posexplode("p.blocks").alias("block_no", "b")).select(
        "page_id", "block_no", "b.text", "b.is_heading", "b.section_path"
    )


# A named character reference may lack its semicolon, as where a title was cut.
@query(
    "html_titles_and_links",
    r"""WITH raw AS (SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS t,
    len(regexp_extract_all(html, '<h[1-6]')) AS headings FROM pages)
    SELECT page_id, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', chr(160)), '&amp;?', '&', 'g'), '^\s+|\s+$', '', 'g')) AS title,
    headings::BIGINT AS headings FROM raw""",
)
def html_titles_and_links(spark, folder):
    pages = table(spark, folder, "pages", "page_id").select("page_id", html_page(F.col("html")).alias("p"))
    headings = F.size(F.filter("p.blocks", lambda b: b["is_heading"])).cast("bigint")
    return pages.select("page_id", F.col("p.title").alias("title"), headings.alias("headings"))


CUSTOMER_MARKDOWN = """# Region %d

Customer **%s** of segment %s.
Second line.

## Balance

- amount: %.2f
- nation %d

```
code %d
```

| key | value |
|-----|-------|
| id | %d |
"""


@query(
    "markdown_blocks",
    """WITH shaped AS (
  SELECT c_custkey, 'Region ' || c_nationkey AS h1, [
    {'t': 'Region ' || c_nationkey, 'p': 1, 'h': true, 'a': false},
    {'t': 'Customer **' || c_name || '** of segment ' || c_mktsegment || '.' || chr(10) || 'Second line.', 'p': 1, 'h': false, 'a': false},
    {'t': 'Balance', 'p': 2, 'h': true, 'a': false}, {'t': printf('amount: %.2f', c_acctbal), 'p': 2, 'h': false, 'a': false},
    {'t': 'nation ' || c_nationkey, 'p': 2, 'h': false, 'a': false}, {'t': 'code ' || c_custkey, 'p': 2, 'h': false, 'a': true},
    {'t': 'key', 'p': 2, 'h': false, 'a': false}, {'t': 'value', 'p': 2, 'h': false, 'a': false},
    {'t': 'id', 'p': 2, 'h': false, 'a': false}, {'t': c_custkey::VARCHAR, 'p': 2, 'h': false, 'a': false}] AS b FROM customer),
flat AS (SELECT c_custkey, h1, unnest(b) AS e, generate_subscripts(b, 1) AS n FROM shaped)
SELECT c_custkey, (n - 1)::BIGINT AS block_no, e.t AS text, e.h AS is_heading, e.a AS atomic,
       CASE e.p WHEN 1 THEN h1 ELSE h1 || ' > Balance' END AS section_path FROM flat""",
)
def markdown_of_customers(spark, folder):
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    source = F.format_string(CUSTOMER_MARKDOWN, nation, "c_name", "c_mktsegment", "c_acctbal", nation, key, key)
    rows = table(spark, folder, "customer", "c_custkey").select("c_custkey", markdown_blocks(source).alias("blocks"))
    return rows.select("c_custkey", F.posexplode("blocks").alias("block_no", "b")).select(
        "c_custkey", F.col("block_no").cast("bigint").alias("block_no"), "b.text", "b.is_heading", "b.atomic", "b.section_path"
    )


@query(
    "delimited_rows",
    """SELECT c_custkey, 'row 1' AS heading, 'name: ' || c_name || chr(10) || 'second | balance: ' || printf('%.2f', c_acctbal) || ' | col2: ' || c_mktsegment AS text FROM customer
    UNION ALL SELECT c_custkey, 'row 2', 'name: x, "y"' FROM customer""",
)
def delimited_rows(spark, folder):
    source = F.format_string('name,balance\n"%s\nsecond",%.2f,%s\n"x, ""y"""\n', "c_name", "c_acctbal", "c_mktsegment")
    rows = table(spark, folder, "customer", "c_custkey").select("c_custkey", F.inline(delimited_blocks(source)))
    return rows.select("c_custkey", "heading", "text")


@query(
    "transcript_segments",
    r"""SELECT conv_id, turn, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text, (turn * 2500)::BIGINT AS time_start_ms, (turn * 2500 + 1250)::BIGINT AS time_end_ms,
    round((turn * 2500 + 1250) / 1000.0, 3)::DOUBLE AS duration FROM conversations WHERE regexp_matches(text, '\S')""",
)
def transcript_segments(spark, folder):
    said = table(spark, folder, "conversations", "conv_id")
    segment = F.struct(
        F.col("text").alias("text"), (F.col("turn") * 2.5).alias("start"), (F.col("turn") * 2.5 + 1.25).alias("end")
    )
    rows = said.select("conv_id", "turn", transcript_blocks(F.to_json(F.struct(F.array(segment).alias("segments")))).alias("blocks"))
    timed = rows.select("conv_id", "turn", F.round(duration_seconds(F.col("blocks")), 3).alias("duration"), F.inline("blocks"))
    return timed.select("conv_id", "turn", "text", "time_start_ms", "time_end_ms", "duration")


SUFFIXES = ["py", "rs", "ts", "go", "java", "h", "md"]


@query(
    "module_keys",
    r"""WITH p AS (
  SELECT p_partkey, p_partkey % 7 AS s, (['py', 'rs', 'ts', 'go', 'java', 'h', 'md'])[p_partkey % 7 + 1] AS suffix,
         replace(lower(p_name), ' ', '/') || '/' || CASE p_partkey % 5 WHEN 0 THEN '__init__' WHEN 1 THEN 'index' WHEN 2 THEN 'mod' ELSE 'file' || p_size END AS stem FROM part)
SELECT p_partkey, stem || '.' || suffix AS path,
  (MAP {'py': 'python', 'rs': 'rust', 'ts': 'typescript', 'go': 'go', 'java': 'java', 'h': 'c'})[suffix] AS language,
  CASE suffix WHEN 'py' THEN replace(regexp_replace(stem, '/__init__$', ''), '/', '.') WHEN 'rs' THEN 'crate.' || replace(regexp_replace(stem, '/mod$', ''), '/', '.')
    WHEN 'ts' THEN replace(regexp_replace(stem, '/index$', ''), '/', '.') WHEN 'go' THEN replace(regexp_replace(stem, '/[^/]*$', ''), '/', '.')
    WHEN 'h' THEN stem || '.h' ELSE replace(stem, '/', '.') END AS module_key FROM p""",
)
def module_keys(spark, folder):
    n = F.col("p_partkey") % 5
    base = F.when(n == 0, "__init__").when(n == 1, "index").when(n == 2, "mod").otherwise(F.concat(F.lit("file"), F.col("p_size").cast("string")))
    suffix = F.get(F.array(*[F.lit(s) for s in SUFFIXES]), (F.col("p_partkey") % 7).cast("int"))
    path = F.concat(F.replace(F.lower("p_name"), F.lit(" "), F.lit("/")), F.lit("/"), base, F.lit("."), suffix)
    rows = table(spark, folder, "part", "p_partkey").select("p_partkey", path.alias("path"))
    language = names.language(F.col("path"))
    return rows.select("p_partkey", "path", language.alias("language"), names.module_key(F.col("path"), language).alias("module_key"))


@query(
    "symbol_names_and_ids",
    """SELECT p_partkey, 'a.' || lower(p_brand) || '.b.c' AS name, substr(sha256(p_partkey || chr(0) || p_name), 1, 32) AS uid,
    'doc_' || p_partkey || '-' || substr(sha256('Doc ' || p_partkey || '.PDF'), 1, 12) || '.md' AS sidecar FROM part""",
)
def symbol_names_and_ids(spark, folder):
    name = F.concat(F.lit(" a::"), F.lower("p_brand"), F.lit("->b?.c "))
    path = F.concat(F.lit("/x/Doc "), F.col("p_partkey").cast("string"), F.lit(".PDF"))
    return table(spark, folder, "part", "p_partkey").select(
        "p_partkey", names.normalize_name(name).alias("name"), T.stable_id(F.col("p_partkey"), F.col("p_name")).alias("uid"),
        names.sidecar_name(path).alias("sidecar"),
    )

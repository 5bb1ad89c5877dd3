"""Blocks, chunks, vocabulary and facts made from the given texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from folionaut.functions import text as T
from folionaut.functions.facts import extract_facts
from folionaut.operators import bm25, fusion, vocabulary
from folionaut.operators.chunking import chunk_documents
from folionaut.operators.durable import durable
from folionaut.sources.plaintext import markdown_text, plain_blocks
from suite.registry import DOCUMENTS_SQL, documents, query, table

LINES_SQL = r"""
parts AS (
  SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS n
  FROM (SELECT doc_id, regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]') AS l FROM documents)),
lines_ AS (SELECT doc_id, n, line FROM parts WHERE regexp_matches(line, '\S'))"""

BLOCKS_AT_SQL = LINES_SQL + r""",
blocks AS (
  SELECT doc_id, n, line, len(line) AS size,
         sum(len(line) + 2) OVER w - len(line) - 2 AS pos_,
         coalesce(trim(regexp_replace(line, '\s+', ' ', 'g')) = lag(trim(regexp_replace(line, '\s+', ' ', 'g'))) OVER w, false) AS repeat
  FROM lines_ WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
grouped AS (SELECT *, sum(repeat::INT) OVER (PARTITION BY doc_id ORDER BY n) AS grp FROM blocks),
kept AS (SELECT * FROM grouped WHERE NOT repeat),
whole AS (SELECT doc_id, string_agg(line, chr(10) || chr(10) ORDER BY n) AS full_text FROM lines_ GROUP BY doc_id)"""

CHUNKS_SQL = "WITH RECURSIVE" + BLOCKS_AT_SQL + r""",
sentences AS (
  SELECT doc_id, n, grp, pos_, unnest(s) AS sentence, generate_subscripts(s, 1) AS k
  FROM (SELECT *, CASE WHEN size <= 1024 THEN [line]
        ELSE string_split(line[1] || regexp_replace(line[2:], '([.!?])(\s)', '\1' || chr(30) || '\2', 'g'), chr(30)) END AS s FROM kept)),
placed AS (
  SELECT *, pos_ + coalesce(sum(len(sentence)) OVER (PARTITION BY doc_id, n ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a,
         len(sentence) AS size FROM sentences WHERE len(sentence) > 0),
units AS (
  SELECT doc_id, grp, n, a + w * 1024 AS s, least(a + (w + 1) * 1024, a + size) AS e
  FROM (SELECT *, unnest(range(0, greatest((size + 1023) // 1024, 1))) AS w FROM placed)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id, grp ORDER BY s) AS i, count(*) OVER (PARTITION BY doc_id, grp) AS c FROM units),
reach AS (
  SELECT u.doc_id, u.grp, u.i, any_value(u.s) AS s, any_value(u.n) AS n, any_value(u.c) AS c,
         greatest(u.i, coalesce(max(v.i) FILTER (v.e <= u.s + 1024), u.i)) AS past
  FROM numbered u JOIN numbered v ON u.doc_id = v.doc_id AND u.grp = v.grp AND v.i >= u.i GROUP BY u.doc_id, u.grp, u.i),
ends AS (SELECT r.*, v.e AS e, v.n AS last_n FROM reach r JOIN numbered v ON r.doc_id = v.doc_id AND r.grp = v.grp AND v.i = r.past),
steps AS (
  SELECT r.doc_id, r.grp, r.i, greatest(r.i + 1, coalesce(min(v.i) FILTER (r.e - v.s <= 256), r.past + 1)) AS next_i
  FROM ends r JOIN numbered v ON r.doc_id = v.doc_id AND r.grp = v.grp AND v.i > r.i AND v.i <= r.past + 1 GROUP BY r.doc_id, r.grp, r.i, r.past, r.e),
walk AS (
  SELECT doc_id, grp, 1::BIGINT AS i FROM ends WHERE i = 1
  UNION ALL
  SELECT w.doc_id, w.grp, t.next_i::BIGINT FROM walk w JOIN ends r ON r.doc_id = w.doc_id AND r.grp = w.grp AND r.i = w.i
  JOIN steps t ON t.doc_id = w.doc_id AND t.grp = w.grp AND t.i = w.i WHERE r.past < r.c),
chosen AS (
  SELECT r.doc_id, r.s, r.e, r.n, r.last_n, substr(full_text, r.s::BIGINT + 1, (r.e - r.s)::BIGINT) AS text, len(full_text) AS total
  FROM walk JOIN ends r USING (doc_id, grp, i) JOIN whole USING (doc_id)),
chunks AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS chunk_index FROM chosen WHERE regexp_matches(text, '\S'))"""


def document_blocks(spark, folder):
    docs = table(spark, folder, "documents", "doc_id")
    return docs.select("doc_id", "source", "lang", plain_blocks(F.col("text")).alias("blocks"))


@query("plain_blocks", "WITH" + LINES_SQL + " SELECT doc_id, n::INTEGER AS line_start, line AS text FROM lines_")
def plain_text_blocks(spark, folder):
    exploded = document_blocks(spark, folder).select("doc_id", F.inline("blocks"))
    return exploded.select("doc_id", "line_start", "text")


@query(
    "document_chunks",
    CHUNKS_SQL + """
SELECT doc_id, chunk_index::BIGINT AS chunk_index, s::BIGINT AS char_start, e::BIGINT AS char_end, md5(text) AS text_md5,
       ((len(text) + 3) // 4)::BIGINT AS token_count, ((s + 3) // 4)::BIGINT AS token_start,
       n::BIGINT AS line_start, last_n::BIGINT AS line_end, round(100.0 * s / total, 6)::DOUBLE AS percent_position
FROM chunks""",
)
def document_chunks(spark, folder):
    chunks = chunk_documents(document_blocks(spark, folder), 256, 64, keep=("doc_id",))
    longs = ("chunk_index", "char_start", "char_end", "token_count", "token_start", "line_start", "line_end")
    return chunks.select(
        "doc_id",
        *[F.col(name).cast("bigint").alias(name) for name in longs],
        F.md5("text").alias("text_md5"),
        F.round("percent_position", 6).alias("percent_position"),
    )


@query(
    "chunk_keyword_topk",
    CHUNKS_SQL + r""",
toks AS (SELECT doc_id, chunk_index, regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+') AS t FROM chunks),
stats AS (SELECT count(*)::DOUBLE AS n, avg(len(t)) AS avgdl FROM toks),
hits AS (
  SELECT doc_id, chunk_index, len(t) AS dl, q, len(list_filter(t, lambda x: x = q)) AS tf FROM toks, (VALUES ('mentre'), ('thtion'), ('queation')) v(q)),
found AS (SELECT *, count(*) OVER (PARTITION BY q)::DOUBLE AS df FROM hits WHERE tf > 0)
SELECT doc_id, chunk_index::BIGINT AS chunk_index, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
FROM found, stats GROUP BY ALL ORDER BY sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) DESC, doc_id, chunk_index LIMIT 50""",
)
def chunk_keyword_topk(spark, folder):
    chunks = chunk_documents(document_blocks(spark, folder), 256, 64, keep=("doc_id",))
    rows = chunks.select(F.struct("doc_id", "chunk_index").alias("seq"), "text")
    best = fusion.top_k(bm25.keyword_scores(rows, "mentre thtion queation", ("text",)), "keyword_score", 50)
    return best.select(
        "seq.doc_id", F.col("seq.chunk_index").cast("bigint").alias("chunk_index"), F.round("keyword_score", 6).alias("score")
    )


@query(
    "chunk_citations",
    CHUNKS_SQL + """
SELECT doc_id, chunk_index::BIGINT AS chunk_index,
       'doc-' || doc_id || ', lines ' || n || CASE WHEN last_n <> n THEN '-' || last_n ELSE '' END AS by_line,
       'doc-' || doc_id || ', ~' || (round_even(100.0 * s / total, 0)::INTEGER) || '% through' AS by_share
FROM chunks""",
)
def chunk_citations(spark, folder):
    chunks = chunk_documents(document_blocks(spark, folder), 256, 64, keep=("doc_id",))
    name = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))
    none = F.lit(None).cast("int")
    line = T.citation_label(name, none, none, none, none, F.col("line_start"), F.col("line_end"), none, none)
    share = T.citation_label(name, none, none, none, none, none, none, none, F.col("percent_position"))
    return chunks.select("doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), line.alias("by_line"), share.alias("by_share"))


@query(
    "repeated_neighbour_blocks",
    "WITH" + BLOCKS_AT_SQL + " SELECT doc_id, n::BIGINT AS line_start, pos_::BIGINT AS char_start, grp::BIGINT AS group_no FROM kept",
)
def repeated_neighbour_blocks(spark, folder):
    """Blocks left after the suppression of repeats, at their place in the full text, by the window form."""
    from pyspark.sql import Window

    lines = document_blocks(spark, folder).select("doc_id", F.inline("blocks")).select("doc_id", "line_start", "text")
    order = Window.partitionBy("doc_id").orderBy("line_start")
    marked = lines.withColumn("norm", T.squeeze(F.col("text"))).select(
        "doc_id",
        "line_start",
        (F.sum(F.length("text") + 2).over(order) - F.length("text") - 2).alias("char_start"),
        F.coalesce(F.col("norm") == F.lag("norm").over(order), F.lit(False)).alias("repeat"),
    )
    grouped = marked.withColumn("group_no", F.sum(F.col("repeat").cast("int")).over(order)).filter(~F.col("repeat"))
    return grouped.select("doc_id", *[F.col(c).cast("bigint").alias(c) for c in ("line_start", "char_start", "group_no")])


@query(
    "blocks_as_markdown",
    "WITH" + LINES_SQL + " SELECT doc_id, md5(string_agg(line, chr(10) || chr(10) ORDER BY n) || chr(10)) AS digest FROM lines_ GROUP BY doc_id",
)
def blocks_as_markdown(spark, folder):
    blocks = document_blocks(spark, folder).filter(F.size("blocks") > 0)
    return blocks.select("doc_id", F.md5(markdown_text(F.col("blocks"))).alias("digest"))


STOP_SQL = "(" + ", ".join(f"'{word}'" for word in T.STOP_WORDS) + ")"
TERMS_SQL = DOCUMENTS_SQL + f""",
terms AS (
  SELECT DISTINCT seq, source, term FROM (
    SELECT seq, source, unnest(list_transform(regexp_extract_all(text || ' ' || filename || ' ', '[A-Za-z][A-Za-z0-9_-]{{2,}}'), lambda t: lower(t))) AS term
    FROM rows_) WHERE term NOT IN {STOP_SQL})"""


@query("candidate_terms", "WITH" + TERMS_SQL + " SELECT seq, count(*)::BIGINT AS terms, min(term) AS first_term, max(term) AS last_term FROM terms GROUP BY seq")
def candidate_terms(spark, folder):
    links = vocabulary.keyword_links(documents(spark, folder))
    return links.groupBy("chunk_id").agg(
        F.count("*").alias("terms"), F.min("term").alias("first_term"), F.max("term").alias("last_term")
    ).withColumnRenamed("chunk_id", "seq")


@query(
    "keyword_frequencies",
    "WITH" + TERMS_SQL + " SELECT term, count(*)::BIGINT AS chunk_frequency, count(DISTINCT source)::BIGINT AS doc_frequency FROM terms GROUP BY term",
)
def keyword_frequencies(spark, folder):
    rows = documents(spark, folder).withColumn("source_id", F.col("source"))
    return vocabulary.keyword_frequencies(vocabulary.keyword_links(rows))


@query(
    "keyword_frequencies_merged",
    "WITH" + TERMS_SQL + """ SELECT term, count(*)::BIGINT AS chunk_frequency, count(DISTINCT seq)::BIGINT AS doc_frequency,
    count(DISTINCT source)::BIGINT AS source_estimate FROM terms GROUP BY term""",
)
def keyword_frequencies_merged(spark, folder):
    """Partial counts of four batches, written and merged on read: by document (in one batch each) and by source (in all of them)."""
    links = vocabulary.keyword_links(documents(spark, folder).withColumn("source_id", F.struct("seq", "source")))
    links = links.withColumn("batch", F.pmod(F.col("source_id.seq"), F.lit(4)))
    by_document = durable(vocabulary.partial_counts(links.withColumn("source_id", F.col("source_id.seq")), sketches=False))
    by_source = durable(vocabulary.partial_counts(links.withColumn("source_id", F.col("source_id.source"))))
    exact = vocabulary.merged_counts(by_document)
    return exact.join(vocabulary.merged_counts(by_source).select("term", "source_estimate"), "term")


@query(
    "keyword_listing",
    "WITH" + TERMS_SQL + " SELECT term, count(*)::BIGINT AS chunk_frequency FROM terms WHERE contains(term, 'ent') GROUP BY term ORDER BY count(*) DESC, term LIMIT 100 OFFSET 20",
)
def keyword_listing(spark, folder):
    rows = documents(spark, folder).withColumn("source_id", F.col("source"))
    frequencies = vocabulary.keyword_frequencies(vocabulary.keyword_links(rows))
    return vocabulary.list_keywords(frequencies, "ENT", 100, 20).select("term", "chunk_frequency")


LABELLED = (
    "Price: €%.2f, quantity %d; discount %d%%; tax %d %%. Weight %dkg, version 1.2.%d. Created %s and updated %s."
)


def labelled_lines(spark, folder):
    """One labelled sentence per line item."""
    items = table(spark, folder, "lineitem", "l_orderkey")
    return items.select(
        "l_orderkey",
        "l_linenumber",
        F.format_string(
            LABELLED,
            "l_extendedprice",
            F.col("l_quantity").cast("int"),
            F.round(F.col("l_discount") * 100).cast("int"),
            F.round(F.col("l_tax") * 100).cast("int"),
            F.col("l_linenumber").cast("int"),
            F.col("l_linenumber").cast("int"),
            F.date_format("l_shipdate", "yyyy-MM-dd"),
            F.date_format("l_shipdate", "d MMMM yyyy"),
        ).alias("text"),
    )


LABELLED_SQL = """
src AS (
  SELECT l_orderkey, l_linenumber, l_extendedprice, l_quantity, round(l_discount * 100) AS disc, round(l_tax * 100) AS tax, l_shipdate,
         printf('Price: €%.2f, quantity %d; discount %d%%; tax %d %%. Weight %dkg, version 1.2.%d. Created %s and updated %s.',
                l_extendedprice, l_quantity::INTEGER, round(l_discount * 100)::INTEGER, round(l_tax * 100)::INTEGER,
                l_linenumber::INTEGER, l_linenumber::INTEGER, strftime(l_shipdate, '%Y-%m-%d'), strftime(l_shipdate, '%-d %B %Y')) AS text
  FROM lineitem),
facts AS (
  SELECT *, 'price' AS field, round(l_extendedprice, 2) AS number, NULL AS day, 'EUR' AS currency, NULL AS unit, strpos(text, 'Price') - 1 AS start FROM src
  UNION ALL SELECT *, 'quantity', l_quantity, NULL, NULL, NULL, strpos(text, 'quantity') - 1 FROM src
  UNION ALL SELECT *, 'discount_percent', disc, NULL, NULL, (disc / 100)::VARCHAR, strpos(text, 'discount') - 1 FROM src
  UNION ALL SELECT *, 'tax_percent', tax, NULL, NULL, (tax / 100)::VARCHAR, strpos(text, 'tax') - 1 FROM src
  UNION ALL SELECT *, 'weight', l_linenumber, NULL, NULL, 'kg', strpos(text, 'Weight') - 1 FROM src
  UNION ALL SELECT *, 'created_date', NULL, strftime(l_shipdate, '%Y-%m-%dT00:00:00Z'), NULL, NULL, strpos(text, 'Created ') + 7 FROM src
  UNION ALL SELECT *, 'updated_date', NULL, strftime(l_shipdate, '%Y-%m-%dT00:00:00Z'), NULL, NULL, strpos(text, 'updated ') + 7 FROM src)"""


@query(
    "facts_of_line_items",
    "WITH" + LABELLED_SQL + """ SELECT l_orderkey, l_linenumber, field, number::DOUBLE AS normalized_number, day AS normalized_date_utc,
    currency AS currency_code, unit, start::BIGINT AS char_start,
    (start + length(regexp_extract(substr(text, start + 1),
       '^(Price: €[0-9.]+|quantity [0-9]+|discount [0-9]+%|tax [0-9]+ %|Weight [0-9]+kg|[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]+ [A-Z][a-z]+ [0-9]{4})')))::BIGINT AS char_end FROM facts""",
)
def facts_of_line_items(spark, folder):
    facts = extract_facts(labelled_lines(spark, folder))
    return facts.select(
        "l_orderkey", "l_linenumber", "field", "normalized_number", "normalized_date_utc", "currency_code", "unit",
        F.col("char_start").cast("bigint").alias("char_start"), F.col("char_end").cast("bigint").alias("char_end"),
    )


@query(
    "number_fact_spans",
    """WITH src AS (
      SELECT l_orderkey, l_linenumber, l_quantity::INTEGER AS q,
             printf('Rating %d stars, count: %d x 2, rank #%d  of many, score %d', l_linenumber::INTEGER, l_quantity::INTEGER, l_linenumber::INTEGER, l_quantity::INTEGER) AS text
      FROM lineitem),
    named AS (
      SELECT *, unnest([{'field': 'rating', 'raw': regexp_extract(text, 'Rating [0-9]+'), 'n': l_linenumber::DOUBLE, 'more': 1},
                        {'field': 'count', 'raw': regexp_extract(text, 'count: [0-9]+'), 'n': q::DOUBLE, 'more': 0},
                        {'field': 'rank', 'raw': regexp_extract(text, 'rank #[0-9]+'), 'n': l_linenumber::DOUBLE, 'more': 2},
                        {'field': 'score', 'raw': regexp_extract(text, 'score [0-9]+'), 'n': q::DOUBLE, 'more': 0}]) AS f FROM src)
    SELECT l_orderkey, l_linenumber, f.field AS field, f.raw AS raw_value, f.n AS normalized_number,
           (strpos(text, f.raw) - 1)::BIGINT AS char_start, (strpos(text, f.raw) - 1 + length(f.raw) + f.more)::BIGINT AS char_end FROM named""",
)
def number_fact_spans(spark, folder):
    """Spans of plain numbers reach over the white space that follows, but not to a multiplication sign."""
    n, q = F.col("l_linenumber").cast("int"), F.col("l_quantity").cast("int")
    text = F.format_string("Rating %d stars, count: %d x 2, rank #%d  of many, score %d", n, q, n, q)
    facts = extract_facts(table(spark, folder, "lineitem", "l_orderkey").select("l_orderkey", "l_linenumber", text.alias("text")))
    return facts.select(
        "l_orderkey", "l_linenumber", "field", "raw_value", "normalized_number",
        F.col("char_start").cast("bigint").alias("char_start"), F.col("char_end").cast("bigint").alias("char_end"),
    )


NUMBER_LABELS = ("rating", "score", "rank", "count", "quantity", "version")


@query(
    "facts_of_documents",
    " UNION ALL ".join(
        rf"""SELECT doc_id, '{label}' AS field, try_cast(replace(v, ',', '') AS DOUBLE) AS normalized_number FROM (
        SELECT doc_id, unnest(regexp_extract_all(text, '(?i)(?:^|[^\p{{L}}\p{{N}}_]){label}\s*[:=]?\s*[#v]?(\d+(?:[.,]\d+)*)', 1)) AS v FROM documents)
        WHERE try_cast(replace(v, ',', '') AS DOUBLE) IS NOT NULL"""
        for label in NUMBER_LABELS
    ),
)
def facts_of_documents(spark, folder):
    facts = extract_facts(table(spark, folder, "documents", "doc_id").select("doc_id", "text"))
    return facts.filter(F.col("field").isin(*NUMBER_LABELS)).select("doc_id", "field", "normalized_number")

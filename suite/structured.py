"""Filters over facts and keywords, and the bookkeeping read models."""

from __future__ import annotations

from pyspark.sql import functions as F

from folionaut.functions.facts import extract_facts
from folionaut.operators import catalog, vocabulary
from folionaut.operators.durable import durable
from folionaut.operators.filters import filter_chunks
from folionaut.plans.requests import NumericFilter, SearchFilters
from folionaut.sources import listing
from suite.registry import DOCUMENTS_SQL, documents, query, table

OFFER = "%s: Price: $%.2f for size %d. Rating %d.%d, published %s"


def offers(spark, folder):
    """One offer text per part."""
    day = F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (F.col("p_partkey") % 1000).cast("int")), "yyyy-MM-dd")
    text = F.format_string(
        OFFER, "p_name", "p_retailprice", F.col("p_size").cast("int"), (F.col("p_size") % 5).cast("int"),
        (F.col("p_size") % 10).cast("int"), day,
    )
    return table(spark, folder, "part", "p_partkey").select(
        F.col("p_partkey").alias("seq"), F.col("p_partkey").alias("chunk_id"), F.col("p_partkey").alias("source_id"), text.alias("text"),
        F.lit(None).cast("string").alias("heading"), F.lit(None).cast("string").alias("section_path"), F.concat(F.col("p_brand"), F.lit(".txt")).alias("filename"),
        F.lower("p_type").alias("extension"), F.concat(F.lit("/parts/"), "p_brand", F.lit("/"), F.col("p_partkey").cast("string")).alias("path"),
    )


OFFERS_SQL = """
offers AS (
  SELECT p_partkey AS seq, round(p_retailprice, 2) AS price, (p_size % 5) + (p_size % 10) / 10.0 AS rating,
         strftime(DATE '2020-01-01' + (p_partkey % 1000)::INTEGER, '%Y-%m-%dT00:00:00Z') AS day,
         lower(p_type) AS extension, '/parts/' || p_brand || '/' || p_partkey AS path,
         lower(p_name) AS name FROM part)"""


def filtered(wanted: SearchFilters):
    def run(spark, folder):
        rows = offers(spark, folder)
        facts = extract_facts(rows.select("chunk_id", "text"))
        if len(wanted.numeric) > 1:
            facts = durable(facts)
        keywords = vocabulary.keyword_links(rows) if wanted.keywords else None
        kept, _, _ = filter_chunks(rows, facts, keywords, wanted)
        return kept.select("seq", F.lit(1.0).alias("score"))

    return run


def numeric(*filters, **rest) -> SearchFilters:
    return SearchFilters(numeric=tuple(filters), **rest)


CASES = {
    "equal": (numeric(NumericFilter("price", "equal", 901.0)), "price = 901.0"),
    "not_equal": (numeric(NumericFilter("price", "not_equal", 901.0)), "price <> 901.0"),
    "less_than": (numeric(NumericFilter("price", "less_than", 950.0)), "price < 950"),
    "less_than_or_equal": (numeric(NumericFilter("cost", "less_than_or_equal", "950")), "price <= 950"),
    "greater_than": (numeric(NumericFilter("price", "greater_than", 950.5)), "price > 950.5"),
    "greater_than_or_equal": (numeric(NumericFilter("rating", "greater_than_or_equal", 3.5)), "rating >= 3.5"),
    "between": (numeric(NumericFilter("price", "between", low=910, high=930)), "price BETWEEN 910 AND 930"),
    "exists": (numeric(NumericFilter("rating", "exists")), "true"),
    "currency": (numeric(NumericFilter("price", "greater_than", 905, currency="usd")), "price > 905"),
    "currency_mismatch": (numeric(NumericFilter("price", "greater_than", 905, currency="EUR")), "false"),
    "date": (numeric(NumericFilter("published_date", "greater_than_or_equal", "2021-03-01")), "day >= '2021-03-01T00:00:00Z'"),
    "date_between": (
        numeric(NumericFilter("published_date", "between", low="2020-06-01", high="2020-09-30")),
        "day BETWEEN '2020-06-01T00:00:00Z' AND '2020-09-30T00:00:00Z'",
    ),
    "unknown_field_is_skipped": (
        numeric(NumericFilter("colour", "equal", 1), NumericFilter("price", "less_than", 950)), "price < 950",
    ),
    "intersection": (
        numeric(
            NumericFilter("cost", "greater_than", 905, currency="USD"), NumericFilter("rating", "less_than", 3),
            NumericFilter("published_date", "less_than", "2021-01-01"), source_extensions=("ECONOMY", ".small"), path_prefix="/parts/Brand#1",
        ),
        "price > 905 AND rating < 3 AND day < '2021-01-01T00:00:00Z' AND extension IN ('economy', 'small') AND path LIKE '/parts/Brand#1%'",
    ),
    "keywords_all": (SearchFilters(keywords=(" Red ", "widget")), "list_contains(string_split(name, ' '), 'red') AND list_contains(string_split(name, ' '), 'widget')"),
    "source_ids": (SearchFilters(source_ids=(3, 17, 99, 150, 1024)), "seq IN (3, 17, 99, 150, 1024)"),
}
for case, (wanted_filters, condition) in CASES.items():
    query(f"filter_{case}", "WITH" + OFFERS_SQL + f" SELECT seq, 1.0::DOUBLE AS score FROM offers WHERE {condition}")(filtered(wanted_filters))


def sources(spark, folder):
    """The document rows as a source table."""
    rows = documents(spark, folder)
    deleted = F.when(F.col("deleted"), F.lit("2026-01-01T00:00:00Z"))
    return rows.withColumn("deleted_at", deleted).withColumn("content_hash", F.sha2("text", 256))


@query("status_counts", "WITH" + DOCUMENTS_SQL + " SELECT status, count(*)::BIGINT AS sources FROM rows_ WHERE NOT deleted GROUP BY status")
def status_counts(spark, folder):
    return catalog.status_counts(sources(spark, folder))


@query(
    "collection_counts",
    "WITH" + DOCUMENTS_SQL + """ SELECT count(*) FILTER (NOT deleted)::BIGINT AS sources, count(*) FILTER (candidate)::BIGINT AS indexed_sources,
    count(*) FILTER (NOT deleted AND status = 'failed')::BIGINT AS failed_sources, count(*)::BIGINT AS chunks FROM rows_""",
)
def collection_counts(spark, folder):
    return catalog.collection_counts(sources(spark, folder), documents(spark, folder))


@query(
    "list_files_page",
    "WITH" + DOCUMENTS_SQL + """ SELECT seq, filename, status FROM rows_ WHERE NOT deleted AND extension = 'txt' AND path LIKE '/data/src1%'
    AND status = 'indexed' ORDER BY filename, seq LIMIT 40 OFFSET 25""",
)
def list_files_page(spark, folder):
    return catalog.list_files(sources(spark, folder), ".TXT", "/data/src1", "indexed", 40, 25).select("seq", "filename", "status")


@query("manifest", "WITH" + DOCUMENTS_SQL + " SELECT path, status, sha256(text) AS content_hash FROM rows_ WHERE NOT deleted ORDER BY path")
def manifest(spark, folder):
    return catalog.manifest(sources(spark, folder)).select("path", "status", "content_hash")


CHANGED_SQL = """
now_ AS (
  SELECT path, extension, CASE WHEN lang = 'es' THEN sha256(text || '!') ELSE sha256(text) END AS content_hash FROM rows_ WHERE source <> 'src3'),
before AS (SELECT path, status, sha256(text) AS content_hash FROM rows_ WHERE NOT deleted AND source <> 'src4')"""


def two_listings(spark, folder):
    """What a scan sees now and what was indexed: one source is new, one is gone, Spanish texts have changed."""
    rows = sources(spark, folder)
    text = F.when(F.col("lang") == "es", F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    now = rows.filter(F.col("source") != "src3").select("path", "extension", F.sha2(text, 256).alias("content_hash"))
    before = rows.filter(F.col("deleted_at").isNull() & (F.col("source") != "src4")).select("path", "status", "content_hash", "source_id")
    return now, before


@query(
    "scan_classification",
    "WITH" + DOCUMENTS_SQL + "," + CHANGED_SQL + """
SELECT n.path, CASE WHEN n.extension = 'html' THEN 'unsupported' WHEN b.path IS NULL THEN 'new' WHEN b.status = 'failed' THEN 'previously_failed'
  WHEN b.content_hash = n.content_hash THEN 'unchanged' ELSE 'changed' END AS classification FROM now_ n LEFT JOIN before b USING (path)""",
)
def scan_classification(spark, folder):
    now, before = two_listings(spark, folder)
    return listing.classify(now, before, F.col("extension") != "html").select("path", "classification")


@query(
    "missing_sources",
    "WITH" + DOCUMENTS_SQL + "," + CHANGED_SQL + " SELECT path FROM before WHERE path NOT IN (SELECT path FROM now_)",
)
def missing_sources(spark, folder):
    now, before = two_listings(spark, folder)
    return listing.missing_sources(before, now).select("path")


@query(
    "chunks_after_removal",
    "WITH" + DOCUMENTS_SQL + "," + CHANGED_SQL + ", gone AS (SELECT path FROM before WHERE path NOT IN (SELECT path FROM now_)) SELECT seq FROM rows_ WHERE path NOT IN (SELECT path FROM gone)",
)
def chunks_after_removal(spark, folder):
    now, before = two_listings(spark, folder)
    removed = listing.missing_sources(before, now)
    return catalog.without_sources(documents(spark, folder), removed).select("seq")


@query(
    "latest_version_per_source",
    "SELECT user_id, max_by(event_id, (ts, event_id)) AS event_id, max_by(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id",
)
def latest_version_per_source(spark, folder):
    versions = table(spark, folder, "events", "event_id")
    return catalog.latest_per_key(versions, "user_id", "ts", "event_id", ["event_id", "event_type"])


@query(
    "first_writer_wins",
    "SELECT user_id, min(event_id) AS event_id, count(*)::BIGINT - 1 AS rejected FROM events GROUP BY user_id",
)
def first_writer_wins(spark, folder):
    rows = table(spark, folder, "events", "event_id").select("user_id", "event_id")
    accepted, rejected = catalog.first_per_key(rows, "user_id", ["event_id"])
    counts = rejected.groupBy("user_id").agg(F.count("*").alias("rejected"))
    joined = accepted.join(counts, "user_id", "left")
    return joined.select("user_id", "event_id", F.coalesce("rejected", F.lit(0)).alias("rejected"))


@query("audit_retention", "SELECT event_type, count(*)::BIGINT AS kept FROM events WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY event_type")
def audit_retention(spark, folder):
    kept = catalog.prune_before(table(spark, folder, "events"), "ts", F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"))
    return kept.groupBy("event_type").agg(F.count("*").alias("kept"))


JOB_STATES = ["queued", "running", "running", "completed", "completed_with_errors", "failed", "cancelled"]


@query(
    "job_progress",
    """WITH jobs AS (
  SELECT o_orderkey, (['queued', 'running', 'running', 'completed', 'completed_with_errors', 'failed', 'cancelled'])[o_orderkey % 7 + 1] AS status,
         o_orderkey % 2 = 0 AS indexing, (o_custkey % 40)::INTEGER AS total, o_custkey % 11 AS a, o_orderkey % 5 AS b, o_orderdate AS t FROM orders),
p AS (SELECT *, (a + b)::BIGINT AS processed, status IN ('queued', 'running') AS active, status LIKE 'completed%' AS complete FROM jobs)
SELECT o_orderkey, status, processed,
  round(CASE WHEN total > 0 THEN least(100.0, 100.0 * processed / total) WHEN complete THEN 100.0 END, 6)::DOUBLE AS percent,
  CASE WHEN complete THEN 'finished' WHEN NOT active THEN status WHEN indexing THEN 'indexing' ELSE 'discovering' END AS phase,
  (CASE WHEN active THEN 90.0 ELSE 60.0 END)::DOUBLE AS elapsed_seconds,
  round(CASE WHEN complete THEN 0.0 WHEN active AND indexing AND processed > 0 THEN 80.0 / processed * greatest(0, total - processed) END, 1)::DOUBLE AS estimated_remaining_seconds
FROM p""",
)
def job_progress(spark, folder):
    orders = table(spark, folder, "orders", "o_orderkey")
    start = F.col("o_orderdate").cast("timestamp")
    jobs = orders.select(
        "o_orderkey",
        F.get(F.array(*[F.lit(s) for s in JOB_STATES]), (F.col("o_orderkey") % 7).cast("int")).alias("status"),
        F.when(F.col("o_orderkey") % 2 == 0, "indexing").otherwise("discovering").alias("phase"),
        (F.col("o_custkey") % 40).cast("int").alias("total"),
        (F.col("o_custkey") % 11).alias("completed"), (F.col("o_orderkey") % 5).alias("unchanged"),
        F.lit(0).alias("failed"), F.lit(None).cast("int").alias("skipped"),
        start.alias("started_at"), (start + F.expr("INTERVAL 10 SECONDS")).alias("processing_started_at"),
        (start + F.expr("INTERVAL 60 SECONDS")).alias("finished_at"), start.alias("updated_at"),
        (start + F.expr("INTERVAL 90 SECONDS")).alias("now"),
    )
    progress = catalog.job_progress(jobs, F.col("now"))
    return progress.select(
        "o_orderkey", "status", F.col("processed").cast("bigint").alias("processed"), F.round("percent", 6).alias("percent"),
        "phase", "elapsed_seconds", "estimated_remaining_seconds",
    )

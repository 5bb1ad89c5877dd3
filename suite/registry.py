"""Registry of queries: a Spark callable and, where SQL can say the same, its DuckDB text."""

from __future__ import annotations

import shutil
import tempfile
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict = {}
_SHIPPED: set[str] = set()


#: Rows of one Arrow batch. A worker holds some batches and what is parsed from them, and pages and files are large rows.
BATCH_ROWS = 1000


def ship(spark: SparkSession) -> None:
    """Give the Python workers the package, wherever the driver was started, and keep their batches short."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        home = Path(__file__).resolve().parent.parent
        folder = tempfile.mkdtemp(prefix="folionaut-package-")
        context.addPyFile(shutil.make_archive(f"{folder}/folionaut", "zip", home, "folionaut"))
        _SHIPPED.add(context.applicationId)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def query(name: str, sql: str | None = None):
    def register(function):
        @wraps(function)
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship(spark)
            return function(spark, folder)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, folder: str, name: str, key: str | None = None) -> DataFrame:
    """A given table. A table of fewer files than cores is spread by its key; a large one is read as it is."""
    frame = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if key and len(frame.inputFiles()) < cores:
        frame = frame.repartition(cores, key)
    return frame


def states(spark: SparkSession, folder: str, rows: DataFrame) -> DataFrame:
    """Rows with ``status`` and ``deleted`` of their document, from the labels. Narrow rows keep the join small."""
    labels = table(spark, folder, "labels").withColumnRenamed("doc_id", "seq")
    gone = (F.col("quality") == 0) & (F.col("toxic") == 0)
    return rows.join(labels, "seq", "left").select(
        *rows.columns, F.when(F.col("toxic") == 1, "failed").otherwise("indexed").alias("status"), F.coalesce(gone, F.lit(False)).alias("deleted")
    )


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as text rows of a collection: status from the labels, suffix from the language."""
    return states(spark, folder, texts(spark, folder))


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """The same rows without what the labels say."""
    docs = table(spark, folder, "documents", "doc_id")
    suffix = (
        F.when(F.col("lang") == "en", "txt").when(F.col("lang") == "fr", "md").when(F.col("lang") == "de", "html").otherwise("log")
    )
    filename = F.concat("source", F.lit("-"), F.col("doc_id").cast("string"), F.lit("."), suffix)
    return docs.select(
        F.col("doc_id").alias("seq"),
        F.col("doc_id").alias("source_id"),
        F.col("doc_id").alias("chunk_id"),
        "text",
        F.lit(None).cast("string").alias("heading"),
        F.lit(None).cast("string").alias("section_path"),
        filename.alias("filename"),
        suffix.alias("extension"),
        F.concat(F.lit("/data/"), "source", F.lit("/"), filename).alias("path"),
        "lang",
        "source",
    )


# The same rows in SQL, to be put after WITH.
DOCUMENTS_SQL = """
docs AS (
  SELECT d.doc_id AS seq, d.text, d.lang, d.source,
         CASE d.lang WHEN 'en' THEN 'txt' WHEN 'fr' THEN 'md' WHEN 'de' THEN 'html' ELSE 'log' END AS extension,
         CASE WHEN l.toxic = 1 THEN 'failed' ELSE 'indexed' END AS status,
         coalesce(l.quality = 0 AND l.toxic = 0, false) AS deleted
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
rows_ AS (
  SELECT *, source || '-' || seq || '.' || extension AS filename,
         '/data/' || source || '/' || source || '-' || seq || '.' || extension AS path,
         status = 'indexed' AND NOT deleted AS candidate
  FROM docs)"""

# Token lists of the text and of the file name, their length, and BM25 over one-token words.
TOKENS_SQL = DOCUMENTS_SQL + """,
toks AS (
  SELECT seq, candidate, lang,
         regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+') AS a,
         regexp_extract_all(strip_accents(lower(filename)), '[\\p{L}\\p{N}]+') AS b
  FROM rows_),
lens AS (SELECT seq, len(a) + len(b) AS dl FROM toks),
stats AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM lens),
words AS (
  SELECT seq, unnest(a) AS term FROM toks UNION ALL SELECT seq, unnest(b) FROM toks),
post AS (SELECT seq, term, count(*)::BIGINT AS tf FROM words GROUP BY ALL)"""


def bm25_sql(words: dict[str, int], more: str = "") -> str:
    """CTE ``scores(seq, keyword_score)`` for one-token query words with their multiplicity."""
    wanted = ", ".join(f"('{word}', {count})" for word, count in words.items())
    return TOKENS_SQL + f""",
wanted(term, weight) AS (VALUES {wanted}),
hits AS (SELECT p.*, w.weight, count(*) OVER (PARTITION BY p.term)::DOUBLE AS df FROM post p JOIN wanted w USING (term)),
scores AS (
  SELECT h.seq, sum(h.weight * CASE WHEN ln((s.n - h.df + 0.5) / (h.df + 0.5)) > 0
                                    THEN ln((s.n - h.df + 0.5) / (h.df + 0.5)) ELSE 1e-6 END
                 * h.tf * 2.2 / (h.tf + 1.2 * (0.25 + 0.75 * l.dl / s.avgdl))) AS keyword_score
  FROM hits h JOIN lens l USING (seq), stats s GROUP BY h.seq){more}"""

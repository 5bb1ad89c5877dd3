"""A collection on shared storage: append-only Parquet batches and snapshots of the source table.

Every derived row carries the batch that wrote it. The source table says which batch of a source is
current, so replacing or removing a source rewrites no other data, a failed extraction leaves the
earlier rows in force, and a batch that is run again overwrites only its own folders.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folionaut.functions import names
from folionaut.functions.facts import FIELDS, extract_facts
from folionaut.functions.text import stable_id
from folionaut.operators import bm25, catalog, graph
from folionaut.operators.chunking import chunk_documents
from folionaut.operators.durable import durable
from folionaut.operators.vocabulary import keyword_frequencies, keyword_links, list_keywords
from folionaut.plans.search import DocumentTables
from folionaut.settings import FolioError, Settings
from folionaut.sources import outline
from folionaut.sources.extract import SUPPORTED, extract_blocks, reparsed_as_markdown
from folionaut.sources.listing import classify, describe_files
from folionaut.sources.pycode import parse_python

SOURCE_DDL = (
    "source_id string, path string, filename string, extension string, size_bytes bigint, content_hash string, status string, "
    "status_detail string, batch bigint, version int, deleted_at timestamp"
)
DERIVED = ("chunks", "vectors", "facts", "keywords", "postings", "graph_entities", "graph_edges")
# Batch ids from here on belong to streams.
STREAM_BATCHES = 1 << 40
JOB_DDL = (
    "job_id string, kind string, status string, total bigint, unchanged bigint, completed bigint, failed bigint, skipped bigint, "
    "started_at timestamp, finished_at timestamp"
)


class Collection:
    def __init__(self, spark: SparkSession, root: str, embedder, kind: str = "general", settings: Settings = Settings()):
        if kind not in ("general", "source_code"):
            raise FolioError("CONFIG_INVALID", f"unknown kind {kind}")
        self.spark, self.root, self.embedder, self.kind, self.settings = spark, root.rstrip("/"), embedder, kind, settings

    # ---- folders ----------------------------------------------------------------------------------------------

    def _list(self, folder: str) -> list[str]:
        """Names of finished writes in a folder."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{folder}")
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(path):
            return []
        entries = [entry.getPath() for entry in files.listStatus(path)]
        return [p.getName() for p in entries if files.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]

    def _versions(self) -> list[int]:
        return sorted(int(name.partition("=")[2]) for name in self._list("sources"))

    def sources(self) -> DataFrame:
        versions = self._versions()
        if not versions:
            return self.spark.createDataFrame([], SOURCE_DDL)
        return self.spark.read.schema(SOURCE_DDL).parquet(f"{self.root}/sources/snapshot={versions[-1]}")

    def _commit_sources(self, rows: DataFrame) -> None:
        versions = self._versions()
        number = versions[-1] + 1 if versions else 0
        rows.write.mode("overwrite").parquet(f"{self.root}/sources/snapshot={number}")

    def next_batch(self) -> int:
        """Scans count their batches; those of streams have ids of their own above."""
        numbers = (int(name.partition("=")[2]) for name in self._list("documents"))
        return max((n for n in numbers if n < STREAM_BATCHES), default=-1) + 1

    def _derived(self, name: str) -> DataFrame | None:
        batches = self._list(name)
        if not batches:
            return None
        paths = [f"{self.root}/{name}/{batch}" for batch in batches]
        return self.spark.read.option("basePath", f"{self.root}/{name}").parquet(*paths)

    def current(self, name: str) -> DataFrame | None:
        """Rows of a derived table that belong to the current batch of their source."""
        rows = self._derived(name)
        if rows is None:
            return None
        live = self.sources().filter(F.col("batch").isNotNull()).select("source_id", F.col("batch").cast("bigint").alias("batch"))
        return rows.withColumn("batch", F.col("batch").cast("bigint")).join(live, ["source_id", "batch"], "left_semi")

    # ---- writing ----------------------------------------------------------------------------------------------

    def index(self, files: DataFrame, batch: int | None = None) -> dict[str, int]:
        """Bring the listed files up to date; returns how many fell into each class."""
        batch = self.next_batch() if batch is None else batch
        started = datetime.now(timezone.utc)
        known = self.sources()
        supported = F.col("extension").isin(*SUPPORTED) if self.kind == "general" else F.lit(True)
        # The hashing pass reads every file once; only its narrow result is kept.
        classified = durable(classify(files.drop("content"), known.filter(F.col("deleted_at").isNull()), supported))
        counts = {row["classification"]: row["count"] for row in classified.groupBy("classification").count().collect()}
        work = classified.filter(F.col("classification").isin("new", "changed", "previously_failed"))
        if not work.isEmpty():
            # A file that changes between the two reads drops out here and is retried by the next scan.
            self._write_batch(files.join(work.select("path", "content_hash"), ["path", "content_hash"], "left_semi"), batch)
        self._commit_sources(self._merged(known, classified, batch))
        self._log_job(batch, counts, started)
        return counts

    def _log_job(self, batch: int, counts: dict[str, int], started: datetime) -> None:
        total, work = sum(counts.values()), sum(counts.get(name, 0) for name in ("new", "changed", "previously_failed"))
        failed = 0
        if work:
            documents = self.spark.read.parquet(f"{self.root}/documents/batch={batch}")
            failed = documents.filter(F.col("error").isNotNull()).count()
        status = "completed_with_errors" if failed else "completed"
        row = (
            f"scan-{batch}", "scan", status, total, counts.get("unchanged", 0), work - failed, failed,
            counts.get("unsupported", 0), started, datetime.now(timezone.utc),
        )
        self.spark.createDataFrame([row], JOB_DDL).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/jobs/run={batch}")

    def _write_batch(self, work: DataFrame, batch: int) -> None:
        folder = {name: f"{self.root}/{name}/batch={batch}" for name in (*DERIVED, "documents")}
        extracted = extract_blocks(work, self.kind)
        if self.kind == "general":
            extracted = reparsed_as_markdown(extracted).drop("source_text")
        extracted.write.mode("overwrite").parquet(folder["documents"])
        documents = self.spark.read.parquet(folder["documents"]).filter(F.col("error").isNull())
        code = self.kind == "source_code"
        size, overlap = (self.settings.code_chunk_size, self.settings.code_chunk_overlap) if code else (self.settings.chunk_size, self.settings.chunk_overlap)
        chunks = chunk_documents(
            documents, size, overlap, code=F.col("extractor").startswith("source_code"), keep=("source_id", "filename", "extension", "path")
        )
        order = F.concat_ws(":", F.lpad(F.lit(str(batch)), 20, "0"), "source_id", F.lpad(F.col("chunk_index").cast("string"), 19, "0"))
        # The indexed length stays with the chunk, so collection statistics read one narrow column.
        keyed = chunks.withColumn("seq", order).withColumn("chunk_id", stable_id(F.col("seq")))
        keyed.withColumn("length", bm25.token_total(bm25.TEXT_COLUMNS)).write.mode("overwrite").parquet(folder["chunks"])
        # Everything else derives from the chunks as written.
        written = self.spark.read.parquet(folder["chunks"])
        owner = ("seq", "chunk_id", "source_id")
        vectors = written.select(*owner, self.embedder.column(F.col("text")).alias("embedding"))
        vectors.write.mode("overwrite").parquet(folder["vectors"])
        facts = extract_facts(written.select(*owner, "text"), locale=self.settings.locale)
        facts.write.mode("overwrite").parquet(folder["facts"])
        keyword_links(written).write.mode("overwrite").parquet(folder["keywords"])
        keyed = written.withColumn("_key", F.struct("seq", "source_id"))
        index = bm25.postings(keyed, key="_key").select("_key.seq", "_key.source_id", "term", "tf", "length", "positions")
        index.repartitionByRange("term", "seq").sortWithinPartitions("term", "seq").write.mode("overwrite").parquet(folder["postings"])

        if self.kind == "source_code":
            self._write_graph(documents, folder)

    def _write_graph(self, documents: DataFrame, folder: dict[str, str]) -> None:
        """Names and edges of the source texts: Python by its syntax, other known languages by outline."""
        path, language = F.coalesce("relative_path", "path"), names.language(F.col("path"))
        files = documents.filter(F.col("source_text").isNotNull() & language.isNotNull()).select(
            "source_id", F.lit("root").alias("root_key"), path.alias("path"), language.alias("language"),
            names.module_key(path, language).alias("module_key"), F.col("source_text").alias("text"),
        )
        python = durable(parse_python(files.filter(F.col("language") == "python")))
        others = outline.with_package(files.filter(F.col("language") != "python"))
        columns = ("entity_id", "source_id", "root_key", "path", "module_key", "language", "family", "kind", "name", "qualified_name", "full_key", "line_start", "line_end", "signature")
        known = graph.entities(python).select(*columns).unionByName(outline.entities(others).select(*columns))
        known.write.mode("overwrite").parquet(folder["graph_entities"])
        graph.observed_edges(python).unionByName(outline.edges(others)).write.mode("overwrite").parquet(folder["graph_edges"])

    def _merged(self, known: DataFrame, classified: DataFrame, batch: int) -> DataFrame:
        """The next source table: listed files take their new state, all others keep theirs."""
        handled = F.col("classification").isin("new", "changed", "previously_failed")
        outcome = self.spark.createDataFrame([], "source_id string, error string")
        if f"batch={batch}" in self._list("documents"):
            outcome = self.spark.read.parquet(f"{self.root}/documents/batch={batch}").select("source_id", "error")
        old = known.select("source_id", F.col("batch").alias("_batch"), F.col("version").alias("_version"), F.col("content_hash").alias("_hash"), F.col("status").alias("_status"))
        listed = classified.join(outcome.withColumn("_done", F.lit(True)), "source_id", "left").join(old, "source_id", "left")
        done = handled & F.col("_done").isNotNull() & F.col("error").isNull()
        status = F.when(F.col("classification") == "unsupported", "unsupported").when(~handled, F.col("_status")).when(done, "indexed").otherwise("failed")
        fresh = listed.select(
            "source_id", "path", "filename", "extension", "size_bytes",
            F.when(done | F.col("_hash").isNull(), F.col("content_hash")).otherwise(F.col("_hash")).alias("content_hash"),
            status.alias("status"), F.col("error").alias("status_detail"),
            F.when(done, F.lit(batch)).otherwise(F.col("_batch")).cast("bigint").alias("batch"),
            (F.coalesce("_version", F.lit(0)) + F.when(done, 1).otherwise(0)).cast("int").alias("version"),
            F.lit(None).cast("timestamp").alias("deleted_at"),
        )
        return known.join(fresh.select("source_id"), "source_id", "left_anti").unionByName(fresh)

    def remove(self, source_ids: list[str]) -> None:
        gone = F.col("source_id").isin(source_ids)
        self._commit_sources(
            self.sources().withColumns(
                {
                    "deleted_at": F.when(gone, F.current_timestamp()).otherwise(F.col("deleted_at")),
                    "batch": F.when(~gone, F.col("batch")),
                }
            )
        )

    def prune_missing(self, files: DataFrame, root: str) -> None:
        """Sources below ``root`` whose file is not in its listing lose their rows and become ``missing``.

        Other roots, uploads and removed sources stay as they are.
        """
        seen = files.select("path", F.lit(True).alias("_seen")).distinct()
        marked = self.sources().join(seen, "path", "left")
        inside = F.startswith("path", F.lit(root.removeprefix("file:").rstrip("/") + "/"))
        kept = F.col("_seen").isNotNull() | ~inside | F.col("deleted_at").isNotNull()
        self._commit_sources(
            marked.withColumns({"status": F.when(kept, F.col("status")).otherwise("missing"), "batch": F.when(kept, F.col("batch"))})
            .drop("_seen").select(*[part.split(" ")[0] for part in SOURCE_DDL.split(", ")])
        )

    def compact(self) -> int:
        """Write all current rows as one batch and point every source at it; old batches can then be dropped."""
        batch = self.next_batch()
        self.spark.createDataFrame([], "source_id string, error string").write.parquet(f"{self.root}/documents/batch={batch}")
        for name in DERIVED:
            rows = self.current(name)
            if rows is not None:
                order = ["term", "seq"] if name == "postings" else ["source_id"]
                rows.drop("batch").repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{self.root}/{name}/batch={batch}")
        moved = F.when(F.col("batch").isNotNull(), F.lit(batch)).cast("bigint")
        self._commit_sources(self.sources().withColumn("batch", moved))
        return batch

    def rebuild(self, files: DataFrame, confirm: bool = False) -> dict[str, int]:
        """Index everything anew; earlier rows stay in force until the new batch is complete."""
        require_confirmation(confirm)
        self._commit_sources(self.sources().withColumn("content_hash", F.lit("")))
        return self.index(files)

    def delete(self, confirm: bool = False) -> None:
        require_confirmation(confirm)
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def upload(self, filename: str, content_base64: str) -> dict[str, int]:
        """Index one file given as text, under the collection's own ``uploads`` path."""
        if not filename or "/" in filename or "\\" in filename or filename.startswith("."):
            raise FolioError("PATH_NOT_ALLOWED", "a plain file name is required")
        one = self.spark.createDataFrame([(f"{self.root}/uploads/{filename}", content_base64)], "path string, encoded string")
        content = one.select("path", F.unbase64("encoded").alias("content"), F.current_timestamp().alias("modificationTime"))
        return self.index(describe_files(content.withColumn("length", F.octet_length("content").cast("bigint")), f"{self.root}/uploads"))

    def export_manifest(self, folder: str) -> None:
        catalog.manifest(self.sources()).write.mode("overwrite").json(folder)

    # ---- reading ----------------------------------------------------------------------------------------------

    def tables(self) -> DocumentTables:
        """The tables of a search; statistics cover all current rows, whatever the state of their source."""
        source = self.sources().select("source_id", "status", "deleted_at")
        chunks = self.current("chunks")
        if chunks is None:
            raise FolioError("NOT_INDEXED", "index some files first")
        postings = self.current("postings")
        rows = chunks.join(source, "source_id")
        statistics = bm25.corpus_statistics(chunks)
        return DocumentTables(
            rows, self.current("facts"), self.current("keywords"), self.current("vectors"), postings, statistics, chunks, source
        )

    def graph(self) -> tuple[DataFrame, DataFrame]:
        """(entities, resolved edges) of the current, readable sources."""
        known, edges = self.current("graph_entities"), self.current("graph_edges")
        if known is None:
            raise FolioError("NOT_INDEXED", "index some source code first")
        live = self.sources().filter((F.col("status") == "indexed") & F.col("deleted_at").isNull()).select("source_id")
        known = known.join(live, "source_id", "left_semi")
        return known, graph.resolve(edges.join(live, "source_id", "left_semi").drop("batch"), known)

    def describe(self) -> dict:
        """Kind, counts and the fields that filters understand."""
        chunks = self.current("chunks")
        counts = catalog.collection_counts(self.sources(), chunks if chunks is not None else self.spark.range(0)).first().asDict()
        return {"kind": self.kind, "counts": counts, "fields": {name: kind for name, (kind, _) in FIELDS.items()}}

    def list_files(self, **filters) -> DataFrame:
        return catalog.list_files(self.sources(), **filters)

    def list_keywords(self, contains: str = "", limit: int = 50, offset: int = 0) -> DataFrame:
        return list_keywords(keyword_frequencies(self.current("keywords")), contains, limit, offset)

    def jobs(self) -> DataFrame:
        """Finished runs, newest first. A batch that is run again replaces its own row."""
        return self.spark.read.schema(JOB_DDL + ", run bigint").parquet(f"{self.root}/jobs").drop("run").orderBy(F.desc("started_at"))


def require_confirmation(confirm: bool) -> None:
    if not confirm:
        raise FolioError("CONFIRMATION_REQUIRED", "repeat with confirm=True")

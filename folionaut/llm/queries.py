"""The registered queries: each reads its whole table, applies one operator and derives the asked columns."""

from __future__ import annotations

import hashlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folionaut.llm import (
    counting, decontaminate, exactdedup, huffman, jaccard, lloyd, neighbours, packing, periodic, quality, repeats, secrets, toxicity,
)
from folionaut.llm.registry import ORACLES, QUERIES, query, table
from folionaut.llm.session import shared_folder, staged

__all__ = ["ORACLES", "QUERIES"]

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
END_ID = 2
TOKEN_LIMIT = 512
QUALITY_THRESHOLD = 0.7
TOXIC_THRESHOLD = 0.35


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACED = r"[^\x20\x09-\x0D]+"
_PLAIN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words_sql(text: str, pattern: str, lower: bool) -> str:
    text = f"coalesce({text}, '')"
    return f"regexp_extract_all({f"translate({text}, '{_UPPER}', '{_LOWER}')" if lower else text}, '{pattern}')"


REPEATS_SQL = f"""WITH dw AS (SELECT doc_id, {_words_sql('text', _SPACED, False)} AS w FROM documents),
win AS (SELECT doc_id, k, md5(array_to_string(w[k:k+19], ' ')) AS key FROM dw, unnest(range(1, len(w) - 18)) t(k) WHERE len(w) >= 20),
rep AS (SELECT doc_id, k FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id, k) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + 20)) AS p FROM rep),
placed AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM dw),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM placed ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
removed AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM dw LEFT JOIN kept USING (doc_id) LEFT JOIN removed USING (doc_id)"""

HITS_SQL = f"""WITH it AS (SELECT item_id::VARCHAR AS item, {_words_sql('text', _PLAIN, True)} AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(len(w), 10) AS m, array_to_string(w[k:k+least(len(w), 10)-1], ' ') AS key
        FROM it, unnest(range(1, greatest(len(w) - 9, 1) + 1)) t(k) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT m FROM win),
dw AS (SELECT doc_id, {_words_sql('text', _PLAIN, True)} AS w FROM documents),
places AS (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM dw, sizes WHERE len(w) >= m),
hit AS (SELECT doc_id, k, p.m, item FROM (SELECT doc_id, k, m, array_to_string(w[k:k+m-1], ' ') AS key FROM places) p JOIN win USING (m, key)),
words AS (SELECT DISTINCT doc_id, unnest(range(k, k + m)) AS p FROM hit),
n AS (SELECT doc_id, count(*) AS n_hit FROM words GROUP BY doc_id),
i AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN n USING (doc_id) LEFT JOIN i USING (doc_id)"""

LINKS_SQL = f"""WITH RECURSIVE dw AS (SELECT doc_id, {_words_sql('text', _SPACED, True)} AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, md5(array_to_string(w[k:k+3], ' ')) AS s FROM dw, unnest(range(1, greatest(len(w) - 3, 1) + 1)) t(k) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM both_ JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
reach(x, y) AS (SELECT x, y FROM link UNION SELECT reach.x, link.y FROM reach JOIN link ON reach.y = link.x),
least_ AS (SELECT x AS doc_id, min(y) AS c FROM reach GROUP BY x)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(c, doc_id)) AS component_id
FROM dw LEFT JOIN n USING (doc_id) LEFT JOIN least_ USING (doc_id)"""

COPIES_SQL = f"""WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)"""

CLUSTERS, ROUNDS, DIMENSIONS, SCALE = 40, 5, 64, 256


def _lloyd_sql() -> str:
    nearest = """a{0} AS MATERIALIZED (SELECT vec_id, arg_min(c, (dist, c)) AS c, min(dist) AS dist FROM (
  SELECT vec_id, c, sum((v.x - m.x) * (v.x - m.x)) AS dist FROM cells v JOIN m{0} m USING (d) GROUP BY vec_id, c) GROUP BY vec_id)"""
    moved = """m{1} AS MATERIALIZED (SELECT c, d, coalesce(n.x, m.x) AS x FROM m{0} m LEFT JOIN (
  SELECT c, d, floor(sum(x)::DOUBLE / count(*))::BIGINT AS x FROM cells JOIN a{0} USING (vec_id) GROUP BY c, d) n USING (c, d))"""
    steps = [nearest.format(0)] + [part.format(r, r + 1) for r in range(ROUNDS) for part in (moved, nearest.replace("{0}", "{1}"))]
    return f"""WITH kept AS (SELECT vec_id, embedding AS e FROM embeddings WHERE len(embedding) = {DIMENSIONS}
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cells AS MATERIALIZED (SELECT vec_id, unnest(range({DIMENSIONS})) AS d, floor({SCALE} * unnest(e)::DOUBLE)::BIGINT AS x FROM kept),
first AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c FROM kept QUALIFY c < {CLUSTERS}),
m0 AS MATERIALIZED (SELECT c, d, x FROM first JOIN cells USING (vec_id)),
{", ".join(steps)},
hashed AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY d)) AS centroid_sha256 FROM m{ROUNDS} GROUP BY c)
SELECT vec_id, c::INTEGER AS cluster, dist::BIGINT AS distance, (sum(dist) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
       (sum(dist) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a{ROUNDS} JOIN hashed USING (c)"""


@query("op3_huffman_ids")
def op3_huffman_ids(spark: SparkSession, folder: str) -> DataFrame:
    target = shared_folder(spark)
    huffman.write_ids(table(spark, folder, "documents"), target, BYTE_BPE, spaced=True, end_id=END_ID)
    return huffman.read_ids(spark, target).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op8_benchmark_decontamination", HITS_SQL)
def op8_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    hit = decontaminate.with_hits(docs, table(spark, folder, "benchmark"))
    return hit.select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        F.col("_n_hit").alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"),
        (F.col("_n_hit") > 0).alias("contaminated"),
    )


@query("op4_quality_discriminant")
def op4_quality_discriminant(spark: SparkSession, folder: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    stats = staged(quality.with_statistics(table(spark, folder, "documents")))
    labels = table(spark, folder, "labels").select("doc_id", F.col("quality").alias("label"))
    model = quality.fit(stats.join(labels, "doc_id").where(~held_out))
    return quality.scored(stats, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= QUALITY_THRESHOLD).cast("int").alias("predicted")
    )


@query("op2_vector_packing")
def op2_vector_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.pack(table(spark, folder, "documents"), WORD_BPE, spaced=False, end_id=END_ID)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op1_secret_scan")
def op1_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = secrets.train(secrets.samples(secrets.with_base_spans(docs)))
    return secrets.with_secrets(docs, model).select(
        "doc_id",
        F.size("_assign").cast("long").alias("n_assign"),
        F.size("_access").cast("long").alias("n_access"),
        F.size("_hex").cast("long").alias("n_hex"),
        F.sha2(secrets.listed("_base"), 256).alias("base_sha256"),
        secrets.listed("_spans").alias("spans"),
    )


@query("op5_transducer_counts")
def op5_transducer_counts(spark: SparkSession, folder: str) -> DataFrame:
    counts = counting.token_counts(table(spark, folder, "documents"), BYTE_BPE)
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


@query("op9_balanced_lists")
def op9_balanced_lists(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return neighbours.search(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)


@query("op10_jaccard_regions", LINKS_SQL)
def op10_jaccard_regions(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.joined(table(spark, folder, "documents").select("doc_id", "text"), width=4, percent=85)


@query("op7_suffix_repeats", REPEATS_SQL)
def op7_suffix_repeats(spark: SparkSession, folder: str) -> DataFrame:
    kept = repeats.without_repeats(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@query("op6_toxicity_chain")
def op6_toxicity_chain(spark: SparkSession, folder: str) -> DataFrame:
    """Low quality first, then toxicity, which the labels never give to the same document."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    known = labels.where(~held_out).select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    chain = toxicity.learn(docs, known, ("low_quality", "toxic"))
    return toxicity.scored(docs, chain, ("low_quality", "toxic")).select(
        "doc_id", held_out.alias("held_out"), F.col("toxic").alias("score"), (F.col("toxic") >= TOXIC_THRESHOLD).cast("int").alias("predicted"),
        F.col("low_quality").alias("low_quality_score"),
    )


@query("op11_perfect_hash_dedup", COPIES_SQL)
def op11_perfect_hash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """All rows: those with an even checksum of the id are indexed as history, the others arrive at that index."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    history = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return exactdedup.resolved(docs, history).select(
        "doc.doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


@query("op12_sharded_lloyd", _lloyd_sql())
def op12_sharded_lloyd(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select(
        F.struct("vec_id").alias("row"), lloyd.whole(F.col("embedding"), SCALE, DIMENSIONS).alias("x")
    )
    start = F.sha2(F.concat(F.lit("2:"), F.col("row.vec_id").cast("string")).cast("binary"), 256)
    each, centroids = lloyd.cluster(vectors, start, CLUSTERS, ROUNDS, DIMENSIONS)
    each = staged(each)
    # One row per cluster: as many as the parameter says.
    names = [(c, hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(centroids.tolist())]
    sums = {r["cluster"]: int(r["s"]) for r in each.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    about = spark.createDataFrame(
        [(c, sums.get(c, 0), sum(sums.values()), name) for c, name in names], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    )
    return each.join(F.broadcast(about), "cluster").select(
        "row.vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


@query("op13_periodic_runs")
def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """A tenth of the documents, by the checksum of the id, gets a run: its words from one on repeat a passage to the end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    docs = table(spark, folder, "documents").select("doc_id", "text", h.alias("h"))
    docs = docs.withColumn("found", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(f"({_SPACED})"), F.lit(1))))
    n, g = F.size("found"), F.floor(F.col("h") / 10)
    docs = docs.select("doc_id", "text", "found", F.when(n > 0, (g % n).cast("int")).alias("a"), n.alias("n"), g.alias("g"))
    p = (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int")
    text = F.when(F.col("a").isNotNull(), periodic.looped(F.col("found"), F.col("a"), p)).otherwise(F.col("text"))
    runs = periodic.with_runs(docs.select("doc_id", text.alias("text")))
    return runs.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "start", "length", "period",
        F.expr("1000 * length div period").alias("exponent_milli"),
        F.sha2(periodic.listed("runs").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )

"""Keyword, vector, hybrid and structured retrieval over the document rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from folionaut.functions.embedding import HashEmbedder
from folionaut.operators import blocks, bm25, fusion, vector
from folionaut.operators.durable import durable, fresh_folder
from folionaut.settings import Settings
from suite.registry import DOCUMENTS_SQL, TOKENS_SQL, bm25_sql, documents, query, states, table, texts

COLUMNS = ("text", "filename")
QUERY = "thtion mentre queation the para src3"
QUERY_WORDS = {"thtion": 1, "mentre": 1, "queation": 1, "the": 1, "para": 1, "src3": 1}
TOP = 50


def candidates(rows):
    return rows.filter((F.col("status") == "indexed") & ~F.col("deleted"))


@query("token_lengths", TOKENS_SQL.join(["WITH", " SELECT seq, dl::BIGINT AS length FROM lens"]))
def token_lengths(spark, folder):
    return bm25.lengths(texts(spark, folder), COLUMNS).select("seq", F.col("length").cast("bigint").alias("length"))


@query(
    "corpus_statistics",
    "WITH" + TOKENS_SQL + " SELECT count(*)::BIGINT AS rows, round(avg(dl), 6) AS mean_length, sum(dl)::BIGINT AS tokens FROM lens",
)
def corpus_statistics(spark, folder):
    stats = bm25.corpus_statistics(bm25.lengths(texts(spark, folder), COLUMNS))
    return stats.select("rows", F.round("mean_length", 6).alias("mean_length"), "tokens")


@query(
    "term_statistics",
    "WITH" + TOKENS_SQL + " SELECT term, count(*)::BIGINT AS document_frequency, sum(tf)::BIGINT AS collection_frequency FROM post GROUP BY term",
)
def term_statistics(spark, folder):
    return bm25.term_statistics(bm25.postings(texts(spark, folder), COLUMNS))


@query("postings", "WITH" + TOKENS_SQL + " SELECT seq, term, tf FROM post")
def postings(spark, folder):
    return bm25.postings(texts(spark, folder), COLUMNS).select("seq", "term", F.col("tf").cast("bigint").alias("tf"))


@query("bm25_all_matches", "WITH" + bm25_sql(QUERY_WORDS) + " SELECT seq, round(keyword_score, 6) AS score FROM scores")
def bm25_all_matches(spark, folder):
    scores = bm25.keyword_scores(texts(spark, folder), QUERY, COLUMNS)
    return scores.select("seq", F.round("keyword_score", 6).alias("score"))


TOPK_SQL = (
    "WITH" + bm25_sql(QUERY_WORDS) + f""" SELECT seq, filename, round(keyword_score, 6) AS score
    FROM scores JOIN rows_ USING (seq) WHERE candidate ORDER BY keyword_score DESC, seq LIMIT {TOP}"""
)


@query("bm25_keyword_topk", TOPK_SQL)
def bm25_keyword_topk(spark, folder):
    # Scores are narrow; the state of their documents joins them, not the texts.
    scores = candidates(states(spark, folder, bm25.keyword_scores(texts(spark, folder), QUERY, COLUMNS, carry=("filename",))))
    return fusion.top_k(scores, "keyword_score", TOP).select("seq", "filename", F.round("keyword_score", 6).alias("score"))


@query("bm25_blocks_topk", TOPK_SQL)
def bm25_blocks_topk(spark, folder):
    """The same rows from a written index of blocks, those below the k-th score unread."""
    rows = texts(spark, folder)
    place = fresh_folder(spark)
    blocks.write_index(rows.select("seq", *COLUMNS), place, COLUMNS, rows_per_block=256)
    alive = candidates(states(spark, folder, rows.select("seq", "filename")))
    found = blocks.search(spark, place, QUERY, TOP, candidates=alive)
    named = found.rows.join(alive, "seq")
    return named.select("seq", "filename", F.round("keyword_score", 6).alias("score"))


@query(
    "bm25_repeated_word_topk",
    "WITH" + bm25_sql({"thtion": 3, "leaux": 1}) + f""" SELECT seq, round(keyword_score, 6) AS score
    FROM scores JOIN rows_ USING (seq) WHERE candidate ORDER BY keyword_score DESC, seq LIMIT {TOP}""",
)
def bm25_repeated_word_topk(spark, folder):
    scores = bm25.keyword_scores(texts(spark, folder), "Thtion THTION, leaux! thtion", COLUMNS)
    hits = candidates(states(spark, folder, scores))
    return fusion.top_k(hits, "keyword_score", TOP).select("seq", F.round("keyword_score", 6).alias("score"))


PHRASE_SQL = "WITH" + TOKENS_SQL + """,
pairs AS (
  SELECT seq, (SELECT count(*) FROM range(1, len(a)) t(i) WHERE a[i] = 'of' AND a[i + 1] = 'the')
            + (SELECT count(*) FROM range(1, len(b)) t(i) WHERE b[i] = 'of' AND b[i + 1] = 'the') AS tf FROM toks),
both_ AS (
  SELECT seq, tf, 1 AS n FROM pairs WHERE tf > 0
  UNION ALL SELECT seq, tf, 2 FROM post WHERE term = 'leaux'),
counted AS (SELECT *, count(*) OVER (PARTITION BY n)::DOUBLE AS df FROM both_),
scores AS (
  SELECT c.seq, sum(CASE WHEN ln((s.n - c.df + 0.5) / (c.df + 0.5)) > 0 THEN ln((s.n - c.df + 0.5) / (c.df + 0.5)) ELSE 1e-6 END
                    * c.tf * 2.2 / (c.tf + 1.2 * (0.25 + 0.75 * l.dl / s.avgdl))) AS score
  FROM counted c JOIN lens l USING (seq), stats s GROUP BY c.seq)
SELECT seq, round(score, 6) AS score FROM scores"""


@query("bm25_phrase", PHRASE_SQL)
def bm25_phrase(spark, folder):
    scores = bm25.keyword_scores(texts(spark, folder), "of_the leaux", COLUMNS)
    return scores.select("seq", F.round("keyword_score", 6).alias("score"))


@query("bm25_phrase_from_postings", PHRASE_SQL)
def bm25_phrase_from_postings(spark, folder):
    rows = texts(spark, folder)
    stats = bm25.corpus_statistics(bm25.lengths(rows, COLUMNS))
    scores = bm25.indexed_keyword_scores(durable(bm25.postings(rows, COLUMNS)), stats, "of_the leaux")
    return scores.select("seq", F.round("keyword_score", 6).alias("score"))


@query("bm25_from_postings", "WITH" + bm25_sql(QUERY_WORDS) + " SELECT seq, round(keyword_score, 6) AS score FROM scores")
def bm25_from_postings(spark, folder):
    rows = texts(spark, folder)
    stats = bm25.corpus_statistics(bm25.lengths(rows, COLUMNS))
    scores = bm25.indexed_keyword_scores(durable(bm25.postings(rows, COLUMNS)), stats, QUERY)
    return scores.select("seq", F.round("keyword_score", 6).alias("score"))


# A fixed query vector as wide as the given embeddings.
QUERY_VECTOR = [((n * 37) % 64 - 32) / 256 for n in range(64)]
VECTOR_SQL = "[" + ", ".join(repr(x) for x in QUERY_VECTOR) + "]::DOUBLE[]"


@query("vector_l2_scores", f"SELECT vec_id, round(1 / (1 + list_distance(embedding::DOUBLE[], {VECTOR_SQL})), 6) AS score FROM embeddings")
def vector_l2_scores(spark, folder):
    vectors = table(spark, folder, "embeddings", "vec_id")
    scores = vector.vector_scores(vectors, QUERY_VECTOR, key="vec_id")
    return scores.select("vec_id", F.round("vector_score", 6).alias("score"))


@query(
    "vector_l2_topk",
    f"""SELECT vec_id, round(1 / (1 + d), 6) AS score FROM (
    SELECT vec_id, list_distance(embedding::DOUBLE[], {VECTOR_SQL}) AS d FROM embeddings) ORDER BY d, vec_id LIMIT {TOP}""",
)
def vector_l2_topk(spark, folder):
    scores = vector.vector_scores(table(spark, folder, "embeddings", "vec_id"), QUERY_VECTOR, key="vec_id")
    return fusion.top_k(scores, "vector_score", TOP, "vec_id").select("vec_id", F.round("vector_score", 6).alias("score"))


@query(
    "vector_filtered_topk",
    "WITH" + DOCUMENTS_SQL + f""" SELECT seq, round(1 / (1 + d), 6) AS score FROM (
    SELECT seq, list_distance(embedding::DOUBLE[], {VECTOR_SQL}) AS d FROM embeddings JOIN rows_ ON seq = vec_id
    WHERE candidate AND extension IN ('txt', 'md')) ORDER BY d, seq LIMIT {TOP}""",
)
def vector_filtered_topk(spark, folder):
    allowed = candidates(documents(spark, folder)).filter(F.col("extension").isin("txt", "md"))
    vectors = table(spark, folder, "embeddings", "vec_id").withColumnRenamed("vec_id", "seq")
    scores = vector.vector_scores(vectors.join(allowed.select("seq"), "seq", "left_semi"), QUERY_VECTOR)
    return fusion.top_k(scores, "vector_score", TOP).select("seq", F.round("vector_score", 6).alias("score"))


@query("vector_cosine_scores", f"SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {VECTOR_SQL}), 6) AS similarity FROM embeddings")
def vector_cosine_scores(spark, folder):
    vectors = table(spark, folder, "embeddings", "vec_id")
    scores = vector.cosine_similarities(vectors, QUERY_VECTOR, keys=("vec_id",))
    return scores.select("vec_id", F.round("similarity", 6).alias("similarity"))


def hash_vector_sql(text: str) -> str:
    """The hash embedder in SQL: eight bytes of the digest scaled to 0..1."""
    return f"list_transform(range(0, 8), lambda i: (('0x' || substr(sha256({text}), 2 * i + 1, 2))::INTEGER / 255.0)::FLOAT::DOUBLE)"


@query(
    "hash_embeddings",
    f"SELECT doc_id, round(v[1], 6) AS first_value, round(v[8], 6) AS last_value, round(list_sum(v), 6) AS total FROM (SELECT doc_id, {hash_vector_sql('text')} AS v FROM documents)",
)
def hash_embeddings(spark, folder):
    docs = table(spark, folder, "documents", "doc_id").select("doc_id", HashEmbedder().column(F.col("text")).alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda sum_, x: sum_ + x.cast("double"))
    return docs.select(
        "doc_id",
        F.round(F.col("v")[0].cast("double"), 6).alias("first_value"),
        F.round(F.col("v")[7].cast("double"), 6).alias("last_value"),
        F.round(total, 6).alias("total"),
    )


HYBRID_TEXT = "thtion mentre queation"
HYBRID_WORDS = {"thtion": 1, "mentre": 1, "queation": 1}
HYBRID_VECTOR = "[" + ", ".join(repr(x) for x in HashEmbedder().query(HYBRID_TEXT)) + "]::DOUBLE[]"


def hybrid_sql(condition: str) -> str:
    return "WITH" + bm25_sql(HYBRID_WORDS) + f""",
kw AS (SELECT seq, row_number() OVER (ORDER BY keyword_score DESC, seq) AS r FROM scores JOIN rows_ USING (seq) WHERE {condition}),
dist AS (SELECT seq, list_distance({hash_vector_sql('text')}, {HYBRID_VECTOR}) AS d FROM rows_ WHERE {condition}),
vec AS (SELECT seq, row_number() OVER (ORDER BY 1 / (1 + d) DESC, seq) AS r FROM dist),
fused AS (
  SELECT seq, sum(part) AS score FROM (
    SELECT seq, 0.65 / (60 + r) AS part FROM vec UNION ALL SELECT seq, 0.35 / (60 + r) FROM kw) GROUP BY seq)
SELECT seq, round(score, 9) AS score FROM fused ORDER BY fused.score DESC, seq LIMIT {TOP}"""


def hybrid(spark, folder, allow):
    """Both channels are scored on the texts alone; states join the narrow scores."""
    embedder, settings, rows = HashEmbedder(), Settings(), texts(spark, folder)
    keyword = allow(states(spark, folder, bm25.keyword_scores(rows, HYBRID_TEXT, COLUMNS, carry=("extension", "path"))))
    vectors = rows.select("seq", "extension", "path", embedder.column(F.col("text")).alias("embedding"))
    near = vector.l2_distances(vectors, embedder.query(HYBRID_TEXT), keys=("seq", "extension", "path"))
    semantic = allow(states(spark, folder, near)).select("seq", (1 / (1 + F.col("distance"))).alias("vector_score"))
    fused = fusion.fuse(
        [(semantic, "vector_score", settings.vector_weight), (keyword, "keyword_score", settings.keyword_weight)],
        TOP,
        settings.rrf_k,
    )
    return fused.select("seq", F.round("score", 9).alias("score"))


@query("hybrid_rrf_topk", hybrid_sql("candidate"))
def hybrid_rrf_topk(spark, folder):
    return hybrid(spark, folder, candidates)


@query("hybrid_rrf_filtered_topk", hybrid_sql("candidate AND extension = 'md' AND path LIKE '/data/src1%'"))
def hybrid_rrf_filtered_topk(spark, folder):
    allowed = (F.col("extension") == "md") & F.col("path").startswith("/data/src1")
    return hybrid(spark, folder, lambda rows: candidates(rows).filter(allowed))


@query(
    "structured_candidates",
    "WITH" + DOCUMENTS_SQL + " SELECT seq, path, 1.0::DOUBLE AS score FROM rows_ WHERE candidate AND extension IN ('txt', 'log') AND path LIKE '/data/src1%'",
)
def structured_candidates(spark, folder):
    from folionaut.operators.filters import filter_chunks
    from folionaut.plans.requests import SearchFilters

    wanted = SearchFilters(source_extensions=(".TXT", "log"), path_prefix="/data/src1")
    kept, _, _ = filter_chunks(candidates(documents(spark, folder)), None, None, wanted)
    return kept.select("seq", "path", F.lit(1.0).alias("score"))


@query(
    "multi_collection_rank",
    "WITH" + bm25_sql(QUERY_WORDS) + f""",
ranked AS (
  SELECT lang AS collection, seq, row_number() OVER (PARTITION BY lang ORDER BY keyword_score DESC, seq) AS collection_rank
  FROM scores JOIN rows_ USING (seq) WHERE candidate)
SELECT collection, seq, collection_rank::BIGINT AS collection_rank, round(1.0 / (60 + collection_rank), 9) AS fusion_score
FROM ranked WHERE collection_rank <= {TOP} ORDER BY ranked.collection_rank, collection LIMIT {TOP}""",
)
def multi_collection_rank(spark, folder):
    hits = candidates(states(spark, folder, bm25.keyword_scores(texts(spark, folder), QUERY, COLUMNS, carry=("lang",))))
    merged = fusion.reciprocal_group_rank(
        hits, "lang", (F.desc("keyword_score"), F.asc("seq")), TOP, Settings().rrf_k, ("lang", "collection_rank")
    )
    return merged.select(
        F.col("lang").alias("collection"),
        "seq",
        F.col("collection_rank").cast("bigint").alias("collection_rank"),
        F.round("fusion_score", 9).alias("fusion_score"),
    )

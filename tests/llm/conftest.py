import pytest
from pyspark.sql import functions as F

from folionaut.llm.session import prepare

SMALL = "/root/testdata/sf0.001"

#: Null and empty texts, white space alone, ties, repeated rows, other scripts, white space outside ASCII, special strings.
EDGES = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (5, "one"), (None, "row without an id " * 9), (7, "don't 'quote' it's <|endoftext|> x"),
    (8, "日本語　テスト é ß"), (9, "Ab " * 30), (10, "ab " * 30), (11, " ".join(f"w{i}" for i in range(60))),
    (12, "pre " + " ".join(f"w{i}" for i in range(60))), (13, "x" * 200_000), (14, " ".join(f"long{i % 977}" for i in range(120_000))),
]


@pytest.fixture(scope="session")
def llm(spark):
    prepare(spark)
    return spark


@pytest.fixture(scope="session")
def edges(llm):
    """Edge cases with columns whose names the operators use themselves."""
    docs = llm.createDataFrame(EDGES, "doc_id long, text string")
    more = {c: F.lit(c) for c in ("_n_words", "_items", "_spans", "_merged", "row", "score", "x", "region", "bucket", "a.b")}
    return docs.withColumns(more)


@pytest.fixture(scope="session")
def nothing(edges):
    return edges.limit(0)


@pytest.fixture(scope="session")
def small(llm):
    return llm.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")


@pytest.fixture(scope="session")
def rows(small):
    return sorted((r["doc_id"], r["text"] or "") for r in small.collect())

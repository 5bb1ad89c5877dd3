"""Top k from an index of blocks: the rows of a full search, with blocks left unread."""

import random

import pytest
from pyspark.sql import functions as F

from folionaut.operators import blocks, bm25, fusion
from folionaut.operators.durable import fresh_folder
from folionaut.settings import FolioError


@pytest.fixture(scope="module")
def corpus(spark):
    draw = random.Random(7)
    words = [f"w{n}" for n in range(300)]
    rows = []
    for n in range(4000):
        text = " ".join(draw.choices(words, k=draw.randint(1, 60)))
        # A few rows are full of the rare words; many repeat, so that scores tie.
        if n % 400 == 0:
            text = "rare " * draw.randint(1, 6) + text
        rows.append((n, "w1 same rare" if n % 700 == 3 else text))
    rows += [(4000, None), (4001, ""), (None, "rare rare rare")]
    frame = spark.createDataFrame(rows, "seq bigint, text string").repartition(4)
    folder = fresh_folder(spark)
    blocks.write_index(frame, folder, ("text",), rows_per_block=40)
    return frame.filter("seq IS NOT NULL"), folder


@pytest.mark.parametrize("query", ["rare", "rare w1 w2", "rare rare same", "w5", "absent rare", "w1 w2 w3 w4 w5 w6"])
@pytest.mark.parametrize("k", [1, 10])
def test_same_rows_as_a_full_search(spark, corpus, query, k):
    frame, folder = corpus
    expected = fusion.top_k(bm25.keyword_scores(frame, query, ("text",)), "keyword_score", k).collect()
    found = blocks.search(spark, folder, query, k)
    got = found.rows.collect()
    assert [r["seq"] for r in got] == [r["seq"] for r in expected]
    assert [r["keyword_score"] for r in got] == pytest.approx([r["keyword_score"] for r in expected], rel=1e-12)
    assert 0 < found.blocks_read <= found.blocks <= 101


def test_most_blocks_stay_unread(spark, corpus):
    _, folder = corpus
    found = blocks.search(spark, folder, "rare w1 w2", 3)
    assert found.blocks > 90 and found.blocks_read <= found.blocks / 5


def test_candidates_and_nothing_found(spark, corpus):
    frame, folder = corpus
    few = spark.range(0, 4000, 3).select(F.col("id").alias("seq"))
    expected = fusion.top_k(bm25.keyword_scores(frame, "rare w1", ("text",)).join(few, "seq", "left_semi"), "keyword_score", 20).collect()
    assert [r["seq"] for r in blocks.search(spark, folder, "rare w1", 20, candidates=few).rows.collect()] == [r["seq"] for r in expected]
    none = spark.createDataFrame([], "seq bigint")
    assert blocks.search(spark, folder, "rare", 5, candidates=none).rows.count() == 0
    assert blocks.search(spark, folder, "absent", 5).rows.count() == blocks.search(spark, folder, "", 5).rows.count() == 0
    with pytest.raises(FolioError):
        blocks.search(spark, folder, "w1_w2", 5)
    empty = fresh_folder(spark)
    blocks.write_index(spark.createDataFrame([], "seq bigint, text string"), empty, ("text",))
    assert blocks.search(spark, empty, "rare", 5).rows.count() == 0

"""Partial counts of batches, merged on read."""

import random

from pyspark.sql import functions as F

from folionaut.operators import vocabulary


def test_merged_counts(spark):
    draw = random.Random(3)
    rows = [(n % 5, f"c{n}", f"s{draw.randrange(3000)}", f"t{min(draw.randrange(40), draw.randrange(40))}") for n in range(30_000)]
    rows += [(0, "c", None, "t0"), (0, "c", "s", None)]
    links = spark.createDataFrame(rows, "batch int, chunk_id string, source_id string, term string")
    known = links.filter("term IS NOT NULL AND source_id IS NOT NULL")
    parts = vocabulary.partial_counts(links)

    def check(merged, kept):
        exact = {r["term"]: r for r in vocabulary.keyword_frequencies(kept).collect()}
        got = {r["term"]: r for r in merged.collect()}
        assert got.keys() == exact.keys()
        for term, row in got.items():
            assert row["chunk_frequency"] == exact[term]["chunk_frequency"]
            # Five standard errors of the sketch.
            assert abs(row["source_estimate"] - exact[term]["doc_frequency"]) <= max(1, 0.08 * exact[term]["doc_frequency"])
            assert row["doc_frequency"] >= exact[term]["doc_frequency"]

    check(vocabulary.merged_counts(parts), known)
    live = spark.createDataFrame([(1,), (3,), (3,)], "batch int")
    check(vocabulary.merged_counts(parts, live), known.filter(F.col("batch").isin(1, 3)))
    # A source leaves: its batches are counted again, the others stay.
    left = known.filter("source_id <> 's7'")
    touched = known.filter("source_id = 's7'").select("batch").distinct()
    check(vocabulary.merged_counts(vocabulary.with_batch_replaced(parts, left.join(touched, "batch", "left_semi"))), left)


def test_sources_of_one_batch_each_are_exact(spark):
    rows = [(n % 4, f"c{n}", f"s{n % 4}-{n % 97}", "t" if n % 3 else "u") for n in range(5000)]
    links = spark.createDataFrame(rows, "batch int, chunk_id string, source_id string, term string")
    exact = {tuple(r) for r in vocabulary.keyword_frequencies(links).collect()}
    assert {tuple(r)[:3] for r in vocabulary.merged_counts(vocabulary.partial_counts(links)).collect()} == exact
    assert vocabulary.merged_counts(vocabulary.partial_counts(links.limit(0))).count() == 0


def test_batches_counted_without_sketches(spark):
    rows = [(n % 4, f"c{n}", f"s{n % 4}-{n % 97}", "t" if n % 3 else "u") for n in range(500)]
    links = spark.createDataFrame([*rows, (0, "c", None, "t")], "batch int, chunk_id string, source_id string, term string")
    exact = {tuple(r) for r in vocabulary.keyword_frequencies(links.filter("source_id IS NOT NULL")).collect()}
    parts = vocabulary.partial_counts(links, sketches=False)
    assert "ObjectHashAggregate" not in parts._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in vocabulary.merged_counts(parts).collect()} == exact
    again = vocabulary.with_batch_replaced(parts, links.filter("batch = 1"))
    assert {tuple(r) for r in vocabulary.merged_counts(again).collect()} == exact

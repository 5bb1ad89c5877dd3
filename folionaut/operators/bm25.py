"""BM25 keyword scores, from raw text rows or from a written index.

Statistics (row count, mean length, rows per phrase) always cover every indexed
row; candidates are narrowed afterwards. Scores are positive, larger is better.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folionaut.functions.text import let, query_phrases, tokens
from folionaut.operators.durable import durable

# Fixed values of the ranking function.
K1 = 1.2
B = 0.75
IDF_FLOOR = 1e-6

TEXT_COLUMNS = ("text", "heading", "section_path", "filename")

# Positions of one text column stay below this, so a phrase never spans two columns.
COLUMN_STRIDE = 1 << 26


def token_lists(columns: tuple[str, ...]) -> Column:
    return F.array(*[tokens(F.col(c)) for c in columns])


def _phrase_count(lists: Column, phrase: tuple[str, ...]) -> Column:
    """Occurrences of adjacent tokens, each text column on its own."""

    def in_one(words: Column) -> Column:
        def starts_here(word: Column, at: Column) -> Column:
            rest = [F.get(words, at + n) == part for n, part in enumerate(phrase[1:], 1)]
            return F.coalesce(reduce(lambda x, y: x & y, rest, word == phrase[0]), F.lit(False))

        return F.size(F.filter(words, starts_here))

    return F.aggregate(lists, F.lit(0), lambda total, words: total + in_one(words))


def _term_counts(lists: Column, phrases: list[tuple[str, ...]]) -> Column:
    """struct<length, tf array> of one row; only query words are looked at one by one."""
    words = sorted({word for phrase in phrases for word in phrase})

    def occurrences(found: Column, word: str) -> Column:
        return F.size(F.filter(found, lambda w: w == word))

    def measure(bound: Column) -> Column:
        length = F.aggregate(bound, F.lit(0), lambda total, one: total + F.size(one))
        hits = F.filter(F.flatten(bound), lambda word: word.isin(words))
        counts = let(
            hits,
            lambda found: F.array(
                *[
                    occurrences(found, phrase[0])
                    if len(phrase) == 1
                    else _phrase_count(bound, phrase)
                    for phrase in phrases
                ]
            ),
        )
        return F.struct(length.alias("length"), counts.alias("tf"))

    return let(lists, measure)


def idf(rows: float, rows_with_phrase: float) -> float:
    raw = math.log((rows - rows_with_phrase + 0.5) / (rows_with_phrase + 0.5))
    return raw if raw > 0 else IDF_FLOOR


def saturation(tf: Column, length: Column, mean_length: float) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / (mean_length or 1.0)))


def keyword_scores(
    rows: DataFrame, query: str, columns: tuple[str, ...] = TEXT_COLUMNS, key: str = "seq", carry: tuple[str, ...] = ()
) -> DataFrame:
    """Scores of all rows that match any phrase, by one scan and no shuffle of rows: (key, ..., keyword_score).

    ``carry`` names columns to keep, so that candidates can be told from the scored rows without a join.
    """
    listed = rows.select(key, *carry, token_lists(columns).alias("lists"))
    return scores_of_lists(listed, query_phrases(query), key, carry)


def scores_of_lists(listed: DataFrame, query: list[tuple[str, ...]], key: str = "seq", carry: tuple[str, ...] = ()) -> DataFrame:
    """The same for rows whose token lists (one per text column) are already in ``lists``.

    Texts are read once. What is kept of each row is its key, length and counts of the query's phrases, as a narrow
    table; one row of statistics over it gives the constants of the scores.
    """
    wanted = Counter(query)
    phrases = list(wanted)
    if not phrases:
        return listed.filter(F.lit(False)).select(key, *carry, F.lit(0.0).alias("keyword_score"))
    # ``inline`` keeps Spark from evaluating the counts once for the length and again for the phrases.
    kept = durable(listed.select(key, *carry, F.inline(F.array(_term_counts(F.col("lists"), phrases)))))
    stats = kept.agg(
        F.count("*").alias("rows"),
        F.avg("length").alias("mean_length"),
        *[F.count_if(F.col("tf")[n] > 0).alias(f"n{n}") for n in range(len(phrases))],
    ).first()
    measured = kept.filter(F.exists("tf", lambda tf: tf > 0))
    score = sum(
        (
            F.lit(wanted[phrase] * idf(stats["rows"], stats[f"n{n}"]))
            * saturation(F.col("tf")[n].cast("double"), F.col("length"), stats["mean_length"])
            for n, phrase in enumerate(phrases)
        ),
        F.lit(0.0),
    )
    return measured.select(key, *carry, score.alias("keyword_score"))


# ---- written index ---------------------------------------------------------------------------------------------


def postings(rows: DataFrame, columns: tuple[str, ...] = TEXT_COLUMNS, key: str = "seq") -> DataFrame:
    """One row per term and text row: (key, length, term, tf, positions). Rows of one key and length count as one text row."""

    def placed(words: Column, column_no: Column) -> Column:
        return F.transform(
            words,
            lambda word, at: F.struct(
                word.alias("term"), (at + column_no * F.lit(COLUMN_STRIDE)).cast("bigint").alias("at")
            ),
        )

    flat = let(
        token_lists(columns),
        lambda lists: F.struct(
            F.aggregate(lists, F.lit(0), lambda total, one: total + F.size(one)).alias("length"),
            F.flatten(F.transform(lists, placed)).alias("words"),
        ),
    )
    def grouped(words: Column) -> Column:
        """A row's words by term: sorted, each run of one term is a posting."""

        def run(starts: Column, start: Column, at: Column) -> Column:
            count = F.coalesce(F.get(starts, at + 1), F.size(words) + 1) - start
            return F.struct(
                F.element_at(words, start)["term"].alias("term"), count.alias("tf"),
                F.transform(F.slice(words, start, count), lambda word: word["at"]).alias("positions"),
            )

        new = lambda i: (i == 1) | (F.get(words, i - 1)["term"] != F.get(words, i - 2)["term"])
        starts = F.filter(F.sequence(F.lit(1), F.size(words)), new)
        return F.when(F.size(words) > 0, let(starts, lambda all_: F.transform(all_, lambda start, at: run(all_, start, at))))

    def of_rows(own: DataFrame) -> DataFrame:
        runs = let(F.array_sort("t.words"), grouped)
        return own.select(key, flat.alias("t")).select(key, F.col("t.length").alias("length"), F.inline(runs))

    # All words of a row are in one place, so nothing is shuffled; only rows that share their key meet by term.
    repeated = rows.groupBy(key).count().filter("count > 1").select(F.col(key).alias("_again"))
    if repeated.isEmpty():
        return of_rows(rows)
    same = F.col(key).eqNullSafe(F.col("_again"))
    merged = of_rows(rows.join(repeated, same, "left_semi")).groupBy(key, "length", "term").agg(
        F.sum("tf").cast("int").alias("tf"), F.array_sort(F.flatten(F.collect_list("positions"))).alias("positions")
    )
    return of_rows(rows.join(repeated, same, "left_anti")).unionByName(merged)


def token_total(columns: tuple[str, ...]) -> Column:
    return F.aggregate(token_lists(columns), F.lit(0), lambda n, one: n + F.size(one))


def lengths(rows: DataFrame, columns: tuple[str, ...] = TEXT_COLUMNS, key: str = "seq") -> DataFrame:
    return rows.select(key, token_total(columns).alias("length"))


def corpus_statistics(row_lengths: DataFrame) -> DataFrame:
    """One row: number of indexed rows, their mean length and all tokens."""
    return row_lengths.agg(
        F.count("*").alias("rows"),
        F.avg("length").alias("mean_length"),
        F.coalesce(F.sum("length"), F.lit(0)).cast("bigint").alias("tokens"),
    )


def term_statistics(index: DataFrame) -> DataFrame:
    """Rows and occurrences per term; partial sums come first, so a hot term costs one row per task."""
    return index.groupBy("term").agg(
        F.count("*").alias("document_frequency"), F.sum("tf").cast("bigint").alias("collection_frequency")
    )


def indexed_keyword_scores(index: DataFrame, statistics: DataFrame, query: str, key: str = "seq") -> DataFrame:
    """The same scores from written postings; the term filter reaches the scan."""
    wanted = Counter(query_phrases(query))
    words = sorted({word for phrase in wanted for word in phrase})
    if not words:
        return index.filter(F.lit(False)).select(key, F.lit(0.0).alias("keyword_score"))
    totals = statistics.select("rows", "mean_length").first()
    hits = index.filter(F.col("term").isin(words))
    single = {phrase[0]: count for phrase, count in wanted.items() if len(phrase) == 1}
    parts = hits.filter(F.col("term").isin(list(single))).select(key, "term", "tf", "length")
    for phrase in wanted:
        if len(phrase) > 1:
            parts = parts.unionByName(_phrase_counts(hits, phrase, key))
    # One row per query phrase reaches the driver.
    found = {row["term"]: row["rows"] for row in parts.groupBy("term").agg(F.count("*").alias("rows")).collect()}
    weights = {
        name: count * idf(totals["rows"], found.get(name, 0))
        for name, count in {**single, **{" ".join(p): n for p, n in wanted.items() if len(p) > 1}}.items()
    }
    weight = F.try_element_at(F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]), F.col("term"))
    part = weight * saturation(F.col("tf").cast("double"), F.col("length"), totals["mean_length"])
    return parts.groupBy(key).agg(F.sum(part).alias("keyword_score"))


def _phrase_counts(hits: DataFrame, phrase: tuple[str, ...], key: str) -> DataFrame:
    """Rows where the words of the phrase stand side by side, in the shape of postings."""
    # At most one entry per word of the phrase and row, whatever the size of the corpus.
    grouped = hits.filter(F.col("term").isin(list(phrase))).groupBy(key).agg(
        F.first("length").alias("length"), F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("places")
    )

    def at(word: str, steps: int) -> Column:
        known = F.coalesce(F.try_element_at("places", F.lit(word)), F.array().cast("array<bigint>"))
        return F.transform(known, lambda p: p - steps)

    starts = reduce(F.array_intersect, [at(word, n) for n, word in enumerate(phrase)])
    counted = grouped.select(key, F.lit(" ".join(phrase)).alias("term"), F.size(starts).alias("tf"), "length")
    return counted.filter(F.col("tf") > 0)

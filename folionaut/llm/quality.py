"""Quality scores from a regularised quadratic discriminant over transformed document statistics.

Statistics of whole texts become a vector (``STATISTICS``), each on a scale where clean text is roughly normal: logarithms
of counts and empirical log-odds of shares, which draw short texts towards the middle. Each class has a mean and a
covariance, shrunk towards the pooled covariance and its diagonal. The score is the logistic function of the difference
of the classes' log densities; Mahalanobis distances use Cholesky factors that are computed once.

Null and empty texts have zero counts and so a score of their own; labels that are null or not 0 or 1 are left out;
repeated labels count each time. A training table without both classes gives every document the share of class 1 (0.5 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folionaut.llm.arrays import SMALL_BLOCK_BYTES, blocks, windows, words
from folionaut.llm.arrays import codes as span_codes
from folionaut.llm.workers import only

STATISTICS = (
    "log_words", "word_bytes", "upper", "digits", "symbols", "pauses", "bars", "word_end_symbols", "line_ends",
    "adjacent_repeats", "repeated_words", "repeated_pairs", "repeated_runs", "short_words",
)

#: Weight of the pooled covariance in each class's, and of its diagonal in the result.
POOLED = 0.3
DIAGONAL = 0.1

_KIND = np.zeros(256, dtype=np.uint8)  # 1 upper case, 2 digit, 3 pause, 4 bar, 5 other symbol, 6 end of line
_KIND[ord("A") : ord("Z") + 1] = 1
_KIND[ord("0") : ord("9") + 1] = 2
_KIND[[ord(c) for c in ".,;:?'\"()-"]] = 3
_KIND[ord("|")] = 4
_KIND[[c for c in range(33, 127) if not chr(c).isalnum() and _KIND[c] == 0]] = 5
_KIND[[10, 13]] = 6


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Empirical log-odds of a share."""
    return np.log((part + 0.5) / (np.maximum(whole - part, 0) + 0.5))


def _repeats(values: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Per row: values that stood in the row before."""
    if not len(values):
        return np.zeros(rows)
    order = np.lexsort((values, row))
    v, r = values[order], row[order]
    again = np.flatnonzero((v[1:] == v[:-1]) & (r[1:] == r[:-1])) + 1
    return np.bincount(r[again], minlength=rows).astype(float)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of ``STATISTICS`` for each text of a block."""
    rows = len(offsets) - 1
    starts, ends, first = words(data, offsets)
    n = np.diff(first).astype(float)
    row = np.repeat(np.arange(rows), np.diff(first))
    size = ends - starts
    kinds = np.bincount(
        np.repeat(np.arange(rows), np.diff(offsets)) * 8 + _KIND[data], minlength=rows * 8
    ).reshape(rows, 8).astype(float)
    total = np.bincount(row, weights=size, minlength=rows)
    code = span_codes(data, starts, ends)

    def runs(width: int) -> tuple[np.ndarray, np.ndarray]:
        found = windows(code, width)
        inside = row[: len(found)] == row[width - 1 :] if len(found) else np.empty(0, dtype=bool)
        return found[inside], row[: len(found)][inside]

    pairs, pair_row = runs(2)
    long_runs, long_row = runs(8)
    adjacent = np.flatnonzero((code[1:] == code[:-1]) & (row[1:] == row[:-1])) if len(code) else np.empty(0, dtype=int)
    tail = _KIND[data[ends - 1]] if len(ends) else np.empty(0, dtype=np.uint8)
    per_word = lambda mask: np.bincount(row[mask], minlength=rows).astype(float)
    pair_n, run_n = np.bincount(pair_row, minlength=rows).astype(float), np.bincount(long_row, minlength=rows).astype(float)
    return np.column_stack([
        np.log1p(n), np.log1p(total / np.maximum(n, 1)), _share(kinds[:, 1], total), _share(kinds[:, 2], total),
        _share(kinds[:, 5], total), _share(kinds[:, 3], total), _share(kinds[:, 4], n), _share(per_word((tail == 5) | (tail == 4)), n),
        _share(kinds[:, 6], n), _share(np.bincount(row[adjacent], minlength=rows), n), _share(_repeats(code, row, rows), n),
        _share(_repeats(pairs, pair_row, rows), pair_n), _share(_repeats(long_runs, long_row, rows), run_n), _share(per_word(size <= 3), n),
    ])


def with_statistics(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, x): the statistics of every document."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("quality")
        for batch in batches:
            for first, after, data, offsets in blocks(batch.column(1), SMALL_BLOCK_BYTES):
                x = statistics(data, offsets)
                bounds = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, after - first), pa.ListArray.from_arrays(bounds, pa.array(x.ravel()))], [key, "x"]
                )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, "text").mapInArrow(compute, f"`{key}` {kind}, x array<double>")


@dataclass
class Discriminant:
    """Class 0 and class 1: log shares, means, inverse Cholesky factors and log determinants. ``constant`` if one class lacks."""

    center: np.ndarray
    scale: np.ndarray
    shares: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    log_dets: np.ndarray
    constant: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1."""
        if self.constant is not None:
            return np.full(len(x), self.constant)
        z = (x - self.center) / self.scale
        logs = [
            self.shares[c] - 0.5 * (self.log_dets[c] + (((z - self.means[c]) @ self.factors[c].T) ** 2).sum(axis=1)) for c in (0, 1)
        ]
        return 1 / (1 + np.exp(-np.clip(logs[1] - logs[0], -500, 500)))


def fit(samples: DataFrame, width: int = len(STATISTICS), pooled: float = POOLED, diagonal: float = DIAGONAL) -> Discriminant:
    """Fit on all ``x, label`` rows. Only the classes' moments, of a size fixed by ``width``, reach the driver."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, width + 1, width + 1))
        for batch in batches:
            x = np.array(batch.column(0).flatten()).reshape(-1, width)
            one = np.column_stack([np.ones(len(x)), x])
            label = np.array(batch.column(1))
            for c in (0, 1):
                own = one[label == c]
                sums[c] += own.T @ own
        c, i, j = np.indices(sums.shape)
        yield pa.RecordBatch.from_arrays([pa.array(v.ravel()) for v in (c, i, j, sums)], ["c", "i", "j", "s"])

    kept = samples.where("label in (0, 1) and x is not null").select("x", F.col("label").cast("int").alias("label"))
    sums = np.zeros((2, width + 1, width + 1))
    for row in kept.mapInArrow(moments, "c long, i long, j long, s double").groupBy("c", "i", "j").agg(F.sum("s").alias("s")).collect():
        sums[row["c"], row["i"], row["j"]] = row["s"]
    n = sums[:, 0, 0]
    if not n.all():
        return Discriminant(*[np.zeros(0)] * 6, constant=float(n[1] / n.sum()) if n.sum() else 0.5)
    everything = sums.sum(axis=0)
    center = everything[0, 1:] / n.sum()
    scale = np.sqrt(np.maximum(np.diag(everything)[1:] / n.sum() - center**2, 1e-12))
    means = sums[:, 0, 1:] / n[:, None]
    within = [(sums[c, 1:, 1:] / n[c] - np.outer(means[c], means[c])) / np.outer(scale, scale) for c in (0, 1)]
    shared = (n[0] * within[0] + n[1] * within[1]) / n.sum()
    factors, log_dets = [], []
    for c in (0, 1):
        s = (1 - pooled) * within[c] + pooled * shared
        s = (1 - diagonal) * s + diagonal * np.diag(np.diag(s)) + 1e-6 * np.eye(width)
        lower = np.linalg.cholesky(s)
        factors.append(np.linalg.inv(lower))
        log_dets.append(2 * np.log(np.diag(lower)).sum())
    return Discriminant(center, scale, np.log(n / n.sum()), (means - center) / scale, np.array(factors), np.array(log_dets))


def scored(stats: DataFrame, model: Discriminant, key: str = "doc_id") -> DataFrame:
    """(key, score) for (key, x) rows."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("quality")
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column(1).flatten()).reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], [key, "score"])

    kind = stats.schema[key].dataType.simpleString()
    return stats.select(key, "x").mapInArrow(compute, f"`{key}` {kind}, score double")


def learned(docs: DataFrame, labels: DataFrame) -> Discriminant:
    """A discriminant fitted on the statistics of all documents that ``labels`` (doc_id, label) marks."""
    from folionaut.llm.session import staged

    return fit(staged(with_statistics(docs)).join(labels.select("doc_id", "label"), "doc_id"))


def accepted(docs: DataFrame, model: Discriminant, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more. A model without both classes rejects nothing."""
    if model.constant is not None:
        return docs
    carried = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    place = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("quality")
        for batch in batches:
            scores = [model.score(statistics(data, offsets)) for _, _, data, offsets in blocks(batch.column(0).field(place), SMALL_BLOCK_BYTES)]
            if scores:
                yield batch.filter(pa.array(np.concatenate(scores) >= threshold))

    return carried.mapInArrow(keep, carried.schema).select("row.*")

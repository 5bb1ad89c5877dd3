"""Toxicity categories by a chain of linear models over words and word beginnings.

Categories are predicted one after the other; each model also sees the probabilities of the categories before it. While
training, these are out-of-fold predictions, so a model never learns from an earlier one that has seen the same row.
A text's features are those of its distinct words and word beginnings (A-Z as a-z) that tell some category apart best by
chi-square; their counts are summed on Spark. Models are logistic, fitted on a sample of labelled rows of bounded size.

Null and empty texts have no features and get the prior's score; null labels and those not 0 or 1 leave a row out of the
sample; repeated rows count each time; a category without both labels gives its share (0.5 without labels) to every
document; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folionaut.llm.arrays import blocks, codes, words

#: Labelled rows to learn from, at most.
SAMPLE = 30_000
#: Features per category, the least number of documents of one, and the lengths of word beginnings in bytes.
FEATURES = 512
LEAST_DOCUMENTS = 5
BEGINNINGS = (4, 5, 6)
FOLDS = 5

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature codes of a block, each once for a text, and the text of each."""
    low = _LOWER[data]
    # Words are runs of letters: digits and ASCII punctuation part them.
    letters = low.copy()
    letters[(low < ord("a")) | ((low > ord("z")) & (low < 128))] = 32
    starts, ends, first = words(letters, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    code = [codes(letters, starts, ends)] + [
        codes(letters, starts[long], starts[long] + n) + np.uint64(n) for n in BEGINNINGS for long in [ends - starts > n]
    ]
    rows = [row] + [row[ends - starts > n] for n in BEGINNINGS]
    code, row = np.concatenate(code), np.concatenate(rows)
    order = np.lexsort((code, row))
    code, row = code[order], row[order]
    new = np.ones(len(code), dtype=bool)
    new[1:] = (code[1:] != code[:-1]) | (row[1:] != row[:-1])
    return code[new], row[new]


@dataclass
class Chain:
    """Selected features in order; per category the weights of features, of earlier categories' log-odds, and the bias."""

    codes: np.ndarray
    weights: list[tuple[np.ndarray, np.ndarray, float]]

    def probabilities(self, row: np.ndarray, column: np.ndarray, rows: int) -> np.ndarray:
        """One column for each category, from (row, feature) pairs."""
        logits: list[np.ndarray] = []
        for own, earlier, bias in self.weights:
            logits.append(np.bincount(row, weights=own[column], minlength=rows) + sum((e * z for e, z in zip(earlier, logits)), np.full(rows, bias)))
        return 1 / (1 + np.exp(-np.clip(np.array(logits).T.reshape(rows, len(logits)), -500, 500)))


def _fit(row: np.ndarray, column: np.ndarray, width: int, earlier: np.ndarray, label: np.ndarray, use: np.ndarray, steps: int = 150):
    """Logistic regression of the rows in ``use`` by accelerated gradient steps; (weights, weights of earlier, bias)."""
    share = label[use].mean() if use.any() else 0.5
    if not use.any() or share in (0.0, 1.0):
        return np.zeros(width), np.zeros(earlier.shape[1]), float(np.log((share + 1e-6) / (1 - share + 1e-6)))
    pick = use[row]
    row, column = row[pick], column[pick]
    n = use.sum()
    penalty = 1e-4
    w = np.concatenate([np.zeros(width + earlier.shape[1]), [np.log(share / (1 - share))]])
    v, s = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        z = np.bincount(row, weights=w[:width][column], minlength=len(label)) + earlier @ w[width:-1] + w[-1]
        error = np.where(use, 1 / (1 + np.exp(-np.clip(z, -500, 500))) - label, 0.0) / n
        gradient = np.concatenate([np.bincount(column, weights=error[row], minlength=width), earlier.T @ error, [error.sum()]])
        gradient[:-1] += penalty * w[:-1]
        v, s = 0.9 * v + 0.1 * gradient, 0.99 * s + 0.01 * gradient**2
        w = w - 0.1 * (v / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return w[:width], w[width:-1], float(w[-1])


def _sampled(labels: DataFrame, categories: Sequence[str], sample: int) -> dict[int, tuple[int, ...]]:
    """The labels of at most ``sample`` documents, in a fixed random order of their ids."""
    known = labels.where("doc_id is not null").where(" and ".join(f"`{c}` in (0, 1)" for c in categories))
    rows = known.select("doc_id", *categories).orderBy(F.xxhash64("doc_id"), "doc_id", *categories).limit(sample).collect()
    return {r["doc_id"]: tuple(int(r[c]) for c in categories) for r in rows}


def learn(docs: DataFrame, labels: DataFrame, categories: Sequence[str], sample: int = SAMPLE) -> Chain:
    """Fit the chain on ``labels`` (doc_id and a column for each category). The sample's labels and the chosen features'
    places in its texts reach the driver; both are bounded."""
    known = _sampled(labels, categories, sample)
    shared = docs.sparkSession.sparkContext.broadcast(known)
    n_categories = len(categories)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, marks = [np.empty(0, dtype=np.uint64)], [np.empty((0, n_categories), dtype=np.int64)]
        for batch in batches:
            ids = batch.column(0).to_pylist()
            own = [i for i, d in enumerate(ids) if d in shared.value]
            chosen = batch.take(pa.array(own, pa.int64()))
            for first, after, data, offsets in blocks(chosen.column(1)):
                code, row = features(data, offsets)
                found.append(code)
                marks.append(np.array([shared.value[ids[own[i]]] for i in range(first, after)], dtype=np.int64).reshape(-1, n_categories)[row])
        code, mark = np.concatenate(found), np.concatenate(marks)
        order = np.argsort(code, kind="stable")
        code, mark = code[order], mark[order]
        lead = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.empty(0, dtype=np.int64)
        size = np.diff(np.append(lead, len(code)))
        sums = np.add.reduceat(mark, lead, axis=0) if len(lead) else mark
        for at in range(0, len(lead), 50_000):
            some = slice(at, at + 50_000)
            yield pa.RecordBatch.from_arrays(
                [pa.array(code[lead[some]].view(np.int64)), pa.array(size[some]), *(pa.array(np.ascontiguousarray(sums[some, c])) for c in range(n_categories))],
                ["code", "n", *(f"c{c}" for c in range(n_categories))],
            )

    fields = ", ".join(f"c{c} long" for c in range(n_categories))
    totals = docs.select("doc_id", "text").mapInArrow(count, f"code long, n long, {fields}").groupBy("code").agg(
        F.sum("n").alias("n"), *(F.sum(f"c{c}").alias(f"c{c}") for c in range(n_categories))
    ).where(F.col("n") >= LEAST_DOCUMENTS)
    labels_ = np.array(list(known.values()), dtype=np.int64).reshape(-1, n_categories)
    size, picked = len(known), set()
    for c in range(n_categories):
        ones = int(labels_[:, c].sum())
        if 0 < ones < size:
            n, hit = F.col("n").cast("double"), F.col(f"c{c}").cast("double")
            gap = size * hit - n * ones
            chi = gap * gap / (n * (size - n + 0.5) * ones * (size - ones))
            picked |= {r["code"] for r in totals.select("code", chi.alias("chi")).orderBy(F.desc("chi"), "code").limit(FEATURES).collect()}
    chosen = np.sort(np.array(sorted(picked), dtype=np.int64).view(np.uint64)) if picked else np.empty(0, dtype=np.uint64)
    rows = placed(docs.select("doc_id", "text"), chosen, set(known)).collect()
    label = np.array([known[r["doc_id"]] for r in rows], dtype=float).reshape(-1, n_categories)
    places = [np.frombuffer(r["places"], dtype=np.int32) for r in rows]
    row = np.repeat(np.arange(len(rows)), [len(p) for p in places])
    column = np.concatenate([np.empty(0, dtype=np.int32), *places])
    # Equal documents share a fold, so that a copy is never predicted by a model that has seen it.
    fold = np.array([r["fold"] % FOLDS for r in rows], dtype=np.int64)
    weights, earlier = [], np.zeros((len(rows), 0))
    for c in range(n_categories):
        everything = np.ones(len(rows), dtype=bool)
        weights.append(_fit(row, column, len(chosen), earlier, label[:, c], everything))
        if c + 1 < n_categories:
            out = np.zeros(len(rows))
            for f in range(FOLDS):
                own, before, bias = _fit(row, column, len(chosen), earlier, label[:, c], fold != f)
                z = np.bincount(row, weights=own[column], minlength=len(rows)) + earlier @ before + bias
                out[fold == f] = z[fold == f]
            earlier = np.column_stack([earlier, out])
    return Chain(chosen, weights)


def placed(docs: DataFrame, chosen: np.ndarray, only: set[int] | None = None) -> DataFrame:
    """(doc_id, places, fold): the chosen features of each text (of ``only`` these ids), and a number that equal texts share."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from folionaut.llm.encoding import binary_column

        for batch in batches:
            if only is not None:
                batch = batch.take(pa.array([i for i, d in enumerate(batch.column(0).to_pylist()) if d in only], pa.int64()))
            for first, after, data, offsets in blocks(batch.column(1)):
                code, row = features(data, offsets)
                at = np.searchsorted(chosen, code)
                fits = at < len(chosen)
                fits[fits] = chosen[at[fits]] == code[fits]
                bounds = np.searchsorted(row[fits], np.arange(after - first + 1))
                fold = (codes(data, offsets[:-1], offsets[1:]) >> np.uint64(1)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, after - first), binary_column(at[fits].astype(np.int32), bounds), pa.array(fold)], ["doc_id", "places", "fold"]
                )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, places binary, fold long")


def scored(docs: DataFrame, chain: Chain, categories: Sequence[str]) -> DataFrame:
    """doc_id and the probability of each category, for every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, after, data, offsets in blocks(batch.column(1)):
                code, row = features(data, offsets)
                at = np.searchsorted(chain.codes, code)
                fits = at < len(chain.codes)
                fits[fits] = chain.codes[at[fits]] == code[fits]
                p = chain.probabilities(row[fits], at[fits], after - first)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, after - first), *(pa.array(np.ascontiguousarray(p[:, c])) for c in range(len(categories)))], ["doc_id", *categories]
                )

    fields = ", ".join(f"`{c}` double" for c in categories)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {fields}")

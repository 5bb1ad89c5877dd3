"""Exact vector similarity. Every vector is compared; nothing is approximated.

Spark streams (key, vector) record batches through ``mapInArrow``; a batch is one matrix
product in numpy, and only (key, value) pairs return.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _l2(matrix: np.ndarray, target: np.ndarray) -> np.ndarray:
    difference = matrix - target
    return np.sqrt(np.einsum("ij,ij->i", difference, difference))


def _cosine(matrix: np.ndarray, target: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return matrix @ target / (np.sqrt(np.einsum("ij,ij->i", matrix, matrix)) * np.sqrt(target @ target))


def _measure(
    vectors: DataFrame, query: Sequence[float], column: str, keys: Sequence[str], name: str, kernel: Callable,
    skip_unusable: bool,
) -> DataFrame:
    """The key columns and the measure. A vector that is null, of another width or not finite ends the job, unless
    ``skip_unusable`` says to leave such rows out; a measure without a value (a zero vector has no angle) is null."""
    target = np.asarray(query, dtype=np.float32).astype(np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            usable = pc.fill_null(pc.equal(pc.list_value_length(batch.column("_vector")), len(target)), False)
            kept = batch.filter(usable)
            if not skip_unusable and kept.num_rows < batch.num_rows:
                raise ValueError(f"{batch.num_rows - kept.num_rows} vectors of a batch are null or not of width {len(target)}")
            matrix = kept.column("_vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            matrix = matrix.reshape(-1, len(target))
            whole = np.isfinite(matrix).all(axis=1)
            if not skip_unusable and not whole.all():
                raise ValueError(f"{int((~whole).sum())} vectors of a batch hold components that are not finite")
            values = kernel(matrix, target)
            columns = [kept.column(key) for key in keys] + [pa.array(values, pa.float64(), mask=~np.isfinite(values))]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, name]).filter(pa.array(whole))

    source = vectors.select(*keys, F.col(column).alias("_vector"))
    fields = ", ".join(f"`{key}` {source.schema[key].dataType.simpleString()}" for key in keys)
    return source.mapInArrow(run, f"{fields}, `{name}` double")


def l2_distances(
    vectors: DataFrame, query: Sequence[float], column: str = "embedding", keys: Sequence[str] = ("seq",), skip_unusable: bool = False
) -> DataFrame:
    """Key columns and ``distance``, the Euclidean distance to the query."""
    return _measure(vectors, query, column, keys, "distance", _l2, skip_unusable)


def cosine_similarities(
    vectors: DataFrame, query: Sequence[float], column: str = "embedding", keys: Sequence[str] = ("seq",), skip_unusable: bool = False
) -> DataFrame:
    """Key columns and ``similarity``, the cosine of the angle to the query."""
    return _measure(vectors, query, column, keys, "similarity", _cosine, skip_unusable)


def vector_scores(vectors: DataFrame, query: Sequence[float], column: str = "embedding", key: str = "seq") -> DataFrame:
    """(key, vector_score) with score 1 / (1 + distance)."""
    return l2_distances(vectors, query, column, (key,)).select(key, (1 / (1 + F.col("distance"))).alias("vector_score"))

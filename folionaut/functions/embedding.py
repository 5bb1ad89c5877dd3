"""Embedders. An embedder turns a text column into an array<float> column and a query into floats."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from folionaut.functions.text import let


class HashEmbedder:
    """Eight bytes of the SHA-256 digest scaled to 0..1; deterministic, for tests and examples."""

    dimensions = 8

    def column(self, text: Column) -> Column:
        def scaled(digest: Column) -> Column:
            return F.transform(
                F.sequence(F.lit(0), F.lit(self.dimensions - 1)),
                lambda i: (F.conv(digest.substr(i * 2 + 1, F.lit(2)), 16, 10).cast("double") / 255).cast("float"),
            )

        return let(F.sha2(F.coalesce(text, F.lit("")), 256), scaled)

    def query(self, text: str) -> list[float]:
        digest = hashlib.sha256(text.encode()).digest()
        return [float(np.float32(byte / 255)) for byte in digest[: self.dimensions]]


class ModelEmbedder:
    """Wrap any batch model ``texts -> vectors``; Spark calls it once per Arrow batch."""

    def __init__(self, model: Callable[[Sequence[str]], Sequence[Sequence[float]]], dimensions: int):
        self.model, self.dimensions = model, dimensions

    def column(self, text: Column) -> Column:
        model, dimensions = self.model, self.dimensions

        @F.pandas_udf("array<float>")
        def embed(batch: pd.Series) -> pd.Series:
            return pd.Series(list(checked(model(batch.tolist()), len(batch), dimensions)))

        return embed(text)

    def query(self, text: str) -> list[float]:
        return checked(self.model([text]), 1, self.dimensions)[0].tolist()


def checked(vectors, count: int, dimensions: int) -> np.ndarray:
    matrix = np.asarray(vectors, dtype=np.float32)
    if matrix.shape != (count, dimensions) or not np.isfinite(matrix).all():
        raise ValueError("vectors must be finite and match the expected count and dimensions")
    return matrix

"""The boundary to models: anything that turns bytes into vectors. A deterministic stand-in serves tests."""

from __future__ import annotations

import hashlib
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    def image(self, data: bytes) -> list[float]: ...
    def text(self, text: str) -> list[float]: ...
    def faces(self, data: bytes) -> list[list[float]]: ...
    def keypoints(self, data: bytes) -> list[list[float]]: ...


class HashEmbedder:
    """Unit vectors drawn from a digest; equal content has equal vectors. It claims no meaning."""

    def __init__(self, size: int = 64):
        self.size = size

    def _vector(self, data: bytes) -> list[float]:
        v = np.random.default_rng(int.from_bytes(hashlib.sha256(data).digest()[:8], "big")).normal(size=self.size)
        return (v / np.linalg.norm(v)).tolist()

    def image(self, data: bytes) -> list[float]:
        return self._vector(data)

    def text(self, text: str) -> list[float]:
        return self._vector(text.encode())

    def faces(self, data: bytes) -> list[list[float]]:
        return [self._vector(data + bytes([k])) for k in range(len(data) % 3)]

    def keypoints(self, data: bytes) -> list[list[float]]:
        return [self._vector(data[k : k + 16]) for k in range(0, len(data), 16)]


def embed(rows: DataFrame, column: str, embedder: Embedder, kind: str = "image") -> DataFrame:
    """rows with embedding (null where the content is null or cannot be read) and error."""
    f = getattr(embedder, kind)
    out = "array<array<double>>" if kind in ("faces", "keypoints") else "array<double>"

    @F.pandas_udf(f"struct<embedding: {out}, error: string>")
    def run(data: pd.Series) -> pd.DataFrame:
        got = []
        for x in data:
            try:
                got.append((None, "empty") if x is None else (f(x), None))
            except Exception as e:  # a broken item is reported, not fatal
                got.append((None, str(e)[:200]))
        return pd.DataFrame(got, columns=["embedding", "error"])

    return rows.withColumn("__e", run(F.col(column))).select("*", "__e.*").drop("__e")

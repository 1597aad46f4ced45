"""Vector and geometry functions as column expressions."""

from __future__ import annotations

import gzip

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit_eps(v: Column, eps: float = 1e-8) -> Column:
    """For descriptors: the norm is enlarged by a trifle."""
    return F.transform(v, lambda x: x / (norm(v) + F.lit(eps)))


def unit(v: Column) -> Column:
    """Zero vectors stay as they are."""
    return F.when(norm(v) > 0, F.transform(v, lambda x: x / norm(v))).otherwise(v)


def l2_limit(similarity: Column) -> Column:
    """The distance of unit vectors with that inner product."""
    return F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * similarity))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def padded(n: Column, step: int = 16) -> Column:
    return F.floor((n + (step - 1)) / step) * step


def resize_factor(h: Column, w: Column, most: int) -> Column:
    return F.least(F.lit(1.0), F.try_divide(F.lit(float(most)), F.greatest(h, w)))


def box(x1: Column, y1: Column, x2: Column, y2: Column, w: Column, h: Column) -> Column:
    """Clamped to the image's pixels (0 to size - 1) and divided by its size; null if nothing is left."""
    clamp = lambda v, n: F.greatest(F.lit(0.0), F.least(v, n - 1)) / n
    a, b, c, d = clamp(x1, w), clamp(y1, h), clamp(x2, w), clamp(y2, h)
    return F.when((c > a) & (d > b), F.struct(a.alias("x1"), b.alias("y1"), c.alias("x2"), d.alias("y2")))


def percent_box(b: Column) -> Column:
    """A box as a style string in percent, each number held between 0 and 100; without a box an empty string."""
    hold = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(100.0), v * 100))
    text = F.format_string("left:%.2f%%;top:%.2f%%;width:%.2f%%;height:%.2f%%;", hold(b["x1"]), hold(b["y1"]), hold(b["x2"] - b["x1"]), hold(b["y2"] - b["y1"]))
    return F.when(b.isNotNull(), text).otherwise("")


def vectors_in(size: Column) -> Column:
    """Vectors in a chunk file of that many bytes: a fixed head, 512 bytes each."""
    return F.floor((size - 200) / 512)


def max_gap(a: Column, b: Column) -> Column:
    """Largest difference of two arrays after sorting; null if their sizes differ."""
    gaps = F.zip_with(F.array_sort(a), F.array_sort(b), lambda x, y: F.abs(x - y))
    return F.when(F.size(a) == F.size(b), F.array_max(gaps))


def same_within(a: Column, b: Column, tolerance: float = 1e-6) -> Column:
    """Whether two arrays have as many elements and, sorted, differ by no more than the tolerance."""
    return F.coalesce(F.when(F.size(a) == 0, F.size(b) == 0).otherwise(max_gap(a, b) <= tolerance), F.lit(False))


def pack_halves(v: Column) -> Column:
    """An array as gzipped half-precision numbers."""

    @F.pandas_udf("binary")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None else gzip.compress(np.asarray(x, "<f2").tobytes(), 6, mtime=0))

    return run(v)


def unpack_halves(data: Column) -> Column:
    """The array back, as single-precision numbers."""

    @F.pandas_udf("array<float>")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None else np.frombuffer(gzip.decompress(x), "<f2").astype(np.float32))

    return run(data)

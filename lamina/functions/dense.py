"""Dense operators over array<double> columns, as Arrow-batched numpy."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def weights(layer: int, rows: int, cols: int) -> np.ndarray:
    """W(l, i, j) = ((31 i + 17 j + 7 l) mod 13 - 6) / 16: dyadic, so that products with dyadic features are exact."""
    i, j = np.arange(rows)[:, None], np.arange(cols)[None, :]
    return ((31 * i + 17 * j + 7 * layer) % 13 - 6) / 16


def bias(layer: int, cols: int) -> np.ndarray:
    return ((5 * np.arange(cols) + 3 * layer) % 7 - 3) / 16


def _rows(x: pa.Array, width: int) -> np.ndarray:
    """The vectors of a column without nulls as a matrix, without a copy where Arrow allows it."""
    return np.asarray(x.flatten(), float).reshape(len(x), width)


def _column(out: np.ndarray) -> pa.Array:
    n, width = out.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(out).ravel()))


def linear(x: Column | str, w: np.ndarray, b: np.ndarray | None = None) -> Column:
    """x W + b for each row."""

    @F.arrow_udf("array<double>")
    def run(xs: pa.Array) -> pa.Array:
        out = _rows(xs, w.shape[0]) @ w
        return _column(out + b if b is not None else out)

    return run(x)


def head_bilinear(x: Column | str, w: np.ndarray) -> Column:
    """Flat (heads * a) vectors times w (heads, a, b) -> flat (heads * b)."""
    heads, a, _ = w.shape

    @F.arrow_udf("array<double>")
    def run(xs: pa.Array) -> pa.Array:
        out = np.einsum("nha,hab->nhb", _rows(xs, heads * a).reshape(len(xs), heads, a), w)
        return _column(out.reshape(len(xs), -1))

    return run(x)


def basis_weights(coefficients: np.ndarray, bases: np.ndarray) -> np.ndarray:
    """W_r = sum over b of coefficients[r, b] * bases[b]."""
    return np.einsum("rb,bij->rij", coefficients, bases)


_erf = np.vectorize(math.erf, otypes=[float])


def gelu(x: Column | str) -> Column:
    """v * (1 + erf(v / sqrt 2)) / 2 for each entry."""

    @F.arrow_udf("array<double>")
    def run(xs: pa.Array) -> pa.Array:
        v = np.asarray(xs.flatten(), float)
        out = v * 0.5 * (1 + _erf(v / math.sqrt(2))) if len(v) else v
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *xs.value_lengths().to_pylist()]), pa.int32()), pa.array(out))

    return run(x)

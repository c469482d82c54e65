"""Expressions over array<double> columns; all run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def mapped(x: Column | str, f: Callable[[Column], Column]) -> Column:
    return F.transform(_col(x), f)


def zipped(a: Column | str, b: Column | str, f: Callable[[Column, Column], Column]) -> Column:
    return F.zip_with(_col(a), _col(b), f)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value computed once: in a lambda, an expression is computed anew for each entry."""
    return F.transform(F.array(value), f)[0]


def add(a, b) -> Column:
    return zipped(a, b, lambda x, y: x + y)


def scaled(x, by: Column | float) -> Column:
    return mapped(x, lambda v: v * by)


def total(x) -> Column:
    return F.aggregate(_col(x), F.lit(0.0), lambda a, v: a + v)


def dot(a, b) -> Column:
    return total(zipped(a, b, lambda x, y: x * y))


def relu(x) -> Column:
    return mapped(x, lambda v: F.greatest(v, F.lit(0.0)))


def leaky_relu(x, slope: float = 0.01) -> Column:
    return mapped(x, lambda v: F.when(v >= 0, v).otherwise(v * slope))


def sigmoid(v: Column) -> Column:
    return 1 / (1 + F.exp(-v))


def layer_norm(x, eps: float = 1e-5, scale=None, shift=None) -> Column:
    """(x - mean) / sqrt(variance + eps), with the variance over all entries; then times scale and plus shift (sequences of numbers), if given."""
    n = F.size(_col(x))
    squares = lambda mean: F.aggregate(_col(x), F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean))
    out = let(total(x) / n, lambda mean: let(F.sqrt(squares(mean) / n + eps), lambda sd: mapped(x, lambda v: (v - mean) / sd)))
    if scale is not None:
        out = zipped(out, F.array(*map(F.lit, map(float, scale))), lambda v, w: v * w)
    return out if shift is None else add(out, F.array(*map(F.lit, map(float, shift))))


# Shapes are known when the plan is made, so entries are named one by one: such expressions are compiled, lambdas over arrays aren't.


def heads_mean(x, heads: int, width: int) -> Column:
    """A flat vector of heads * width entries -> the mean over heads."""
    x = _col(x)
    return F.array(*[sum((x[i + h * width] for h in range(1, heads)), x[i]) / heads for i in range(width)])


def heads_dot(a, b, heads: int, width: int) -> Column:
    """One inner product for each head of two flat vectors."""
    a, b = _col(a), _col(b)
    return F.array(*[sum((a[i] * b[i] for i in range(h * width + 1, (h + 1) * width)), a[h * width] * b[h * width]) for h in range(heads)])


def heads_scaled(x, by, heads: int, width: int) -> Column:
    """Each head of x times its entry of by."""
    x, by = _col(x), _col(by)
    return F.array(*[x[h * width + i] * by[h] for h in range(heads) for i in range(width)])


def argmax(x) -> Column:
    """0-based; of equal entries the first."""
    return (F.array_position(_col(x), F.array_max(_col(x))) - 1).cast("int")


def log_softmax(x) -> Column:
    spread = lambda top: F.log(F.aggregate(_col(x), F.lit(0.0), lambda a, u: a + F.exp(u - top)))
    return let(F.array_max(_col(x)), lambda top: let(spread(top), lambda z: mapped(x, lambda v: v - top - z)))


def zeros(width: int) -> Column:
    return F.array_repeat(F.lit(0.0), width)

"""Numeric operators on arrays of doubles: elementwise, gates, norms, softmax, reductions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPSILON = 1e-5

BINARY = {
    "add": lambda x, y: x + y,
    "subtract": lambda x, y: x - y,
    "multiply": lambda x, y: x * y,
    "maximum": lambda x, y: F.greatest(x, y),
    "minimum": lambda x, y: F.least(x, y),
    "safe_divide": lambda x, y: x / (F.abs(y) + 0.25),
}
UNARY = {
    "relu": lambda v: F.greatest(v, F.lit(0.0)),
    "tanh": lambda v: F.tanh(v),
    "sigmoid": lambda v: 1.0 / (1.0 + F.exp(-v)),
    "square": lambda v: v * v,
    "absolute": lambda v: F.abs(v),
    "exp": lambda v: F.exp(v),
}
GATES = {
    "silu": lambda v: v / (1.0 + F.exp(-v)),
    "gelu": lambda v: 0.5 * v * (1.0 + F.tanh(0.7978845608028654 * (v + 0.044715 * v * v * v))),
    "relu": UNARY["relu"],
    "tanh": UNARY["tanh"],
}


def doubles(x: Column) -> Column:
    return x.cast("array<double>")


def binary(name: str, x: Column, y: Column) -> Column:
    return F.zip_with(x, y, BINARY[name])


def unary(name: str, x: Column) -> Column:
    return F.transform(x, UNARY[name])


def gate(name: str, x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: GATES[name](a) * b)


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v)


def mean(x: Column) -> Column:
    return total(x) / F.size(x)


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, not again for every element that uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _divided(x: Column, by: Column) -> Column:
    return _let(by, lambda d: F.transform(x, lambda v: v / d))


def rms_norm(x: Column) -> Column:
    return _divided(x, F.sqrt(mean(F.transform(x, lambda v: v * v)) + EPSILON))


def layer_norm(x: Column) -> Column:
    centered = _let(mean(x), lambda m: F.transform(x, lambda v: v - m))
    return _let(centered, lambda c: _divided(c, F.sqrt(mean(F.transform(c, lambda v: v * v)) + EPSILON)))


def l2_norm(x: Column) -> Column:
    return _divided(x, F.sqrt(total(F.transform(x, lambda v: v * v)) + EPSILON))


def _shifted(x: Column) -> Column:
    return _let(F.array_max(x), lambda m: F.transform(x, lambda v: v - m))


def softmax(x: Column) -> Column:
    return _let(F.transform(_shifted(x), lambda v: F.exp(v)), lambda e: _divided(e, total(e)))


def log_softmax(x: Column) -> Column:
    return _let(_shifted(x), lambda s: _let(F.log(total(F.transform(s, lambda v: F.exp(v)))), lambda log: F.transform(s, lambda v: v - log)))


def softmin(x: Column) -> Column:
    return softmax(F.transform(x, lambda v: -v))


def spread(x: Column, value: Column) -> Column:
    """A row's reduction repeated to the row's width."""
    return F.array_repeat(value, F.size(x))


def close(observed: Column, expected: Column, tolerance: float = 0.001) -> Column:
    """Whether all values agree within an absolute and a relative tolerance."""
    each = F.zip_with(observed, expected, lambda a, b: F.coalesce(F.abs(a - b) <= tolerance + tolerance * F.abs(b), F.lit(False)))
    return (F.size(observed) == F.size(expected)) & F.forall(each, lambda ok: ok)


def entries(df: DataFrame, row: str, array: str) -> DataFrame:
    """``i, k, value``: the long form of a matrix whose rows are arrays."""
    return df.select(F.col(row).alias("i"), F.posexplode(array).alias("k", "value"))


def transpose(long: DataFrame, f=lambda v: v) -> DataFrame:
    return long.select(F.col("k").cast("long").alias("i"), F.col("i").alias("k"), f(F.col("value")).alias("value"))


def _draw(seed: int, *key: Column | str) -> Column:
    """A number from 0 to 1 (exclusive) that follows from the key alone: 52 bits of a digest, however rows are dealt."""
    parts = F.concat_ws(":", F.lit(str(seed)), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in key])
    return F.conv(F.substring(F.md5(parts), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def seeded(kind: str, seed: int, *key: Column | str, low: float = 0.0, high: float = 1.0) -> Column:
    """A drawn value for each key: ``normal``, ``uniform`` from low to high, ``integer`` from low up to below high, or ``bool``."""
    if kind == "normal":
        return F.sqrt(-2 * F.log(1 - _draw(seed, F.lit("r"), *key))) * F.cos(2 * F.pi() * _draw(seed, F.lit("a"), *key))
    u = _draw(seed, *key)
    if kind == "uniform":
        return low + (high - low) * u
    if kind == "integer":
        return F.floor(low + max(high - low, 1) * u)
    if kind == "bool":
        return u < 0.5
    raise ValueError(f"unknown kind {kind}")

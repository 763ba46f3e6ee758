"""Vector and signal functions on array<double> columns."""

from __future__ import annotations

from math import exp

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """0 where either is the null vector."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def kernel(kind: str, size: int = 5, weights: list[float] | None = None) -> list[float]:
    """gaussian (sums to 1), edge_detect (a discrete derivative) and custom (absolute values sum to 1), or box."""
    if kind == "gaussian":
        sigma = max(size / 4, 0.5)
        raw = [exp(-0.5 * ((k - size // 2) / sigma) ** 2) for k in range(size)]
        return [x / sum(raw) for x in raw]
    if kind == "box":
        return [1 / size] * size
    if kind == "edge_detect":
        raw = [float((k > size // 2) - (k < size // 2)) for k in range(size)]
    elif kind == "custom":
        if weights is None:
            raise ValueError("a custom kernel needs weights")
        raw = [float(x) for x in weights]
    else:
        raise ValueError(f"unknown kernel {kind!r}")
    total = sum(map(abs, raw))
    return [x / total for x in raw] if total else raw


def convolve_same(signal: Column, weights: list[float]) -> Column:
    """The centred part of the full convolution, as long as the longer of the two; an empty signal stays empty."""
    k = len(weights)
    w = F.array(*map(F.lit, weights))
    shift = F.floor((F.least(F.size(signal), F.lit(k)) - 1) / 2).cast("int")

    def at(i: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(0), F.lit(k - 1)), F.lit(0.0), lambda s, j: s + F.coalesce(F.get(signal, i + shift - j), F.lit(0.0)) * F.get(w, j)
        )

    whole = F.transform(F.sequence(F.lit(0), F.greatest(F.size(signal), F.lit(k)) - 1), at)
    return F.when(F.size(signal) > 0, whole).otherwise(F.array().cast("array<double>"))


def clip(signal: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.transform(signal, lambda x: F.least(F.lit(high), F.greatest(F.lit(low), x)))


def valleys(signal: Column, threshold: float) -> Column:
    """Places under the threshold that no neighbour undercuts; ends have one neighbour, plateaus give several."""

    def low(i: Column) -> Column:
        x = F.get(signal, i)
        return (x < threshold) & (x <= F.coalesce(F.get(signal, i - 1), x)) & (x <= F.coalesce(F.get(signal, i + 1), x))

    return F.when(F.size(signal) > 0, F.filter(F.sequence(F.lit(0), F.size(signal) - 1), low)).otherwise(F.array().cast("array<int>"))


def token_cost(tokens: Column, score: Column, epsilon: float = 0.01) -> Column:
    """Tokens paid for a unit of judged quality."""
    return F.when(tokens == 0, F.lit(0.0)).otherwise(tokens / (score + F.lit(epsilon)))

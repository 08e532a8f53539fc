"""Vector columns: everything stays in the JVM as higher-order functions over array<float|double>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalise(a: Column) -> Column:
    """L2; a zero vector stays as it is."""
    n = norm(a)
    return F.when(n == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / n))


def cosine(a: Column, b: Column) -> Column:
    """0 where either norm is 0, and where a vector is missing."""
    n = norm(a) * norm(b)
    return F.coalesce(F.when(n == 0, 0.0).otherwise(dot(a, b) / n), F.lit(0.0))


def cosine_eps(a: Column, b: Column, eps: float = 1e-8) -> Column:
    """The matrix form: eps is added to each norm."""
    return dot(a, b) / ((norm(a) + eps) * (norm(b) + eps))


def euclid(a: Column, b: Column, temperature: float = 1.0) -> Column:
    """Negative squared distance over a temperature."""
    return -(dot(a, a) + dot(b, b) - 2 * dot(a, b)) / temperature


SIMILARITIES = {"cosine": cosine, "cosine_eps": cosine_eps, "dot": dot, "euclid": euclid}

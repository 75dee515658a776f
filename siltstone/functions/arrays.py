"""Vector arithmetic on array<double> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-8


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: an expression inside a lambda is computed for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def l2_normalize(a: Column, eps: float = EPS) -> Column:
    """a over its norm, to which eps is added."""
    return let(norm(a), lambda n: F.transform(a, lambda x: x / (n + eps)))


def project_out(a: Column, basis: list[list[float]]) -> Column:
    """a without its parts along orthonormal basis vectors, normalised; without a basis, a."""
    if not basis:
        return a

    def without(rest: list[list[float]], x: Column) -> Column:
        if not rest:
            return l2_normalize(x)
        along = F.lit(rest[0])
        return let(dot(x, along), lambda d: let(F.zip_with(x, along, lambda p, q: p - q * d), lambda y: without(rest[1:], y)))

    return without(basis, a)

"""Scalar and small-vector functions as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(v: Column) -> Column:
    """Nearest whole number, halves up."""
    return F.floor(v + 0.5)


def wrapped(v: Column, period: float) -> Column:
    """Remainder in [0, period)."""
    return v - F.floor(v / period) * period


def phase_wrapped(v: Column) -> Column:
    """Angle in [-pi, pi)."""
    return wrapped(v + F.pi(), 6.283185307179586) - F.pi()


def bounded(v: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(v, F.lit(low)), F.lit(high))


def of_least_magnitude(*values: Column) -> Column:
    """The value nearest zero, the first of equals."""
    return reduce(lambda a, b: F.when(F.abs(b) < F.abs(a), b).otherwise(a), values)


def of_most_magnitude(*values: Column) -> Column:
    return reduce(lambda a, b: F.when(F.abs(b) > F.abs(a), b).otherwise(a), values)


def dot(a: list[Column], b: list[Column]) -> Column:
    return reduce(Column.__add__, [x * y for x, y in zip(a, b, strict=True)])


def norm(a: list[Column]) -> Column:
    return F.sqrt(dot(a, a))


def angle(a: list[Column], b: list[Column]) -> Column:
    """Angle of two vectors in radians; null where one has no length."""
    length = norm(a) * norm(b)
    return F.when(length > 0, F.acos(bounded(dot(a, b) / length, -1.0, 1.0)))


def nearest_direction(a: list[Column]) -> Column:
    """Number of the 6-neighbour direction (+x, +y, +z, -x, -y, -z) nearest to a vector, the first of equals."""
    ways = [(v, i) for i, v in enumerate([*a, *[-v for v in a]])]
    best = F.greatest(*[v for v, _ in ways])
    return reduce(lambda rest, w: F.when(w[0] == best, F.lit(w[1])).otherwise(rest), reversed(ways), F.lit(None).cast("int"))

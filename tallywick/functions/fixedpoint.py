"""Fixed-point vectors: 32-bit floats in [-1, 1] as integers of 1/10000, and distances between them.

Dimensions are flat integer columns (``columns("v", 14)``), so that distances are plain sums inside
whole-stage code generation.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

DIMENSIONS = 14
SCALE = 10_000


def columns(prefix: str, dimensions: int = DIMENSIONS) -> list[str]:
    return [f"{prefix}{i}" for i in range(dimensions)]


def real(x: float) -> Column:
    return F.lit(x).cast("float")


def known(x: Column) -> Column:
    """NaN as 0: Spark orders NaN above all numbers, and a quotient 0/0 counts as nothing."""
    return F.when(F.isnan(x), real(0)).otherwise(x)


def clamp(x: Column) -> Column:
    """x held to [0, 1]."""
    return F.greatest(F.least(known(x), real(1)), real(0))


def ratio(x: Column, y: Column) -> Column:
    """x / y rounded once to 32 bits; by zero: 1 or -1 beyond any limit by the sign of x, and 0 for 0 / 0."""
    quotient = (x.cast("double") / F.when(y == 0, F.lit(1.0)).otherwise(y.cast("double"))).cast("float")
    return F.when(y != 0, quotient).when(x > 0, real(float("inf"))).when(x < 0, real(float("-inf"))).otherwise(real(0))


def quantise(x: Column) -> Column:
    """-1 and below: -SCALE; between -1 and 0: 0; else x * SCALE rounded half up, held to SCALE."""
    return F.when(x <= -1, F.lit(-SCALE)).otherwise((clamp(x) * real(SCALE) + real(0.5)).cast("int")).cast("int")


def quantised(vector: Column, prefix: str, dimensions: int = DIMENSIONS) -> list[Column]:
    """The first ``dimensions`` items of an array as integer columns; missing or null items are 0."""
    return [quantise(F.coalesce(F.get(vector, F.lit(i)).cast("float"), real(0))).alias(c) for i, c in enumerate(columns(prefix, dimensions))]


def squared_distance(a: list[str], b: list[str]) -> Column:
    """Sum of squared differences, in 64 bits: 14 dimensions alone can pass 32."""
    return reduce(add, ((F.col(x) - F.col(y)).cast("long") * (F.col(x) - F.col(y)).cast("long") for x, y in zip(a, b, strict=True)))


def box_distance(q: list[str], low: list[str], high: list[str]) -> Column:
    """Squared distance from a point to a box: never more than that to a point inside."""

    def outside(x: str, lo: str, hi: str) -> Column:
        gap = F.greatest(F.col(lo) - F.col(x), F.lit(0), F.col(x) - F.col(hi)).cast("long")
        return gap * gap

    return reduce(add, map(outside, q, low, high))

"""Closed axis-aligned boxes: tests and measures, as plain values and as Spark columns."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class BoxError(ValueError):
    pass


@dataclass(frozen=True)
class Box:
    low: tuple[float, ...]
    high: tuple[float, ...]

    def __init__(self, low, high):
        object.__setattr__(self, "low", tuple(map(float, low)))
        object.__setattr__(self, "high", tuple(map(float, high)))
        if not self.low or len(self.low) != len(self.high):
            raise BoxError("a box needs as many low as high bounds, and one at least")
        if not all(map(math.isfinite, self.low + self.high)):
            raise BoxError("bounds must be finite")
        if any(a > b for a, b in zip(self.low, self.high, strict=True)):
            raise BoxError("a low bound above its high bound")

    @property
    def dimensions(self) -> int:
        return len(self.low)

    def contains(self, point) -> bool:
        return len(point) == len(self.low) and all(a <= x <= b for a, x, b in zip(self.low, point, self.high, strict=True))

    def intersects(self, other: Box) -> bool:
        return len(other.low) == len(self.low) and all(a <= d and c <= b for a, b, c, d in zip(self.low, self.high, other.low, other.high, strict=True))

    def covers(self, other: Box) -> bool:
        return len(other.low) == len(self.low) and all(a <= c and d <= b for a, b, c, d in zip(self.low, self.high, other.low, other.high, strict=True))

    def classify(self, other: Box) -> str:
        """How `other` lies to this region: disjoint, partial or covered; of other dimensions: disjoint."""
        return "disjoint" if not self.intersects(other) else "covered" if self.covers(other) else "partial"

    # --- as columns -----------------------------------------------------------------------------------------------

    def match(self, dims: list[str]) -> Column:
        """Points in the box, one column for each dimension (reaches the Parquet scan)."""
        return all_of([F.col(d).between(a, b) for d, a, b in zip(dims, self.low, self.high, strict=True)])

    def match_array(self, col: str) -> Column:
        """Points in the box, as an array column; arrays of another length don't match."""
        inside = F.arrays_zip(F.col(col).alias("x"), F.array(*map(F.lit, self.low)).alias("a"), F.array(*map(F.lit, self.high)).alias("b"))
        return (F.size(col) == len(self.low)) & F.forall(inside, lambda z: (z["x"] >= z["a"]) & (z["x"] <= z["b"]))

    def coverage(self, dims: list[str]) -> Column:
        """D(isjoint), P(artial) or C(overed) of boxes with columns min_<dim>, max_<dim>."""
        apart = any_of([(F.col(f"max_{d}") < a) | (F.col(f"min_{d}") > b) for d, a, b in zip(dims, self.low, self.high, strict=True)])
        within = all_of([(F.col(f"min_{d}") >= a) & (F.col(f"max_{d}") <= b) for d, a, b in zip(dims, self.low, self.high, strict=True)])
        return F.when(apart, "D").when(within, "C").otherwise("P")


def all_of(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, cols)


def any_of(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, cols)


def bounds(df: DataFrame, dims: list[str], by: list[str] | None = None) -> DataFrame:
    """count, min_<dim>, max_<dim> of all rows or of each group."""
    aggs = [F.count("*").alias("cardinality"), *[f(d).alias(f"{n}_{d}") for d in dims for n, f in (("min", F.min), ("max", F.max))]]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def extents(dims: list[str], prefix: str = "") -> list[Column]:
    return [(F.col(f"{prefix}max_{d}") - F.col(f"{prefix}min_{d}")).cast("double") for d in dims]


def volume(dims: list[str], prefix: str = "") -> Column:
    return reduce(lambda a, b: a * b, extents(dims, prefix))


def extent(dims: list[str], prefix: str = "") -> Column:
    return reduce(lambda a, b: a + b, extents(dims, prefix))


def density(dims: list[str]) -> Column:
    """Rows per volume; infinite for rows in no volume."""
    v = volume(dims)
    return F.when(v > 0, F.col("cardinality") / v).when(F.col("cardinality") > 0, F.lit(float("inf"))).otherwise(0.0)


def overlap(dims: list[str], a: str, b: str) -> Column:
    """Sum of the overlap's extents of two boxes in one row; 0 if they are apart in any dimension."""
    widths = [(F.least(F.col(f"{a}max_{d}"), F.col(f"{b}max_{d}")) - F.greatest(F.col(f"{a}min_{d}"), F.col(f"{b}min_{d}"))).cast("double") for d in dims]
    return F.when(any_of([w < 0 for w in widths]), 0.0).otherwise(reduce(lambda x, y: x + y, widths))


def variances(df: DataFrame, dims: list[str]) -> DataFrame:
    return df.agg(*[F.var_pop(F.col(d).cast("double")).alias(f"var_{d}") for d in dims])


def widest_variance(df: DataFrame, dims: list[str]) -> int:
    """The dimension of largest variance; of equal ones the first."""
    v = variances(df, dims).first()
    return max(range(len(dims)), key=lambda i: (v[f"var_{dims[i]}"], -i))

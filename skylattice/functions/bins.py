"""Separation bins: edges equally spaced in a function of the separation in degrees."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Transform = tuple[Callable[[float], float], Callable[[float], float]]

_TRANSFORMS: dict[str, Transform] = {
    "linear": (lambda deg: deg, lambda value: value),
    "sqrt": (math.sqrt, lambda value: value * value),
    "log10": (math.log10, lambda value: 10.0**value),
}


@dataclass(frozen=True)
class Bins:
    """`edges` in radians, ascending; bin i is between edges i and i+1."""

    edges: tuple[float, ...]

    @property
    def count(self) -> int:
        return len(self.edges) - 1

    @property
    def max_radius(self) -> float:
        return self.edges[-1]

    @property
    def edges2(self) -> list[float]:
        """Edges as squared chords."""
        return [(2.0 * math.sin(0.5 * edge)) ** 2 for edge in self.edges]

    def frame(self, spark: SparkSession) -> DataFrame:
        """One row per bin: `bin`, `lo`, `hi`, `centre` in degrees."""
        edge = F.array(*[F.lit(math.degrees(value)) for value in self.edges])
        return spark.range(self.count).select(
            F.col("id").cast("int").alias("bin"),
            F.get(edge, F.col("id").cast("int")).alias("lo"),
            F.get(edge, F.col("id").cast("int") + 1).alias("hi"),
        ).withColumn("centre", (F.col("lo") + F.col("hi")) / 2.0)

    def of_chord2(self, d2: Column, upper_closed: bool = False) -> Column:
        """Bin of a squared chord, NULL outside.  [lo, hi) by default, (lo, hi] with `upper_closed`."""
        edges2 = self.edges2
        inside = (lambda low: d2 > low) if upper_closed else (lambda low: d2 >= low)
        past = d2 > edges2[-1] if upper_closed else d2 >= edges2[-1]
        ladder = F.when(past, F.lit(None).cast("int"))
        for index in range(self.count - 1, -1, -1):
            ladder = ladder.when(inside(F.lit(edges2[index])), F.lit(index))
        return ladder


def make_bins(
    count: int = 50, min_deg: float = 1.0, max_deg: float = 15.0, scale: str | Transform = "sqrt"
) -> Bins:
    """Edges from a scale name or a (forward, inverse) pair of functions; an unknown name is an error."""
    forward, inverse = _transform(scale) if isinstance(scale, str) else scale
    low, high = forward(min_deg), forward(max_deg)
    return Bins(tuple(math.radians(inverse(low + (high - low) * i / count)) for i in range(count + 1)))


def _transform(scale: str) -> Transform:
    if scale not in _TRANSFORMS:
        raise ValueError(f"scale {scale!r} is none of {', '.join(sorted(_TRANSFORMS))}")
    return _TRANSFORMS[scale]


def bins_from_edges(edges_deg: Sequence[float]) -> Bins:
    return Bins(tuple(math.radians(edge) for edge in sorted(edges_deg)))


def bin_of_separation(
    separation: Column, count: int = 50, min_deg: float = 1.0, max_deg: float = 15.0, scale: str = "sqrt"
) -> Column:
    """Closed-form bin of a separation in radians; NULL outside [min, max)."""
    forward = {"linear": lambda c: c, "sqrt": F.sqrt}.get(scale, F.log10)
    low, high = (_transform(scale)[0](value) for value in (min_deg, max_deg))
    position = F.floor((forward(F.degrees(separation)) - F.lit(low)) * count / F.lit(high - low))
    return F.when((position >= 0) & (position < count), position.cast("int"))

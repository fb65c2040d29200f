"""Weighted pair counts per separation bin.

Exact copies of a position are merged first (their weights add up), which keeps the result and removes the worst
skew.  Points that may be near each other then meet in groups, every unordered pair in one, and `blocks` adds a group's pairs up:
pairs are never stored or shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylattice.functions.angles import chord_of
from skylattice.functions.bins import Bins
from skylattice.functions.cells import with_centre, with_ring_centre
from skylattice.operators.blocks import group_sums, is_placed
from skylattice.operators.proximity import cube_side, in_home_cube, in_touched_cubes, split_hot_keys

KINDS = ("dd", "dr", "rr")


def merge_copies(points: DataFrame, *tags: str) -> DataFrame:
    """One row per exact position (and tags): `weight` = sum of weights, `n` = number of rows."""
    count = F.sum("n") if "n" in points.columns else F.count("*")
    return points.groupBy("x", "y", "z", *tags).agg(F.sum("weight").alias("weight"), count.alias("n"))


def _prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select([F.col(c).alias(prefix + c) for c in df.columns])


def by_kind(pairs: DataFrame) -> DataFrame:
    """(`kind`, `bin`, `region_1` <= `region_2`, `weighted`, `pairs`) of the sums of `blocks`, `kind` as its number in KINDS."""
    return pairs.groupBy(
        (F.col("a_is_random") + F.col("b_is_random")).alias("kind"),
        "bin",
        F.least("a_region", "b_region").alias("region_1"),
        F.greatest("a_region", "b_region").alias("region_2"),
    ).agg(F.sum("weighted").alias("weighted"), F.sum("pairs").alias("pairs"))


def cross_histogram(
    left: DataFrame, right: DataFrame, bins: Bins, upper_closed: bool = False, hot_rows: int = 250_000,
    cubes_per_ball: float = 2.0,
) -> DataFrame:
    """Pairs (left row, right row) per bin: `bin`, `weighted` = sum of weight products, `pairs`.  Empty bins are zero."""
    chord = chord_of(min(bins.max_radius, math.pi))
    side = cube_side(chord, cubes_per_ball)
    a = in_home_cube(_prefixed(merge_copies(left).where(is_placed()), "a_"), side, "a_x", "a_y", "a_z")
    b = in_touched_cubes(_prefixed(merge_copies(right), "b_"), side, chord, "b_x", "b_y", "b_z")
    # Copies in cubes that are nobody's home meet nothing.
    b = b.join(a.select("cube").distinct(), "cube", "left_semi")
    a, b, keys = split_hot_keys(a, b, "cube", hot_rows, ["a_x", "a_y", "a_z"], ["b_x", "b_y", "b_z"])
    a, b = (df.withColumns({f"{v}_is_random": F.lit(0), f"{v}_region": F.lit(0)}) for df, v in ((a, "a"), (b, "b")))
    pairs = group_sums(a, b, keys, bins, upper_closed, once=False)
    found = pairs.groupBy("bin").agg(F.sum("weighted").alias("weighted"), F.sum("pairs").alias("pairs"))
    return with_empty_bins(found, bins)


def with_empty_bins(found: DataFrame, bins: Bins) -> DataFrame:
    """`bin`, `weighted`, `pairs` with a zero row for every bin that has none."""
    zero = bins.frame(found.sparkSession).select("bin", F.lit(0.0).alias("weighted"), F.lit(0).cast("bigint").alias("pairs"))
    every = found.select("bin", F.col("weighted").cast("double").alias("weighted"), "pairs").unionByName(zero)
    return every.groupBy("bin").agg(F.sum("weighted").alias("weighted"), F.sum("pairs").alias("pairs"))


def pair_sums(
    points: DataFrame, bins: Bins, upper_closed: bool = False, hot_rows: int = 250_000, cubes_per_ball: float = 2.0
) -> DataFrame:
    """All three kinds of pair sums from one join: (`kind`, `bin`, `region_1` <= `region_2`, `weighted`, `pairs`).

    `points` has `x`, `y`, `z`, `weight`, `is_random` (0 data, 1 random) and `region`.  `dd` and `rr` count ordered pairs, so each
    unordered one twice, and a point with itself only if the first edge is zero; `dr` counts each data-random pair once.
    """
    chord = chord_of(min(bins.max_radius, math.pi))
    side = cube_side(chord, cubes_per_ball)
    merged = merge_copies(points, "is_random", "region")
    a = in_home_cube(_prefixed(merged.where(is_placed()), "a_"), side, "a_x", "a_y", "a_z")
    b = in_home_cube(_prefixed(merged, "b_"), side, "b_x", "b_y", "b_z", "b_home")
    # Half of the neighbourhood is enough: a copy only visits cubes up to its own.
    b = in_touched_cubes(b, side, chord, "b_x", "b_y", "b_z").where("cube <= b_home")
    b = b.withColumn("b_same", F.col("cube") == F.col("b_home")).drop("b_home")
    # Copies in cubes that are nobody's home meet nothing.
    b = b.join(a.select("cube").distinct(), "cube", "left_semi")
    a, b, keys = split_hot_keys(a, b, "cube", hot_rows, ["a_x", "a_y", "a_z"], ["b_x", "b_y", "b_z"])
    pairs = group_sums(a, b, keys, bins, upper_closed, once=True)
    columns = ["kind", "bin", "region_1", "region_2"]
    found = by_kind(pairs)
    if bins.edges[0] <= 0.0 and not upper_closed:
        # Points without a position are in no group, but a pair with themselves.
        own = merged.where(~is_placed()).groupBy((2 * F.col("is_random")).alias("kind"), F.lit(0).alias("bin"),
                             F.col("region").alias("region_1"), F.col("region").alias("region_2")).agg(
            F.sum(F.col("weight") * F.col("weight")).alias("weighted"), F.sum(F.col("n") * F.col("n")).alias("pairs"))
        found = found.unionByName(own).groupBy(*columns).agg(F.sum("weighted").alias("weighted"), F.sum("pairs").alias("pairs"))
    return found.withColumn("kind", F.get(F.array(*[F.lit(k) for k in KINDS]), F.col("kind").cast("int")))


def as_points(df: DataFrame, is_random: bool = False, region: Column | None = None) -> DataFrame:
    """The columns `pair_sums` needs; one region for all unless given."""
    return df.select(
        "x", "y", "z", F.col("weight").cast("double").alias("weight"),
        F.lit(int(is_random)).alias("is_random"), (region if region is not None else F.lit(0)).alias("region"),
    )


def auto_histogram(points: DataFrame, bins: Bins, **tuning) -> DataFrame:
    """Ordered pairs of one catalogue with itself per bin."""
    found = pair_sums(as_points(points), bins, **tuning)
    return with_empty_bins(found.select("bin", "weighted", "pairs"), bins)


def cells_as_points(cells: DataFrame, order: int, scheme: str = "ring") -> DataFrame:
    """Weighted cells (`pix_*`, `weight`) placed at their centres."""
    centred = (with_ring_centre if scheme == "ring" else with_centre)(cells, order, f"pix_{scheme}")
    return centred.drop("theta", "phi")


def cell_histogram(left: DataFrame, right: DataFrame, order: int, bins: Bins, scheme: str = "ring", **tuning) -> DataFrame:
    """Pairs of weighted cells by centre distance; a bin is (lo, hi] here, the annulus between two discs."""
    return cross_histogram(
        cells_as_points(left, order, scheme), cells_as_points(right, order, scheme), bins, upper_closed=True, **tuning
    )

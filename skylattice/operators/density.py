"""Density maps and per-cell statistics of point catalogues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.functions.cells import with_nest, with_ring

XYZ = ("x", "y", "z")


def density_map(points: DataFrame, order: int, scheme: str = "ring", weight: str = "weight") -> DataFrame:
    """Sum of weights per cell: (`pix_ring` or `pix_nest`, `weight`); empty cells are absent."""
    name = f"pix_{scheme}"
    tagged = (with_ring if scheme == "ring" else with_nest)(points, order, name, vector=XYZ)
    return tagged.groupBy(name).agg(F.sum(F.col(weight)).alias("weight"))


def cell_of_each(points: DataFrame, order: int, scheme: str = "ring", weight: str = "weight") -> DataFrame:
    """The (cell, weight) of every single row."""
    name = f"pix_{scheme}"
    tagged = (with_ring if scheme == "ring" else with_nest)(points, order, name, vector=XYZ)
    return tagged.select(name, F.col(weight).alias("weight"))


def total_weight(points: DataFrame, weight: str = "weight") -> DataFrame:
    return points.agg(F.count("*").alias("n"), F.sum(weight).alias("total_weight"))


def cell_quality(calibration: DataFrame, order: int) -> DataFrame:
    """Mean of `v1` and `v2` and the row count per ring cell."""
    tagged = with_ring(calibration, order, "pix_ring", vector=XYZ)
    return tagged.groupBy("pix_ring").agg(
        F.avg("v1").alias("mean1"), F.avg("v2").alias("mean2"), F.count("*").alias("n")
    )


def good_cells(quality: DataFrame, max_mean1: float = 0.1, min_mean2: float = 25.0, min_count: int = 15) -> DataFrame:
    """Cells with mean1 below, mean2 above and count above their (exclusive) limits."""
    return quality.where((F.col("mean1") < max_mean1) & (F.col("mean2") > min_mean2) & (F.col("n") > min_count))

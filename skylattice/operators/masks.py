"""Survey masks: membership filters, coverage of coarse cells, and regions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.functions.cells import nest_parent, npix, ring_to_nest, with_nest
from skylattice.operators.ranking import global_rank

XYZ = ("x", "y", "z")


def filter_points(points: DataFrame, mask: DataFrame, order: int, exclude: bool = False) -> DataFrame:
    """Rows whose nested cell is (or with `exclude` is not) in the mask's `pix_nest`.

    The join choice is left to the optimizer: a mask small by its statistics is broadcast, a large one is not.
    """
    tagged = with_nest(points, order, "pix_nest", vector=XYZ)
    return tagged.join(mask.select("pix_nest"), "pix_nest", "left_anti" if exclude else "left_semi").drop("pix_nest")


def filter_cells(cells: DataFrame, mask: DataFrame, order: int, exclude: bool = False) -> DataFrame:
    """The same for rows keyed by a ring cell `pix_ring`."""
    tagged = ring_to_nest(cells, order, "pix_ring", "_nest")
    keys = mask.select(F.col("pix_nest").alias("_nest"))
    return tagged.join(keys, "_nest", "left_anti" if exclude else "left_semi").drop("_nest")


def join_cells(cells: DataFrame, ring_mask: DataFrame) -> DataFrame:
    """Ring cells that occur in a mask already numbered by ring."""
    return cells.join(ring_mask.select("pix_ring").distinct(), "pix_ring")


def coverage(mask: DataFrame, order: int, coarse_order: int) -> DataFrame:
    """(`parent`, `n`): mask cells per coarse cell."""
    cells = mask.select("pix_nest").distinct()
    return cells.groupBy(nest_parent(F.col("pix_nest"), order, coarse_order).alias("parent")).agg(F.count("*").alias("n"))


def confident_cells(mask: DataFrame, order: int, coarse_order: int, confidence: float = 0.9) -> DataFrame:
    """Mask cells of the coarse cells covered by more than `confidence`; (`pix_nest`, `parent`)."""
    enough = coverage(mask, order, coarse_order).where(F.col("n") > F.lit(confidence * 4 ** (order - coarse_order)))
    cells = mask.select("pix_nest").distinct()
    cells = cells.withColumn("parent", nest_parent(F.col("pix_nest"), order, coarse_order))
    return cells.join(enough.select("parent"), "parent", "left_semi").select("pix_nest", "parent")


def parent_regions(cells: DataFrame, coarse_order: int, count: int | None = None) -> DataFrame:
    """(`pix_nest`, `region`): every kept coarse cell is a region, numbered from 0 in id order.

    With `count` neighbouring numbers are merged into that many regions of nearly equal cell count.
    """
    parents = cells.select("parent").distinct()
    ranked = global_rank(parents, "parent", 2 * coarse_order + 4, out="region")
    if count:
        size = parents.agg(F.count("*")).scalar()
        ranked = ranked.withColumn("region", F.floor(((F.col("region") + 1) * count - 1) / F.greatest(size, F.lit(count))))
    return cells.join(ranked, "parent").select("pix_nest", F.col("region").cast("int").alias("region"))


def mask_summary(mask: DataFrame, order: int) -> DataFrame:
    """One row: `n_cells` and `mask_factor` = all cells over mask cells."""
    return mask.select("pix_nest").distinct().agg(F.count("*").alias("n_cells")).withColumn(
        "mask_factor", F.try_divide(F.lit(float(npix(order))), F.col("n_cells"))
    )

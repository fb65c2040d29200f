"""Mask text: the first field is a cell id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.functions.angles import with_degrees
from skylattice.functions.cells import nest_parent, ring_to_nest, with_centre, with_children, with_ring_centre


def parse_mask(lines: DataFrame, mask_order: int, order: int, scheme: str = "nest") -> DataFrame:
    """Distinct `pix_nest` at `order`.

    Finer masks are coarsened (any cell marks its parent), coarser ones written out to all sub-cells; lines whose first field is not a number
    are skipped.  `scheme="ring"` reads ring ids.
    """
    cells = lines.select(F.get(F.split("value", ","), 0).try_cast("bigint").alias("pix_nest")).where("pix_nest IS NOT NULL")
    if scheme == "ring":
        cells = ring_to_nest(cells.withColumnRenamed("pix_nest", "pix_ring"), mask_order).select("pix_nest")
    if mask_order >= order:
        return cells.select(nest_parent(F.col("pix_nest"), mask_order, order).alias("pix_nest")).distinct()
    # Duplicates go before the cells are written out.
    return with_children(cells.distinct(), mask_order, order).select(F.col("child").alias("pix_nest"))


def read_mask(spark: SparkSession, path: str, mask_order: int, order: int, scheme: str = "nest") -> DataFrame:
    return parse_mask(spark.read.text(path), mask_order, order, scheme)


def mask_table(mask: DataFrame, order: int) -> DataFrame:
    """(`pix_ring`, `mean1`, `mean2`, `n`, `region`) -> `pix_ring`, `ra`, `dec`, `mean1`, `mean2`, `n`, `region`."""
    placed = with_degrees(with_ring_centre(mask, order, "pix_ring"))
    return placed.select("pix_ring", "ra", "dec", "mean1", "mean2", "n", "region")


def write_mask(mask: DataFrame, order: int, path: str, single_file: bool = False) -> None:
    """Comma-separated rows of `mask_table`, replacing the folder; one file only on request."""
    rows = mask_table(mask, order)
    (rows.coalesce(1) if single_file else rows).write.mode("overwrite").csv(path)


def region_map(regions: DataFrame, order: int) -> DataFrame:
    """(`ra`, `dec`, `region`) with regions numbered from 1, for every mask cell (`pix_nest`, `region` from 0)."""
    placed = with_degrees(with_centre(regions, order, "pix_nest"))
    return placed.select("ra", "dec", (F.col("region") + 1).alias("region"))


def write_region_map(regions: DataFrame, order: int, path: str) -> None:
    region_map(regions, order).write.mode("overwrite").csv(path)

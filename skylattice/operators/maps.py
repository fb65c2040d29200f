"""Pixel maps as sparse tables (`map_id`, `pix`, `value`); an undefined pixel is NULL or absent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.functions.cells import nest_parent, nest_to_ring, npix, ring_to_nest, with_children

# Fixed value: the number that marks an undefined pixel in imported maps.
UNDEFINED = -1.6375e30


def defined(value: Column, marker: float = UNDEFINED) -> Column:
    """NULL for values within a relative 1e-5 of the marker."""
    return F.when(F.abs(value - F.lit(marker)) < F.lit(1e-5 * abs(marker)), F.lit(None)).otherwise(value)


def from_array(maps: DataFrame, values: str = "values") -> DataFrame:
    """(`map_id`, `order`, `pix`, `value`) of maps given as one array per row; the order follows from the length."""
    order = F.expr(f"shiftright(length(bin(cast(size({values}) div 12 AS bigint))) - 1, 1)")
    return maps.select("map_id", order.alias("order"), F.posexplode(values).alias("pix", "value")).select(
        "map_id", "order", F.col("pix").cast("bigint").alias("pix"), defined(F.col("value")).alias("value"))


def to_ring(maps: DataFrame, order: int) -> DataFrame:
    """Renumber a nested map by rings."""
    return nest_to_ring(maps, order, "pix", "_ring").withColumn("pix", F.col("_ring")).drop("_ring")


def to_nest(maps: DataFrame, order: int) -> DataFrame:
    return ring_to_nest(maps, order, "pix", "_nest").withColumn("pix", F.col("_nest")).drop("_nest")


def upgrade(maps: DataFrame, order: int, to_order: int) -> DataFrame:
    """Finer nested map: every sub-pixel gets the pixel's value."""
    finer = with_children(maps.select("map_id", "pix", "value"), order, to_order, "pix", "_sub")
    return finer.select("map_id", F.col("_sub").alias("pix"), "value")


def degrade(maps: DataFrame, order: int, to_order: int, pessimistic: bool = False) -> DataFrame:
    """Coarser nested map: mean of the defined sub-pixels.

    A pixel with no defined sub-pixel is undefined, with `pessimistic` already one with any undefined or absent sub-pixel.
    """
    need = 4 ** (order - to_order) if pessimistic else 1
    parent = nest_parent(F.col("pix"), order, to_order).alias("pix")
    return maps.groupBy("map_id", parent).agg(
        F.when(F.count("value") >= need, F.avg("value")).alias("value"))


def regrid(maps: DataFrame, order: int, to_order: int, scheme: str = "nest", to_scheme: str = "nest",
           pessimistic: bool = False) -> DataFrame:
    """Any change of resolution and numbering."""
    if order == to_order and scheme == to_scheme:
        return maps.select("map_id", "pix", "value")
    nested = to_nest(maps, order) if scheme == "ring" else maps
    nested = nested.select("map_id", "pix", "value")
    if to_order > order:
        nested = upgrade(nested, order, to_order)
    elif to_order < order:
        nested = degrade(nested, order, to_order, pessimistic)
    return to_ring(nested, to_order).select("map_id", "pix", "value") if to_scheme == "ring" else nested


def filled(map_ids: DataFrame, order: int, value: float) -> DataFrame:
    """A map with one value everywhere for each `map_id`; pixels are generated in parallel per base face block."""
    block = 1 << min(2 * order, 16)
    starts = map_ids.select("map_id", F.explode(F.sequence(
        F.lit(0).cast("bigint"), F.lit(npix(order) - 1).cast("bigint"), F.lit(block).cast("bigint"))).alias("start"))
    starts = starts.repartition("map_id", "start")
    return starts.select("map_id", F.explode(F.expr(f"sequence(start, start + {block - 1}L)")).alias("pix"),
                         F.lit(value).alias("value"))


def full(maps: DataFrame, order: int) -> DataFrame:
    """Every pixel of every map in the table, NULL where absent."""
    blank = filled(maps.select("map_id").distinct(), order, 0.0).select("map_id", "pix", F.lit(None).cast("double").alias("value"))
    present = maps.select("map_id", "pix", "value")
    return present.unionByName(blank).groupBy("map_id", "pix").agg(F.max("value").alias("value"))


def set_pixels(maps: DataFrame, changes: DataFrame) -> DataFrame:
    """The map with the pixels of `changes` (same columns) overwritten or added."""
    rows = maps.select("map_id", "pix", "value", F.lit(0).alias("newer")).unionByName(
        changes.select("map_id", "pix", "value", F.lit(1).alias("newer")))
    return rows.groupBy("map_id", "pix").agg(F.max_by("value", "newer").alias("value"))


def get_pixels(maps: DataFrame, wanted: DataFrame) -> DataFrame:
    """Values of the pixels listed in `wanted` (`map_id`, `pix`); NULL where the map has none."""
    return wanted.join(maps.select("map_id", "pix", "value"), ["map_id", "pix"], "left")


def all_pixels(spark: SparkSession, order: int) -> DataFrame:
    return spark.range(npix(order)).withColumnRenamed("id", "pix")

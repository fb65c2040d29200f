"""Seeded random comparison catalogues.

Every number comes from a hash of (row id, seed, draw), so a row has the same value however the work is split
and when a lost task is repeated.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.functions.angles import phi_of_ra, ra_of_phi, theta_of_dec
from skylattice.functions.cells import MAX_ORDER, npix, with_centre
from skylattice.operators.ranking import global_rank

# Largest Poisson mean drawn at once; larger means are sums of independent draws.
_CHUNK_MEAN = 8.0


def uniform(seed: int, draw: int, *keys: Column) -> Column:
    """A uniform double in [0, 1) with 53 random bits."""
    return F.shiftrightunsigned(F.xxhash64(*keys, F.lit(seed), F.lit(draw)), 11) * F.lit(2.0**-53)


def _rows(source: SparkSession | DataFrame, size: int | None) -> DataFrame:
    return source.range(size) if isinstance(source, SparkSession) else source.select(F.col("id"))


def random_sphere(source: SparkSession | DataFrame, size: int | None = None, seed: int = 0) -> DataFrame:
    """Points spread evenly over the sphere: `size` rows, or one per `id` of a table."""
    rows = _rows(source, size).withColumns({
        "z": 2.0 * uniform(seed, 1, F.col("id")) - 1.0,
        "phi": 2.0 * math.pi * uniform(seed, 2, F.col("id")),
    })
    rows = rows.withColumn("_s", F.sqrt((1.0 - F.col("z")) * (1.0 + F.col("z"))))
    rows = rows.withColumns({
        "theta": F.acos("z"), "x": F.col("_s") * F.cos("phi"), "y": F.col("_s") * F.sin("phi"),
    })
    return rows.select("id", ra_of_phi(F.col("phi")).alias("ra"), (90.0 - F.degrees("theta")).alias("dec"),
                       F.lit(1.0).alias("weight"), "theta", "phi", "x", "y", "z")


def random_box(
    source: SparkSession | DataFrame, size: int | None = None, seed: int = 0, ra_min: float = 140.0, ra_max: float = 220.0,
    dec_min: float = 5.0, dec_max: float = 45.0, mirror: bool = True,
) -> DataFrame:
    """Points spread evenly over an ra/dec box (even in ra and in the sine of dec)."""
    low, high = math.sin(math.radians(dec_min)), math.sin(math.radians(dec_max))
    rows = _rows(source, size).select(
        "id",
        (F.lit(ra_min) + (ra_max - ra_min) * uniform(seed, 1, F.col("id"))).alias("ra"),
        F.degrees(F.asin(F.lit(low) + (high - low) * uniform(seed, 2, F.col("id")))).alias("dec"),
        F.lit(1.0).alias("weight"),
    )
    rows = rows.withColumns({"theta": theta_of_dec(F.col("dec")), "phi": phi_of_ra(F.col("ra"), mirror)})
    return rows.withColumns({
        "x": F.sin("theta") * F.cos("phi"), "y": F.sin("theta") * F.sin("phi"), "z": F.cos("theta")})


def _poisson(mean: float, u: Column) -> Column:
    """Inverse of the cumulative distribution at u: a ladder that ends where doubles cannot tell 1 from the sum."""
    total, term, k = 0.0, math.exp(-mean), 0
    ladder = None
    while True:
        total += term
        if total >= 1.0 - 2.0**-53 or (k > mean and term < 2.0**-60):
            return (ladder.otherwise(k) if ladder is not None else F.lit(k)).cast("bigint")
        ladder = F.when(u < F.lit(total), k) if ladder is None else ladder.when(u < F.lit(total), k)
        k += 1
        term *= mean / k


def random_counts(cells: DataFrame, mean: float, seed: int = 0, pix: str = "pix") -> DataFrame:
    """An independent Poisson count per cell: (`pix`, `weight`), cells with count zero left out.

    A sum of m independent draws of mean mean/m has the same distribution; m keeps each draw's ladder short.
    """
    draws = max(1, math.ceil(mean / _CHUNK_MEAN))
    # The draws are added up within the row: nothing is exploded or shuffled, whatever the mean.
    one = lambda draw: _poisson(mean / draws, uniform(seed, 3, F.col(pix), draw))
    count = F.aggregate(F.sequence(F.lit(1), F.lit(draws)), F.lit(0).cast("bigint"), lambda total, draw: total + one(draw))
    counted = cells.select(F.col(pix).alias("pix"), count.alias("_count"))
    return counted.where("_count > 0").select("pix", F.col("_count").cast("double").alias("weight"))


def random_cells(spark: SparkSession, order: int, size: float, seed: int = 0, mask: DataFrame | None = None,
                 mask_cells: int | None = None) -> DataFrame:
    """Counts over the whole sky, or over the cells of a mask (`pix_nest`) given its number of cells."""
    if mask is None:
        cells = spark.range(npix(order)).withColumnRenamed("id", "pix")
        return random_counts(cells, size / npix(order), seed)
    return random_counts(mask.select(F.col("pix_nest").alias("pix")), size / mask_cells, seed)


def _split(level: int, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Arrow function: rows (`pix`, `n`, `w`) become the children of each node with the points they get.

    A node's draws come from its own generator, keyed by seed, level and node, so they do not depend on the batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            children, counts = [], []
            for pix, n, weights in zip(*(column.to_pylist() for column in batch.columns)):
                draw = np.random.Generator(np.random.Philox(key=[(seed * 64 + level) % 2**64, pix]))
                left, open_weight = n, sum(weights)
                for place, weight in enumerate(weights):
                    # The last child with a weight takes what is left.
                    given = left if weight == open_weight else int(draw.binomial(left, weight / open_weight)) if weight else 0
                    left, open_weight = left - given, open_weight - weight
                    if given:
                        children.append(pix * len(weights) + place)
                        counts.append(given)
            yield pa.RecordBatch.from_arrays([pa.array(children, pa.int64()), pa.array(counts, pa.int64())], names=["pix", "n"])

    return run


def random_counts_of_total(spark: SparkSession, order: int, size: int, seed: int = 0, cells: DataFrame | None = None) -> DataFrame:
    """(`pix`, `weight`): how many of exactly `size` points, spread evenly, fall in each nested cell of `order`; empty cells left out.

    The total is split down the pixel tree by binomial draws in proportion to the kept cells (`cells`: `pix_nest`, repeats count once; None:
    the whole sky) below each child, so no point is ever made and the work follows the cells that get some.  A node's draw depends on
    the seed and the node alone: results are the same under any partitioning.  Without kept cells or points there are no rows;
    a negative `size` is an error.
    """
    if size < 0:
        raise ValueError("a number of points is not negative")
    kept = []
    if cells is not None:
        # Kept cells below each node, level by level, as one row for the four children of a node.
        level = cells.select(F.col("pix_nest").alias("pix")).where("pix IS NOT NULL").distinct().withColumn("k", F.lit(1).cast("bigint"))
        for _ in range(order):
            share = [F.coalesce(F.sum(F.when(F.col("pix") % 4 == place, F.col("k"))), F.lit(0)) for place in range(4)]
            level = level.groupBy(F.shiftright("pix", 2).alias("pix")).agg(F.array(*share).alias("w"))
            kept.insert(0, level)
            level = level.select("pix", F.expr("w[0] + w[1] + w[2] + w[3]").alias("k"))
        faces = {row["pix"]: row["k"] for row in level.collect()}
        roots = [faces.get(face, 0) for face in range(12)]
    else:
        roots = [1] * 12
    if not any(roots) or not size:
        return spark.createDataFrame([], "pix long, weight double")
    # The root has the twelve faces as children; their table has at most twelve rows.
    found = spark.createDataFrame([(0, size, roots)], "pix long, n long, w array<long>").mapInArrow(_split(0, seed), "pix long, n long")
    for depth in range(1, order + 1):
        if depth == 3:
            found = found.repartition("pix")
        found = found.join(kept[depth - 1], "pix").select("pix", "n", "w") if kept else found.withColumn("w", F.expr("array(1L, 1L, 1L, 1L)"))
        found = found.mapInArrow(_split(depth, seed), "pix long, n long")
    return found.select("pix", F.col("n").cast("double").alias("weight"))


def random_in_cells(cells: DataFrame, order: int, size: int, seed: int = 0) -> DataFrame:
    """`size` points spread evenly over the given nested cells (`pix_nest`, each once): `id`, `weight`, `x`, `y`, `z`.

    A point draws the place of its cell among all, and a cell of order 29 inside it.  Rows follow the masked area: nothing is
    made outside.
    """
    spark = cells.sparkSession
    listed = global_rank(cells.select("pix_nest"), "pix_nest", 2 * order + 4, out="_place")
    n = cells.count()
    if not n or size <= 0:
        return spark.createDataFrame([], "id long, weight double, x double, y double, z double")
    inside = 1 << (2 * (MAX_ORDER - order))
    points = spark.range(size).select(
        "id", F.least(F.floor(uniform(seed, 1, F.col("id")) * n), F.lit(n - 1)).alias("_place"),
        F.floor(uniform(seed, 2, F.col("id")) * inside).alias("_sub"),
    )
    placed = points.join(listed, "_place").withColumn("_fine", F.col("pix_nest") * inside + F.col("_sub"))
    return with_centre(placed, MAX_ORDER, "_fine").select("id", F.lit(1.0).alias("weight"), "x", "y", "z")

"""Crossmatch, correlation and mask making from files to files."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.functions.bins import make_bins
from skylattice.functions.cells import npix, with_centre, with_nest
from skylattice.operators import correlation, density, masks, match, paircount
from skylattice.operators.ranking import contiguous_regions, global_rank, rank_label, tiled_regions
from skylattice.operators.pyramid import pyramid_sums
from skylattice.session import checkpointed
from skylattice.sources import catalogs, randoms, results
from skylattice.sources import masks as mask_files


def run_crossmatch(
    spark: SparkSession, x_path: str, y_path: str, out: str, radius_arcsec: float = 1.0, border: bool = True,
    cell_order: int = 5, prefilter_order: int | None = None,
) -> None:
    """Match two `id,ra,dec` catalogues and write (`x_id`, `y_id`, `sep_rel`).

    `prefilter_order` drops rows of y that no row of x can match before they are joined; it never changes the result.
    """
    x, y = catalogs.read_match_catalog(spark, x_path), catalogs.read_match_catalog(spark, y_path)
    if prefilter_order is not None:
        y = match.in_cells_of(y, x, prefilter_order, math.radians(radius_arcsec / 3600.0))
    results.write_matches(match.crossmatch(x, y, radius_arcsec, border, cell_order), out)


def make_mask(calibration: DataFrame, order: int, max_mean1: float = 0.1, min_mean2: float = 25.0, min_count: int = 15,
              pieces: int = 32) -> DataFrame:
    """Good cells of a calibration catalogue: `pix_ring`, `mean1`, `mean2`, `n` and a `region` label by ring order."""
    good = density.good_cells(density.cell_quality(calibration, order), max_mean1, min_mean2, min_count)
    ranked = global_rank(good, "pix_ring", 2 * order + 4)
    size = good.agg(F.count("*")).scalar()
    return ranked.withColumn("region", rank_label(F.col("rank"), size, pieces)).drop("rank")


def run_createmask(spark: SparkSession, path: str, order: int, out: str, single_file: bool = False) -> None:
    mask_files.write_mask(make_mask(catalogs.read_calibration(spark, path), order), order, out, single_file)


@dataclass(frozen=True)
class CorrelationSettings:
    data_ra: int = 0
    data_dec: int = 1
    data_weight: int = -1
    bins: int = 50
    min_radius: float = 1.0
    max_radius: float = 15.0
    scale: str = "sqrt"
    use_cells: bool = True
    order: int = 7
    mask_order: int = 9
    mask_coarse_order: int = 3
    mask_confidence: float = 0.9
    jackknife: bool = True
    regions: int | None = None
    region_method: str = "parents"
    data_size: int = 1000
    rand_factor: float = 10.0
    seed: int = 0
    #: Count pairs by the count pyramid: for catalogues that are too dense to meet all pairs within the greatest radius.
    pyramid: bool = False


def tagged(points: DataFrame, regions: DataFrame | None, order: int) -> DataFrame:
    """Points of the kept regions with their `region`; without regions everything is region 0."""
    if regions is None:
        return points.withColumn("region", F.lit(0))
    return with_nest(points, order, "pix_nest", vector=density.XYZ).join(regions, "pix_nest").drop("pix_nest")


def mask_regions(mask: DataFrame, settings: CorrelationSettings) -> DataFrame:
    """(`pix_nest`, `region`) for the confident part of a mask, by the chosen way of cutting it."""
    kept = masks.confident_cells(mask, settings.order, settings.mask_coarse_order, settings.mask_confidence)
    if settings.region_method == "tiles":
        return tiled_regions(kept, settings.order, settings.regions or 16).select("pix_nest", "region")
    if settings.region_method == "runs":
        return contiguous_regions(kept, settings.order, settings.regions or 16)
    return masks.parent_regions(kept, settings.mask_coarse_order, settings.regions)


def correlation_tables(
    data: DataFrame, random: DataFrame, settings: CorrelationSettings, regions: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """All result tables for two point catalogues (`x`, `y`, `z`, `weight`).

    The pair sums (bins x regions^2 rows at most) are the only expensive step and are materialised once.
    """
    spark = data.sparkSession
    bins = make_bins(settings.bins, settings.min_radius, settings.max_radius, settings.scale)
    if settings.use_cells:
        place = lambda points: paircount.cells_as_points(density.density_map(points, settings.order), settings.order)
        data, random = place(data), place(random)
    data, random = tagged(data, regions, settings.order), tagged(random, regions, settings.order)
    points = paircount.as_points(data, False, F.col("region")).unionByName(paircount.as_points(random, True, F.col("region")))
    if settings.pyramid:
        sums = checkpointed(pyramid_sums(points, bins, upper_closed=settings.use_cells).sums)
    else:
        sums = checkpointed(paircount.pair_sums(points, bins, upper_closed=settings.use_cells))
    weights = checkpointed(points.groupBy("is_random", "region").agg(F.sum("weight").alias("weight")))
    listed = spark.range(1).select(F.lit(0).alias("region")) if regions is None else regions.select("region").distinct()
    reals = checkpointed(correlation.realisations(sums, weights, listed, bins))
    tables = {"bins": bins.frame(spark), "realisations": reals}
    if settings.jackknife and regions is not None:
        cov = correlation.covariance(reals)
        tables["covariance"] = correlation.correlation_matrix(cov)
        tables["errors"] = correlation.error_bars(cov)
    tables["estimate"] = correlation.estimate(reals)
    tables["summary"] = run_summary(weights, settings)
    return tables


def run_summary(weights: DataFrame, settings: CorrelationSettings) -> DataFrame:
    """One row: measured weights of both catalogues and the run's parameters."""
    return weights.agg(
        F.coalesce(F.sum(F.when(F.col("is_random") == 0, F.col("weight"))), F.lit(0.0)).alias("dsize"),
        F.coalesce(F.sum(F.when(F.col("is_random") == 1, F.col("weight"))), F.lit(0.0)).alias("rsize"),
    ).select(
        "dsize", "rsize", F.lit(settings.mask_coarse_order).alias("lowlevel"), F.lit(settings.order).alias("highlevel"),
        F.lit(settings.use_cells).alias("usecells"), F.lit(settings.scale).alias("scale"),
    )


def random_catalogue(spark: SparkSession, size: float, settings: CorrelationSettings, regions: DataFrame | None) -> DataFrame:
    """About `size` random points over the kept cells, or the whole sky.

    With cells, and as many points as cells, each cell draws its own count; else points are made one by one.  Rows follow the kept area.
    """
    kept = npix(settings.order) if regions is None else regions.count()
    seed = settings.seed + 1
    if settings.use_cells and kept and size >= kept:
        counts = randoms.random_cells(spark, settings.order, size, seed, regions, kept)
        return with_centre(counts, settings.order, "pix").select("weight", "x", "y", "z")
    if regions is not None:
        return randoms.random_in_cells(regions.select("pix_nest"), settings.order, int(size), seed)
    return randoms.random_sphere(spark, int(size), seed)


def run_correlate(
    spark: SparkSession, settings: CorrelationSettings, data_path: str | None = None, rand_path: str | None = None,
    mask_path: str | None = None, out: str | None = None, regions_out: str | None = None,
) -> dict[str, DataFrame]:
    """Correlation of a catalogue (or a random one) against a random catalogue, with an optional mask, from files."""
    regions = None
    if mask_path:
        mask = mask_files.read_mask(spark, mask_path, settings.mask_order, settings.order)
        regions = checkpointed(mask_regions(mask, settings))
        if regions_out:
            mask_files.write_region_map(regions, settings.order, regions_out)
    if data_path:
        data = catalogs.read_catalog(
            spark, data_path, ra=settings.data_ra, dec=settings.data_dec, weight=settings.data_weight)
    else:
        data = randoms.random_sphere(spark, settings.data_size, settings.seed)
    if rand_path:
        random = catalogs.read_catalog(spark, rand_path)
    else:
        weight = tagged(data, regions, settings.order).agg(F.sum("weight")).first()[0] or 0.0
        random = random_catalogue(spark, weight * settings.rand_factor, settings, regions)
    tables = correlation_tables(data, random, settings, regions)
    if out:
        count = 0 if regions is None or not settings.jackknife else regions.select("region").distinct().count()
        name = results.result_name(out, settings.order, settings.mask_coarse_order, settings.mask_confidence, count)
        results.write_correlation(tables, name)
    return tables

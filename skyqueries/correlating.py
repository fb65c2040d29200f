"""Density maps, masks, regions, pair counts and the correlation estimate."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from skylattice.functions.bins import make_bins
from skylattice.functions.cells import nest_to_ring, with_nest
from skylattice.operators import correlation, density, masks, paircount, pyramid, rings
from skylattice.operators.ranking import contiguous_regions, global_rank, tiled_regions
from skylattice.plans.workloads import CorrelationSettings, correlation_tables, make_mask, run_summary, tagged
from skylattice.session import scratch_folder
from skylattice.sources import masks as mask_files
from skylattice.sources.results import write_correlation
from skyqueries import duck
from skyqueries.fixtures import r_sql, rounded, sky, sky_sql
from skyqueries.registry import query

_CUSTOMER, _PART, _ORDERS = sky_sql("customer"), sky_sql("part"), sky_sql("orders")

# --- density ----------------------------------------------------------------------------------------


@query("a01_density_map", f"SELECT pix_ring, sum(weight)::double AS weight FROM {duck.ring_sql(_ORDERS, 5)} GROUP BY pix_ring")
def density_map(spark, sf_dir):
    return density.density_map(sky(spark, sf_dir, "orders"), 5)


@query("a01_density_map_nest", f"SELECT pix_nest, sum(weight)::double AS weight FROM {duck.nest_sql(_ORDERS, 8)} GROUP BY pix_nest")
def density_map_nest(spark, sf_dir):
    return density.density_map(sky(spark, sf_dir, "orders"), 8, "nest")


@query("a01_cell_of_each", f"SELECT pix_ring, weight FROM {duck.ring_sql(_ORDERS, 5)}")
def cell_of_each(spark, sf_dir):
    return density.cell_of_each(sky(spark, sf_dir, "orders"), 5)


# Three readings per order; most cells are good, some fail each threshold.
_CALIBRATION = f"""(SELECT *, (id % 10 + id % 3) / 70::double AS v1, 20 + id % 12 + (CASE WHEN z > 0.5 THEN 3 ELSE 0 END) AS v2 FROM {_ORDERS})"""


def _calibration(spark, sf_dir):
    return sky(spark, sf_dir, "orders").select(
        "x", "y", "z", F.expr("(id % 10 + id % 3) / 70D").alias("v1"),
        F.expr("cast(20 + id % 12 + CASE WHEN z > 0.5D THEN 3 ELSE 0 END AS double)").alias("v2"))


_QUALITY = f"(SELECT pix_ring, avg(v1) AS mean1, avg(v2) AS mean2, count(*)::bigint AS n FROM {duck.ring_sql(_CALIBRATION, 3)} GROUP BY pix_ring)"
_GOOD = f"(SELECT * FROM {_QUALITY} WHERE mean1 < 0.0785 AND mean2 > 25 AND n > 15)"


@query("a02_cell_quality", f"SELECT pix_ring, {r_sql('mean1')} AS mean1, {r_sql('mean2')} AS mean2, n FROM {_QUALITY}")
def cell_quality(spark, sf_dir):
    found = density.cell_quality(_calibration(spark, sf_dir), 3)
    return found.select("pix_ring", rounded("mean1").alias("mean1"), rounded("mean2").alias("mean2"), "n")


@query("f05_good_cells", f"SELECT pix_ring, n FROM {_GOOD}")
def good_cells(spark, sf_dir):
    return density.good_cells(density.cell_quality(_calibration(spark, sf_dir), 3), 0.0785).select("pix_ring", "n")


_LABELLED = f"""(SELECT *, rank // greatest(size // 32, 1) AS region FROM (
    SELECT *, row_number() OVER (ORDER BY pix_ring) - 1 AS rank, count(*) OVER () AS size FROM {_GOOD}))"""


@query("w01_rank_labels", f"SELECT pix_ring, region::bigint AS region FROM {_LABELLED}")
def rank_labels(spark, sf_dir):
    return make_mask(_calibration(spark, sf_dir), 3, 0.0785).select("pix_ring", "region")


_RING3 = f"(SELECT pix_nest, pix_ring AS of_nest FROM {duck.ring_of_nest_sql('(SELECT unnest(range(0, 768)) AS pix_nest)', 3)})"


@query("s06_write_mask", f"""SELECT pix_ring, {r_sql('360 - degrees(cphi)')} AS ra, {r_sql('90 - degrees(atan2(csth, cz))')} AS dec, {r_sql('mean1')} AS mean1,
    {r_sql('mean2')} AS mean2, n, region::bigint AS region FROM {duck.centre_sql(f'(SELECT * FROM {_LABELLED} JOIN {_RING3} ON pix_ring = of_nest)', 3)}""")
def write_mask(spark, sf_dir):
    path = scratch_folder(spark, "mask")
    mask_files.write_mask(make_mask(_calibration(spark, sf_dir), 3, 0.0785), 3, path, single_file=True)
    rows = spark.read.schema("pix_ring bigint, ra double, dec double, mean1 double, mean2 double, n bigint, region bigint").csv(path)
    return rows.select("pix_ring", *[rounded(c).alias(c) for c in ("ra", "dec", "mean1", "mean2")], "n", "region")


@query("a03_total_weight", f"SELECT count(*)::bigint AS n, sum(weight)::double AS total_weight FROM {_ORDERS}")
def total_weight(spark, sf_dir):
    return density.total_weight(sky(spark, sf_dir, "orders"))


# --- masks ------------------------------------------------------------------------------------------

# Cells that hold an order in a band of declination, plus every cell whose id is a multiple of 17.
_BAND = f"(SELECT DISTINCT pix_nest FROM {duck.nest_sql(_ORDERS, 4)} WHERE z > 0 AND z < 0.65 OR pix_nest % 17 = 0)"


def _band(spark, sf_dir):
    cells = with_nest(sky(spark, sf_dir, "orders"), 4)
    return cells.where("z > 0 AND z < 0.65 OR pix_nest % 17 = 0").select("pix_nest").distinct()


def _mask_lines(spark, sf_dir, name, order):
    cells = with_nest(sky(spark, sf_dir, name), order, "pix")
    return cells.select(F.expr("CASE WHEN id % 53 = 0 THEN 'pix,ra,dec' ELSE concat(cast(pix AS string), ',', cast(ra AS string)) END").alias("value"))


@query("s04_read_mask_finer", f"SELECT DISTINCT pix_nest >> 6 AS pix_nest FROM {duck.nest_sql(_ORDERS, 9)} WHERE id % 53 <> 0")
def read_mask_finer(spark, sf_dir):
    return mask_files.parse_mask(_mask_lines(spark, sf_dir, "orders", 9), 9, 6)


@query("s04_read_mask_coarser", f"SELECT DISTINCT pix_nest * 16 + unnest(range(0, 16)) AS pix_nest FROM {duck.nest_sql(_CUSTOMER, 4)} WHERE id % 53 <> 0")
def read_mask_coarser(spark, sf_dir):
    return mask_files.parse_mask(_mask_lines(spark, sf_dir, "customer", 4), 4, 6)


@query("s04_read_mask_ring", f"SELECT DISTINCT pix_nest >> 2 AS pix_nest FROM {duck.nest_sql(_ORDERS, 6)}")
def read_mask_ring(spark, sf_dir):
    cells = nest_to_ring(with_nest(sky(spark, sf_dir, "orders"), 6), 6)
    return mask_files.parse_mask(cells.select(F.col("pix_ring").cast("string").alias("value")), 6, 5, "ring")


_IN_BAND = f"SELECT id FROM {duck.nest_sql(_CUSTOMER, 4)} WHERE pix_nest {{}} (SELECT pix_nest FROM {_BAND})"


@query("f01_points_in_mask", _IN_BAND.format("IN"))
def points_in_mask(spark, sf_dir):
    return masks.filter_points(sky(spark, sf_dir, "customer"), _band(spark, sf_dir), 4).select("id")


@query("f01_points_outside_mask", _IN_BAND.format("NOT IN"))
def points_outside_mask(spark, sf_dir):
    return masks.filter_points(sky(spark, sf_dir, "customer"), _band(spark, sf_dir), 4, exclude=True).select("id")


_CELL_SUMS = f"(SELECT pix_ring, any_value(pix_nest) AS pix_nest, sum(weight)::double AS weight FROM {duck.ring_sql(duck.nest_sql(_CUSTOMER, 4), 4)} GROUP BY pix_ring)"


@query("f02_cells_in_mask", f"SELECT pix_ring, weight FROM {_CELL_SUMS} WHERE pix_nest IN (SELECT pix_nest FROM {_BAND})")
def cells_in_mask(spark, sf_dir):
    return masks.filter_cells(density.density_map(sky(spark, sf_dir, "customer"), 4), _band(spark, sf_dir), 4)


@query("f02_cells_outside_mask", f"SELECT pix_ring, weight FROM {_CELL_SUMS} WHERE pix_nest NOT IN (SELECT pix_nest FROM {_BAND})")
def cells_outside_mask(spark, sf_dir):
    return masks.filter_cells(density.density_map(sky(spark, sf_dir, "customer"), 4), _band(spark, sf_dir), 4, exclude=True)


@query("f03_cells_joined_to_mask", f"SELECT pix_ring, weight FROM {_CELL_SUMS} WHERE pix_nest IN (SELECT pix_nest FROM {_BAND})")
def cells_joined_to_mask(spark, sf_dir):
    ring_mask = nest_to_ring(_band(spark, sf_dir), 4).select("pix_ring")
    return masks.join_cells(density.density_map(sky(spark, sf_dir, "customer"), 4), ring_mask)


@query("a05_coverage_of_parents", f"SELECT pix_nest >> 6 AS parent, count(*)::bigint AS n FROM {_BAND} GROUP BY 1")
def coverage_of_parents(spark, sf_dir):
    return masks.coverage(_band(spark, sf_dir), 4, 1)


_CONFIDENT = f"(SELECT pix_nest, pix_nest >> 6 AS parent FROM {_BAND} WHERE (pix_nest >> 6) IN (SELECT pix_nest >> 6 FROM {_BAND} GROUP BY 1 HAVING count(*) > 0.5 * 64))"


@query("f06_confident_cells", f"SELECT pix_nest, parent FROM {_CONFIDENT}")
def confident_cells(spark, sf_dir):
    return masks.confident_cells(_band(spark, sf_dir), 4, 1, 0.5)


_PARENT_REGIONS = f"(SELECT pix_nest, (dense_rank() OVER (ORDER BY parent) - 1)::integer AS region FROM {_CONFIDENT})"


def _parent_regions(spark, sf_dir):
    return masks.parent_regions(masks.confident_cells(_band(spark, sf_dir), 4, 1, 0.5), 1)


@query("w04_parent_regions", f"SELECT pix_nest, region FROM {_PARENT_REGIONS}")
def parent_regions(spark, sf_dir):
    return _parent_regions(spark, sf_dir)


@query("s07_region_map", f"SELECT {r_sql('360 - degrees(cphi)')} AS ra, {r_sql('90 - degrees(atan2(csth, cz))')} AS dec, region + 1 AS region FROM {duck.centre_sql(_PARENT_REGIONS, 4)}")
def region_map(spark, sf_dir):
    path = scratch_folder(spark, "regions")
    mask_files.write_region_map(_parent_regions(spark, sf_dir), 4, path)
    rows = spark.read.schema("ra double, dec double, region int").csv(path)
    return rows.select(rounded("ra").alias("ra"), rounded("dec").alias("dec"), "region")


@query("w03_contiguous_regions", f"""SELECT pix_nest, (((rank + 1) * 12 - 1) // size)::integer AS region FROM (
    SELECT pix_nest, row_number() OVER (ORDER BY pix_nest) - 1 AS rank, count(*) OVER () AS size FROM {_BAND})""")
def contiguous(spark, sf_dir):
    return contiguous_regions(_band(spark, sf_dir), 4, 12)


@query("w02_tiled_regions", f"""SELECT pix_nest, stripe::integer AS stripe, (((place + 1) * 4 - 1) // size)::integer AS piece FROM (
    SELECT *, row_number() OVER (PARTITION BY stripe ORDER BY round(theta, 9), rank) - 1 AS place, count(*) OVER (PARTITION BY stripe) AS size FROM (
    SELECT *, ((rank + 1) * 4 - 1) // total AS stripe FROM (
    SELECT pix_nest, atan2(csth, cz) AS theta, row_number() OVER (ORDER BY round(cphi, 9), pix_nest) - 1 AS rank, count(*) OVER () AS total FROM {duck.centre_sql(_BAND, 4)})))""")
def tiled(spark, sf_dir):
    return tiled_regions(_band(spark, sf_dir), 4, 16).select("pix_nest", "stripe", "piece")


@query("o01_global_rank", f"SELECT pix_nest, row_number() OVER (ORDER BY pix_nest) - 1 AS rank FROM (SELECT DISTINCT pix_nest FROM {duck.nest_sql(_ORDERS, 10)})")
def rank_of_cells(spark, sf_dir):
    return global_rank(with_nest(sky(spark, sf_dir, "orders"), 10).select("pix_nest").distinct(), "pix_nest", 24)


@query("o01_sorted_cells", f"SELECT DISTINCT pix_nest FROM {duck.nest_sql(_ORDERS, 10)} ORDER BY pix_nest")
def sorted_cells(spark, sf_dir):
    return with_nest(sky(spark, sf_dir, "orders"), 10).select("pix_nest").distinct().orderBy("pix_nest")


@query("a04_mask_factor", f"SELECT count(*)::bigint AS n_cells, {r_sql('3072::double / count(*)')} AS mask_factor FROM {_BAND}")
def mask_factor(spark, sf_dir):
    found = masks.mask_summary(_band(spark, sf_dir), 4)
    return found.select("n_cells", rounded("mask_factor").alias("mask_factor"))


# --- pair counts ------------------------------------------------------------------------------------

_BINS = make_bins(10, 1.0, 15.0, "sqrt")


def _bin_sql(d2: str, bins, upper_closed: bool = False) -> str:
    op = ">" if upper_closed else ">="
    steps = " ".join(f"WHEN {d2} {op} {bins.edges2[i]!r}::double THEN {i}" for i in range(bins.count - 1, -1, -1))
    end = f"{d2} > {bins.edges2[-1]!r}::double" if upper_closed else f"{d2} >= {bins.edges2[-1]!r}::double"
    return f"(CASE WHEN {end} THEN NULL {steps} END)"


def _histogram_sql(left: str, right: str, bins, upper_closed: bool = False) -> str:
    return f"""SELECT k AS bin, coalesce(weighted, 0)::double AS weighted, coalesce(pairs, 0)::bigint AS pairs FROM (SELECT unnest(range(0, {bins.count}))::integer AS k) LEFT JOIN (
        SELECT {_bin_sql('d2', bins, upper_closed)} AS bin, sum(w) AS weighted, sum(c) AS pairs FROM (
          SELECT (a.x-b.x)^2 + (a.y-b.y)^2 + (a.z-b.z)^2 AS d2, a.weight * b.weight AS w, 1 AS c FROM {left} a, {right} b) GROUP BY 1) ON k = bin"""


@query("a06_pair_histogram_auto", _histogram_sql(_CUSTOMER, _CUSTOMER, _BINS))
def pair_histogram_auto(spark, sf_dir):
    return paircount.auto_histogram(sky(spark, sf_dir, "customer"), _BINS)


@query("a06_pair_histogram_cross", _histogram_sql(_CUSTOMER, _PART, _BINS))
def pair_histogram_cross(spark, sf_dir):
    return paircount.cross_histogram(sky(spark, sf_dir, "customer"), sky(spark, sf_dir, "part"), _BINS)


_FROM_ZERO = make_bins(4, 0.0, 8.0, "linear")
_DOUBLED = f"(SELECT s.* FROM {_CUSTOMER} s, (SELECT unnest([0, 1])))"


@query("a06_pair_histogram_from_zero", _histogram_sql(_DOUBLED, _DOUBLED, _FROM_ZERO))
def pair_histogram_from_zero(spark, sf_dir):
    """First edge zero on a table with every row twice: copies and self pairs count."""
    rows = sky(spark, sf_dir, "customer").withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    return paircount.auto_histogram(rows, _FROM_ZERO)


@query("a06_pair_histogram_split", _histogram_sql(_CUSTOMER, _CUSTOMER, _BINS))
def pair_histogram_split(spark, sf_dir):
    """The same counts with every cube of more than seven points treated as hot."""
    return paircount.auto_histogram(sky(spark, sf_dir, "customer"), _BINS, hot_rows=7)


_COUNTS = _histogram_sql(_CUSTOMER, _PART, _BINS)


@query("a08_pair_counts", f"SELECT bin, pairs FROM ({_COUNTS})")
def pair_counts(spark, sf_dir):
    return paircount.cross_histogram(sky(spark, sf_dir, "customer"), sky(spark, sf_dir, "part"), _BINS).select("bin", "pairs")


def _cells_at_centres_sql(source: str, order: int) -> str:
    grouped = f"(SELECT pix_nest, sum(weight)::double AS weight FROM {duck.nest_sql(source, order)} GROUP BY pix_nest)"
    return f"(SELECT weight, cx AS x, cy AS y, cz AS z FROM {duck.centre_sql(grouped, order)})"


# Edges away from the few distances that cell centres can have.
_CELL_BINS = make_bins(7, 2.137, 14.731, "sqrt")


@query("a07_cell_histogram", f"SELECT bin, weighted FROM ({_histogram_sql(_cells_at_centres_sql(_CUSTOMER, 4), _cells_at_centres_sql(_PART, 4), _CELL_BINS, True)})")
def cell_histogram(spark, sf_dir):
    left, right = (density.density_map(sky(spark, sf_dir, name), 4) for name in ("customer", "part"))
    return paircount.cell_histogram(left, right, 4, _CELL_BINS).select("bin", "weighted")


@query("a06_pyramid_auto", _histogram_sql(_CUSTOMER, _CUSTOMER, _BINS))
def pyramid_histogram_auto(spark, sf_dir):
    """The counts of a06_pair_histogram_auto by the count pyramid."""
    return pyramid.pyramid_auto(sky(spark, sf_dir, "customer"), _BINS)


@query("a06_pyramid_from_zero", _histogram_sql(_DOUBLED, _DOUBLED, _FROM_ZERO))
def pyramid_histogram_from_zero(spark, sf_dir):
    rows = sky(spark, sf_dir, "customer").withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    return pyramid.pyramid_auto(rows, _FROM_ZERO)


@query("a08_pyramid_counts", f"SELECT bin, pairs FROM ({_COUNTS})")
def pyramid_counts(spark, sf_dir):
    return pyramid.pyramid_cross(sky(spark, sf_dir, "customer"), sky(spark, sf_dir, "part"), _BINS).select("bin", "pairs")


@query("a06_pyramid_account", f"SELECT sum(n * n)::bigint AS pairs FROM (SELECT count(*) AS n FROM {_CUSTOMER})")
def pyramid_account(spark, sf_dir):
    """Pairs counted by nodes, dismissed by nodes and met as points are all pairs."""
    found = pyramid.pyramid_sums(paircount.as_points(sky(spark, sf_dir, "customer")), _BINS, kinds=("dd",))
    return found.account.agg(F.sum("pairs").alias("pairs"))


@query("a07_cell_histogram_ranges", f"SELECT bin, weighted, pairs FROM ({_histogram_sql(_cells_at_centres_sql(_CUSTOMER, 4), _cells_at_centres_sql(_PART, 4), _CELL_BINS, True)})")
def cell_histogram_ranges(spark, sf_dir):
    """The sums of a07_cell_histogram by ranges of ring numbers and running totals."""
    left, right = (density.density_map(sky(spark, sf_dir, name), 4) for name in ("customer", "part"))
    return rings.cell_histogram_by_ranges(left, right, 4, _CELL_BINS)


@query("j05_cell_pairs", f"""SELECT {_bin_sql('d2', _CELL_BINS, True)} AS bin, count(*)::bigint AS cell_pairs FROM (SELECT (a.x-b.x)^2 + (a.y-b.y)^2 + (a.z-b.z)^2 AS d2
    FROM {_cells_at_centres_sql(_CUSTOMER, 3)} a, {_cells_at_centres_sql(_PART, 3)} b) GROUP BY 1 HAVING bin IS NOT NULL""")
def cell_pairs(spark, sf_dir):
    left, right = (paircount.cells_as_points(density.density_map(sky(spark, sf_dir, name), 3), 3) for name in ("customer", "part"))
    found = paircount.cross_histogram(left, right, _CELL_BINS, upper_closed=True)
    return found.where("pairs > 0").select("bin", F.col("pairs").alias("cell_pairs"))


# --- correlation ------------------------------------------------------------------------------------

_XI_BINS = make_bins(6, 5.0, 15.0, "sqrt")
# Regions of the whole sky: the order-1 cells, numbered by id.
_REGIONED = lambda text: f"(SELECT x, y, z, weight, (pix_nest)::integer AS region FROM {duck.nest_sql(text, 0)})"
_ALL_POINTS = f"(SELECT *, 0 AS is_random FROM {_REGIONED(_CUSTOMER)} UNION ALL SELECT *, 1 AS is_random FROM {_REGIONED(_PART)})"


def _regioned(spark, sf_dir):
    points = None
    for is_random, name in enumerate(("customer", "part")):
        rows = with_nest(sky(spark, sf_dir, name), 0, "region", vector=("x", "y", "z"))
        rows = paircount.as_points(rows, bool(is_random), F.col("region").cast("int"))
        points = rows if points is None else points.unionByName(rows)
    return points


_SUMS = f"""(SELECT kind, bin, r1, r2, sum(w) AS weighted FROM (
    SELECT CASE WHEN a.is_random = 0 AND b.is_random = 0 THEN 'dd' WHEN a.is_random = 1 THEN 'rr' ELSE 'dr' END AS kind,
      {_bin_sql('(a.x-b.x)^2 + (a.y-b.y)^2 + (a.z-b.z)^2', _XI_BINS)} AS bin, a.region AS r1, b.region AS r2, a.weight * b.weight AS w
    FROM points a, points b WHERE a.is_random <= b.is_random) WHERE bin IS NOT NULL GROUP BY ALL)"""
_WITH = f"WITH points AS MATERIALIZED {_ALL_POINTS}, sums AS MATERIALIZED {_SUMS}"


@query("j04_dd_dr_rr", f"{_WITH} SELECT kind, bin, least(r1, r2) AS region_1, greatest(r1, r2) AS region_2, sum(weighted)::double AS weighted FROM sums GROUP BY ALL")
def dd_dr_rr(spark, sf_dir):
    return paircount.pair_sums(_regioned(spark, sf_dir), _XI_BINS).drop("pairs")


@query("j04_pyramid_sums", f"{_WITH} SELECT kind, bin, least(r1, r2) AS region_1, greatest(r1, r2) AS region_2, sum(weighted)::double AS weighted FROM sums GROUP BY ALL")
def dd_dr_rr_by_pyramid(spark, sf_dir):
    return pyramid.pyramid_sums(_regioned(spark, sf_dir), _XI_BINS).sums.drop("pairs")


_REALISED = f"""{_WITH}, taken AS (SELECT unnest(range(0, 13))::integer AS k), left_out AS (SELECT CASE WHEN k < 12 THEN k END AS region FROM taken),
    bins AS (SELECT unnest(range(0, {_XI_BINS.count}))::integer AS bin),
    norms AS (SELECT l.region, sum(weight) FILTER (WHERE is_random = 1) / sum(weight) FILTER (WHERE is_random = 0) AS norm
        FROM left_out l JOIN points p ON l.region IS NULL OR l.region <> p.region GROUP BY l.region),
    kinds AS (SELECT l.region, s.bin, sum(weighted) FILTER (WHERE kind = 'dd') AS dd, sum(weighted) FILTER (WHERE kind = 'dr') AS dr, sum(weighted) FILTER (WHERE kind = 'rr') AS rr
        FROM left_out l JOIN sums s ON l.region IS NULL OR (l.region <> s.r1 AND l.region <> s.r2) GROUP BY l.region, s.bin),
    reals AS (SELECT n.region, b.bin, coalesce(dd, 0)::double AS dd, coalesce(dr, 0)::double AS dr, coalesce(rr, 0)::double AS rr, norm,
        CASE WHEN coalesce(rr, 0) <> 0 THEN (norm * norm * coalesce(dd, 0) - 2 * norm * coalesce(dr, 0) + rr) / rr END AS xi
        FROM norms n CROSS JOIN bins b LEFT JOIN kinds k ON k.bin = b.bin AND k.region IS NOT DISTINCT FROM n.region)"""


def _realised(spark, sf_dir, bins=_XI_BINS, by_pyramid=False):
    points = _regioned(spark, sf_dir)
    sums = pyramid.pyramid_sums(points, bins).sums if by_pyramid else paircount.pair_sums(points, bins)
    weights = points.groupBy("is_random", "region").agg(F.sum("weight").alias("weight"))
    listed = spark.range(12).select(F.col("id").cast("int").alias("region"))
    return correlation.realisations(sums, weights, listed, bins)


@query("a09_correlation_estimate", f"{_REALISED} SELECT bin, dd, dr, rr, {r_sql('norm')} AS norm, {r_sql('xi')} AS xi FROM reals WHERE region IS NULL")
def correlation_estimate(spark, sf_dir):
    reals = _realised(spark, sf_dir).where("region IS NULL")
    return reals.select("bin", "dd", "dr", "rr", rounded("norm").alias("norm"), rounded("xi").alias("xi"))


@query("a09_estimate_without_pairs", f"""SELECT k AS bin, CASE WHEN n > 0 THEN 1 ELSE 0 END AS defined FROM (SELECT k::integer AS k, (SELECT count(*) FROM {_PART} a, {_PART} b
    WHERE (a.x-b.x)^2 + (a.y-b.y)^2 + (a.z-b.z)^2 >= e.lo AND (a.x-b.x)^2 + (a.y-b.y)^2 + (a.z-b.z)^2 < e.hi) AS n FROM (
    VALUES {', '.join(f'({i}, {lo!r}::double, {hi!r}::double)' for i, (lo, hi) in enumerate(zip(make_bins(3, 0.001, 4.0, 'log10').edges2, make_bins(3, 0.001, 4.0, 'log10').edges2[1:])))}) e(k, lo, hi))""")
def estimate_without_pairs(spark, sf_dir):
    """Bins in which the random catalogue has no pair give NULL, not an error."""
    reals = _realised(spark, sf_dir, make_bins(3, 0.001, 4.0, "log10")).where("region IS NULL")
    return reals.select("bin", F.when(F.col("xi").isNull(), 0).otherwise(1).alias("defined"))


@query("a10_jackknife_realisations", f"{_REALISED} SELECT region, bin, dd, dr, rr, {r_sql('norm')} AS norm, {r_sql('xi')} AS xi FROM reals WHERE region IS NOT NULL")
def jackknife_realisations(spark, sf_dir):
    reals = _realised(spark, sf_dir).where("region IS NOT NULL")
    return reals.select("region", "bin", "dd", "dr", "rr", rounded("norm").alias("norm"), rounded("xi").alias("xi"))


@query("a10_jackknife_by_pyramid", f"{_REALISED} SELECT region, bin, dd, dr, rr, {r_sql('norm')} AS norm, {r_sql('xi')} AS xi FROM reals WHERE region IS NOT NULL")
def jackknife_by_pyramid(spark, sf_dir):
    reals = _realised(spark, sf_dir, by_pyramid=True).where("region IS NOT NULL")
    return reals.select("region", "bin", "dd", "dr", "rr", rounded("norm").alias("norm"), rounded("xi").alias("xi"))


@query("a11_jackknife_mean", f"{_REALISED} SELECT bin, {r_sql('avg(xi)')} AS xi_jk_mean FROM reals WHERE region IS NOT NULL GROUP BY bin")
def jackknife_mean(spark, sf_dir):
    found = correlation.jackknife_mean(_realised(spark, sf_dir))
    return found.select("bin", rounded("xi_jk_mean").alias("xi_jk_mean"))


_COV = f"""{_REALISED}, devs AS (SELECT region, bin, xi - avg(xi) OVER (PARTITION BY bin) AS dev FROM reals WHERE region IS NOT NULL),
    cov AS (SELECT a.bin AS bin_i, b.bin AS bin_j, sum(a.dev * b.dev) * (count(*) - 1) / count(*) AS cov FROM devs a JOIN devs b USING (region) GROUP BY 1, 2)"""


@query("a12_covariance", f"{_COV} SELECT bin_i, bin_j, {r_sql('cov', 9)} AS cov FROM cov")
def covariance(spark, sf_dir):
    found = correlation.covariance(_realised(spark, sf_dir))
    return found.select("bin_i", "bin_j", rounded("cov", 9).alias("cov"))


@query("a13_correlation_matrix", f"""{_COV} SELECT c.bin_i, c.bin_j, {r_sql('c.cov / sqrt(i.cov * j.cov)')} AS corr FROM cov c
    JOIN cov i ON i.bin_i = c.bin_i AND i.bin_j = c.bin_i JOIN cov j ON j.bin_i = c.bin_j AND j.bin_j = c.bin_j""")
def correlation_matrix(spark, sf_dir):
    found = correlation.correlation_matrix(correlation.covariance(_realised(spark, sf_dir)))
    return found.select("bin_i", "bin_j", rounded("corr").alias("corr"))


@query("a14_error_bars", f"{_COV} SELECT bin_i AS bin, {r_sql('sqrt(cov)')} AS error FROM cov WHERE bin_i = bin_j")
def error_bars(spark, sf_dir):
    found = correlation.error_bars(correlation.covariance(_realised(spark, sf_dir)))
    return found.select("bin", rounded("error").alias("error"))


@query("a15_run_summary", f"SELECT sum(weight) FILTER (WHERE is_random = 0)::double AS dsize, sum(weight) FILTER (WHERE is_random = 1)::double AS rsize, 3 AS lowlevel, 7 AS highlevel, false AS usecells, 'sqrt' AS scale FROM {_ALL_POINTS}")
def summary(spark, sf_dir):
    weights = _regioned(spark, sf_dir).groupBy("is_random", "region").agg(F.sum("weight").alias("weight"))
    return run_summary(weights, CorrelationSettings(use_cells=False))


@query("s08_write_correlation", f"""{_COV} SELECT f.bin, {r_sql('f.xi')} AS xi_full, {r_sql('m.mean')} AS xi_jk_mean, {r_sql('sqrt(c.cov)')} AS error FROM (SELECT * FROM reals WHERE region IS NULL) f
    JOIN (SELECT bin, avg(xi) AS mean FROM reals WHERE region IS NOT NULL GROUP BY bin) m USING (bin) JOIN cov c ON c.bin_i = f.bin AND c.bin_j = f.bin""")
def written_correlation(spark, sf_dir):
    settings = CorrelationSettings(bins=6, min_radius=5.0, max_radius=15.0, use_cells=False, order=0)
    regions = spark.range(12).select(F.col("id").alias("pix_nest"), F.col("id").cast("int").alias("region"))
    tables = correlation_tables(sky(spark, sf_dir, "customer"), sky(spark, sf_dir, "part"), settings, regions)
    folder = scratch_folder(spark, "correlation")
    write_correlation(tables, folder)
    rows = spark.read.schema("bin int, xi_full double, xi_jk_mean double, error double").option("header", "true").csv(f"{folder}/estimate")
    return rows.select("bin", *[rounded(c).alias(c) for c in ("xi_full", "xi_jk_mean", "error")])


def _cell_xi_sql(order: int) -> str:
    """Cell-mode estimate of the masked catalogues."""
    cells = lambda text: f"""(SELECT weight, cx AS x, cy AS y, cz AS z FROM {duck.centre_sql(f'(SELECT pix_nest, sum(weight)::double AS weight FROM {duck.nest_sql(text, order)} GROUP BY pix_nest)', order)}
        WHERE pix_nest IN (SELECT pix_nest FROM {_CONFIDENT}))"""
    part = lambda kind, a, b: f"""SELECT '{kind}' AS kind, {_bin_sql('(a.x-b.x)^2 + (a.y-b.y)^2 + (a.z-b.z)^2', _CELL_BINS, True)} AS bin, sum(a.weight * b.weight) AS w FROM {a} a, {b} b GROUP BY 2"""
    return f"""WITH d AS MATERIALIZED {cells(_CUSTOMER)}, r AS MATERIALIZED {cells(_PART)}, kinds AS ({part('dd', 'd', 'd')} UNION ALL {part('dr', 'd', 'r')} UNION ALL {part('rr', 'r', 'r')}),
        n AS (SELECT (SELECT sum(weight) FROM r) / (SELECT sum(weight) FROM d) AS norm)
        SELECT k AS bin, {r_sql('(norm*norm*coalesce(dd, 0) - 2*norm*coalesce(dr, 0) + rr) / rr')} AS xi_full FROM (SELECT unnest(range(0, {_CELL_BINS.count}))::integer AS k), n
        LEFT JOIN (SELECT bin, sum(w) FILTER (WHERE kind = 'dd') AS dd, sum(w) FILTER (WHERE kind = 'dr') AS dr, sum(w) FILTER (WHERE kind = 'rr') AS rr FROM kinds GROUP BY bin) ON bin = k"""


@query("correlate_cells_in_mask", _cell_xi_sql(4))
def correlate_cells(spark, sf_dir):
    """The whole default workload: mask, regions, density maps, pair sums, estimate."""
    settings = CorrelationSettings(bins=7, min_radius=2.137, max_radius=14.731, order=4, mask_coarse_order=1)
    tables = correlation_tables(sky(spark, sf_dir, "customer"), sky(spark, sf_dir, "part"), settings, _parent_regions(spark, sf_dir))
    return tables["estimate"].select("bin", rounded("xi_full").alias("xi_full"))

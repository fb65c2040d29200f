"""Pixel maps and random comparison catalogues."""

from __future__ import annotations

from pyspark.sql import functions as F

from skylattice.functions.cells import npix, with_nest, with_ring
from skylattice.operators import maps
from skylattice.sources import randoms
from skyqueries import duck
from skyqueries.fixtures import r_sql, rounded, sky, sky_sql
from skyqueries.registry import query

_ORDERS, _CUSTOMER = sky_sql("orders"), sky_sql("customer")

# Three maps of mean weight at order 6; one value in eleven is the undefined marker.
_RAW = f"(SELECT id % 3 AS map_id, pix_nest AS pix, avg(weight + id % 13) AS value, min(id) AS first FROM {duck.nest_sql(_ORDERS, 6)} GROUP BY 1, 2)"
_MAP = f"(SELECT map_id, pix, CASE WHEN first % 11 <> 0 THEN value END AS value FROM {_RAW})"


def _map(spark, sf_dir, scheme="nest"):
    tagged = (with_nest if scheme == "nest" else with_ring)(sky(spark, sf_dir, "orders"), 6, "pix")
    raw = tagged.groupBy(F.expr("id % 3").alias("map_id"), "pix").agg(F.avg(F.expr("weight + id % 13")).alias("value"), F.min("id").alias("first"))
    marked = raw.select("map_id", "pix", F.expr("CASE WHEN first % 11 = 0 THEN -1.63750001e30D ELSE value END").alias("value"))
    return marked.withColumn("value", maps.defined(F.col("value")))


def _shown(found):
    return found.select("map_id", "pix", rounded("value").alias("value"))


_SHOW = f"SELECT map_id, pix, {r_sql('value')} AS value FROM"


@query("g06_undefined_values", f"{_SHOW} {_MAP}")
def undefined_values(spark, sf_dir):
    return _shown(_map(spark, sf_dir))


@query("g01_nest_to_ring", f"SELECT map_id, pix_ring AS pix, {r_sql('value')} AS value FROM {duck.ring_of_nest_sql(f'(SELECT map_id, pix AS pix_nest, value FROM {_MAP})', 6)}")
def nest_to_ring(spark, sf_dir):
    return _shown(maps.to_ring(_map(spark, sf_dir), 6))


@query("g01_ring_to_nest", f"{_SHOW} {_MAP}")
def ring_to_nest(spark, sf_dir):
    return _shown(maps.to_nest(_map(spark, sf_dir, "ring"), 6))


@query("g02_upgrade", f"{_SHOW} (SELECT map_id, pix * 16 + unnest(range(0, 16)) AS pix, value FROM {_MAP})")
def upgrade(spark, sf_dir):
    return _shown(maps.upgrade(_map(spark, sf_dir), 6, 8))


_COARSE = f"(SELECT map_id, pix >> 4 AS pix, avg(value) AS value, count(value) AS n FROM {_MAP} GROUP BY 1, 2)"


@query("g03_degrade", f"{_SHOW} {_COARSE}")
def degrade(spark, sf_dir):
    return _shown(maps.degrade(_map(spark, sf_dir), 6, 4))


@query("g03_degrade_pessimistic", f"SELECT map_id, pix, CASE WHEN n = 4 THEN {r_sql('value')} END AS value FROM (SELECT map_id, pix >> 2 AS pix, avg(value) AS value, count(value) AS n FROM {_MAP} GROUP BY 1, 2)")
def degrade_pessimistic(spark, sf_dir):
    return _shown(maps.degrade(_map(spark, sf_dir), 6, 5, pessimistic=True))


@query("g04_regrid", f"SELECT map_id, pix_ring AS pix, {r_sql('value')} AS value FROM {duck.ring_of_nest_sql(f'(SELECT map_id, pix AS pix_nest, value FROM {_COARSE})', 4)}")
def regrid(spark, sf_dir):
    return _shown(maps.regrid(_map(spark, sf_dir, "ring"), 6, 4, "ring", "ring"))


@query("g05_full_map", f"SELECT map_id, pix, {r_sql('any_value(value)')} AS value FROM (SELECT map_id, pix, value FROM {_MAP} UNION ALL SELECT k, unnest(range(0, {npix(6)})), NULL FROM (SELECT unnest([0, 1, 2]) AS k)) GROUP BY map_id, pix")
def full_map(spark, sf_dir):
    return _shown(maps.full(_map(spark, sf_dir), 6))


@query("g05_fill", f"SELECT map_id, pix, 1.5::double AS value FROM (SELECT DISTINCT id % 3 AS map_id FROM {_ORDERS}), (SELECT unnest(range(0, {npix(5)})) AS pix)")
def fill(spark, sf_dir):
    return maps.filled(sky(spark, sf_dir, "orders").select(F.expr("id % 3").alias("map_id")).distinct(), 5, 1.5)


_CHANGES = f"(SELECT id % 3 AS map_id, pix_nest AS pix, max(id)::double AS value FROM {duck.nest_sql(_CUSTOMER, 6)} GROUP BY 1, 2)"


def _changes(spark, sf_dir):
    cells = with_nest(sky(spark, sf_dir, "customer"), 6, "pix")
    return cells.groupBy(F.expr("id % 3").alias("map_id"), "pix").agg(F.max("id").cast("double").alias("value"))


@query("g05_set_pixels", f"SELECT map_id, pix, {r_sql('CASE WHEN c.pix IS NOT NULL THEN c.value ELSE m.value END')} AS value FROM {_MAP} m FULL JOIN {_CHANGES} c USING (map_id, pix)")
def set_pixels(spark, sf_dir):
    return _shown(maps.set_pixels(_map(spark, sf_dir), _changes(spark, sf_dir)))


@query("g05_get_pixels", f"SELECT map_id, pix, {r_sql('m.value')} AS value FROM {_CHANGES} c LEFT JOIN {_MAP} m USING (map_id, pix)")
def get_pixels(spark, sf_dir):
    return _shown(maps.get_pixels(_map(spark, sf_dir), _changes(spark, sf_dir).select("map_id", "pix")))


_VALUES = f"(SELECT id AS map_id, k AS pix, CASE WHEN (id + k) % 9 <> 0 THEN (id + k)::double END AS value FROM {_CUSTOMER}, (SELECT unnest(range(0, 48)) AS k))"


@query("g05_map_from_array", f'SELECT map_id, 1 AS "order", pix, {r_sql("value")} AS value FROM {_VALUES}')
def map_from_array(spark, sf_dir):
    arrays = sky(spark, sf_dir, "customer").select(F.col("id").alias("map_id"), F.expr(
        "transform(sequence(0, 47), k -> CASE WHEN (id + k) % 9 = 0 THEN -1.6375e30D ELSE cast(id + k AS double) END)").alias("values"))
    return maps.from_array(arrays).select("map_id", "order", "pix", rounded("value").alias("value"))


# --- random catalogues: the numbers are the generator's own, so properties are compared ----------------------


def _ids(spark, sf_dir, copies=10):
    """`copies` random rows per customer."""
    rows = sky(spark, sf_dir, "customer").select("id")
    rows = rows.select("id", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"))
    return rows.select((F.col("id") * copies + F.col("copy")).alias("id"))


_EVEN = "SELECT 10 * count(*)::bigint AS n, 10 * count(*)::bigint AS n_inside, true AS even FROM customer"


def _even(column, low, high):
    """Each half of an even spread holds half the rows, within six standard deviations."""
    middle = F.lit((low + high) / 2.0)
    return F.abs(F.count_if(column < middle) - F.count("*") / 2.0) < 3.0 * F.sqrt(F.count("*"))


@query("s11_random_sphere", _EVEN)
def random_sphere(spark, sf_dir):
    rows = randoms.random_sphere(_ids(spark, sf_dir), seed=5)
    near_pole = F.abs(F.count_if(F.abs("z") > 0.95) - 0.05 * F.count("*")) < 6.0 * F.sqrt(0.05 * F.count("*"))
    return rows.agg(
        F.count("*").alias("n"), F.count_if(F.expr("abs(x*x + y*y + z*z - 1) < 1e-9 AND abs(dec) <= 90 AND ra > 0 AND ra <= 360")).alias("n_inside"),
        (_even(F.col("z"), -1, 1) & _even(F.col("ra"), 0, 360) & near_pole).alias("even"))


@query("s12_random_box", _EVEN)
def random_box(spark, sf_dir):
    rows = randoms.random_box(_ids(spark, sf_dir), seed=6)
    low, high = 0.08715574274765817, 0.7071067811865476
    return rows.agg(
        F.count("*").alias("n"), F.count_if(F.expr("ra BETWEEN 140 AND 220 AND dec BETWEEN 4.999999 AND 45.000001")).alias("n_inside"),
        (_even(F.sin(F.radians("dec")), low, high) & _even(F.col("ra"), 140, 220)).alias("even"))


@query("s13_random_counts", f"SELECT count(DISTINCT pix_nest)::bigint AS n_cells, true AS mean_ok, true AS variance_ok, true AS large_ok FROM {duck.nest_sql(_ORDERS, 5)}")
def random_counts(spark, sf_dir):
    """Counts in the cells that hold an order: mean and variance of a Poisson law, for a small and a large mean."""
    cells = with_nest(sky(spark, sf_dir, "orders"), 5, "pix").select("pix").distinct()
    both = cells.select("pix", F.lit(0).alias("k")).unionByName(randoms.random_counts(cells, 2.5, 7).select("pix", F.lit(1).alias("k"), "weight"), allowMissingColumns=True)
    both = both.unionByName(randoms.random_counts(cells, 40.0, 8).select("pix", F.lit(2).alias("k"), "weight"), allowMissingColumns=True)
    per_cell = both.groupBy("pix").agg(*[F.coalesce(F.sum(F.when(F.col("k") == k, F.col("weight"))), F.lit(0.0)).alias(name) for k, name in ((1, "small"), (2, "large"))])
    n = F.count("*")
    close = lambda value, mean, spread: F.abs(value - mean) < 6.0 * spread / F.sqrt(n)
    return per_cell.agg(
        n.alias("n_cells"), close(F.avg("small"), 2.5, 2.5**0.5).alias("mean_ok"), close(F.var_pop("small"), 2.5, 3.9).alias("variance_ok"),
        (close(F.avg("large"), 40.0, 40.0**0.5) & close(F.var_pop("large"), 40.0, 57.0)).alias("large_ok"))


@query("s13_random_counts_of_total", f"""SELECT (SELECT count(*) * 1000 FROM orders)::bigint AS n_points, count(DISTINCT pix_nest >> 4)::bigint AS n_cells_hit
    FROM {duck.nest_sql(_ORDERS, 5)}""")
def random_counts_of_total(spark, sf_dir):
    """A thousand points for every order, in the cells that hold one: all of them, and coarse cells hit are those with a kept cell."""
    orders = sky(spark, sf_dir, "orders")
    cells = with_nest(orders, 5).select("pix_nest").distinct()
    counts = randoms.random_counts_of_total(spark, 5, 1000 * orders.count(), 9, cells)
    return counts.agg(F.sum("weight").cast("bigint").alias("n_points"), F.count_distinct(F.shiftright("pix", 4)).alias("n_cells_hit"))

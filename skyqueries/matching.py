"""Catalogue text, within-radius joins and the nearest-match join."""

from __future__ import annotations

import math

from pyspark.sql import Window, functions as F

from skylattice.functions.angles import chord_of
from skylattice.functions.cells import with_nest
from skylattice.operators import match
from skylattice.operators.proximity import D2, candidate_sides, join_by_work, within_radius
from skylattice.plans.workloads import run_crossmatch
from skylattice.session import scratch_folder
from skylattice.sources import catalogs, results
from skyqueries import duck
from skyqueries.fixtures import r_sql, rounded, rounded_often, sky, sky_sql
from skyqueries.registry import query

_CUSTOMER, _PART, _ORDERS = sky_sql("customer"), sky_sql("part"), sky_sql("orders")

# Some lines are spoilt on purpose: a header, a short row, a word for a number, an impossible declination.
_SPOILT = "id % 97 = 0 OR id % 89 = 0 OR id % 83 = 0 OR id % 79 = 0"


def _lines(spark, sf_dir, name, fields):
    rows = sky(spark, sf_dir, name)
    parts = ", ".join(f"cast({field} AS string)" for field in fields)
    text = (f"CASE WHEN id % 97 = 0 THEN '{','.join(fields)}' WHEN id % 89 = 0 THEN cast(ra AS string)"
            f" WHEN id % 83 = 0 THEN replace(concat_ws(',', {parts}), cast(dec AS string), 'n/a')"
            f" WHEN id % 79 = 0 THEN replace(concat_ws(',', {parts}), cast(dec AS string), '95.5') ELSE concat_ws(',', {parts}) END")
    return rows.select(F.expr(text).alias("value"))


_PLACED = f"{r_sql('ra')} AS ra, {r_sql('dec')} AS dec, {r_sql('x')} AS x, {r_sql('y')} AS y, {r_sql('z')} AS z"


def _placed():
    return [rounded(c).alias(c) for c in ("ra", "dec", "x", "y", "z")]


@query("s01_read_catalog", f"SELECT id, weight, {_PLACED} FROM {_CUSTOMER} WHERE NOT ({_SPOILT})")
def read_catalog(spark, sf_dir):
    rows = catalogs.parse_catalog(_lines(spark, sf_dir, "customer", ["ra", "dec", "weight", "id"]), weight=2, id=3)
    return rows.select("id", "weight", *_placed())


@query("s01_read_catalog_file", f"SELECT (-1)::bigint AS id, 1::double AS weight, {_PLACED} FROM {_ORDERS} WHERE NOT ({_SPOILT})")
def read_catalog_file(spark, sf_dir):
    path = scratch_folder(spark, "catalog")
    _lines(spark, sf_dir, "orders", ["ra", "dec", "weight", "id"]).write.text(path)
    return catalogs.read_catalog(spark, path).select("id", "weight", *_placed())


@query("s01_rejected_lines", f"SELECT count(*)::bigint AS n_lines, count(*) FILTER (WHERE {_SPOILT})::bigint AS n_rejected FROM {_ORDERS}")
def rejected_lines(spark, sf_dir):
    return catalogs.rejected(_lines(spark, sf_dir, "orders", ["ra", "dec", "weight", "id"]), weight=2, id=3)


@query("s02_read_match_catalog", f"SELECT id, {_PLACED} FROM {_PART} WHERE NOT ({_SPOILT})")
def read_match_catalog(spark, sf_dir):
    return catalogs.parse_match_catalog(_lines(spark, sf_dir, "part", ["id", "ra", "dec"])).select("id", *_placed())


@query("s03_read_calibration", f"SELECT {r_sql('ra')} AS ra, {r_sql('dec')} AS dec, weight AS v1, id::double AS v2 FROM {_ORDERS} WHERE NOT ({_SPOILT})")
def read_calibration(spark, sf_dir):
    rows = catalogs.parse_calibration(_lines(spark, sf_dir, "orders", ["ra", "dec", "weight", "id"]))
    return rows.select(rounded("ra").alias("ra"), rounded("dec").alias("dec"), "v1", "v2")


_RADIUS = math.radians(3.0)
_PAIRS = f"""(SELECT a.id AS x_id, b.id AS y_id, (a.x-b.x)^2 + (a.y-b.y)^2 + (a.z-b.z)^2 AS d2 FROM {_CUSTOMER} a JOIN {_PART} b
    ON (a.x-b.x)^2 + (a.y-b.y)^2 + (a.z-b.z)^2 < {chord_of(_RADIUS) ** 2!r}::double)"""


@query("j01_within_radius", f"SELECT x_id, y_id, {r_sql('d2', 9)} AS d2 FROM {_PAIRS}")
def within(spark, sf_dir):
    x, y = (sky(spark, sf_dir, name).select("id", "x", "y", "z") for name in ("customer", "part"))
    pairs = within_radius(x, y, _RADIUS, walk=True, columns=["id"])
    return pairs.select(F.col("a_id").alias("x_id"), F.col("b_id").alias("y_id"), rounded_often("d2", 9).alias("d2"))


@query("j01_within_radius_split", f"SELECT x_id, y_id FROM {_PAIRS}")
def within_split(spark, sf_dir):
    """The same pairs with every cube of more than three rows treated as hot."""
    pairs = within_radius(sky(spark, sf_dir, "customer").select("id", "x", "y", "z"), sky(spark, sf_dir, "part").select("id", "x", "y", "z"), _RADIUS, hot_rows=3)
    return pairs.select(F.col("a_id").alias("x_id"), F.col("b_id").alias("y_id"))


_CELLED = lambda sky_text: f"(SELECT id, x, y, z, pix_nest FROM {duck.nest_sql(sky_text, 3)})"


@query("j02_within_radius_same_cell", f"""SELECT a.id AS x_id, b.id AS y_id FROM {_CELLED(_CUSTOMER)} a JOIN {_CELLED(_PART)} b USING (pix_nest)
    WHERE (a.x-b.x)^2 + (a.y-b.y)^2 + (a.z-b.z)^2 < {chord_of(_RADIUS) ** 2!r}::double""")
def within_same_cell(spark, sf_dir):
    pairs = within_radius(sky(spark, sf_dir, "customer").select("id", "x", "y", "z"), sky(spark, sf_dir, "part").select("id", "x", "y", "z"), _RADIUS, cell_order=3)
    return pairs.select(F.col("a_id").alias("x_id"), F.col("b_id").alias("y_id"))


def _matched_sql(pairs: str) -> str:
    return f"""(SELECT x_id, y_id, d2 FROM (SELECT *, row_number() OVER (PARTITION BY x_id ORDER BY d2, y_id) AS k2 FROM (
        SELECT *, row_number() OVER (PARTITION BY y_id ORDER BY d2, x_id) AS k1 FROM {pairs}) WHERE k1 = 1) WHERE k2 = 1)"""


_LIMIT = chord_of(_RADIUS)
_MATCH_COLUMNS = f"x_id, y_id, {r_sql('2 * degrees(asin(sqrt(d2) / 2)) * 3600', 4)} AS sep_arcsec, {r_sql(f'sqrt(d2) / {_LIMIT!r}')} AS sep_rel"


def _match_columns(matches):
    return matches.select("x_id", "y_id", rounded("sep_arcsec", 4).alias("sep_arcsec"), rounded("sep_rel").alias("sep_rel"))


def _degree_match(spark, sf_dir, **options):
    return match.crossmatch(sky(spark, sf_dir, "customer"), sky(spark, sf_dir, "part"), 3.0 * 3600, **options)


@query("j03_crossmatch", f"SELECT {_MATCH_COLUMNS} FROM {_matched_sql(_PAIRS)}")
def crossmatch(spark, sf_dir):
    return _match_columns(_degree_match(spark, sf_dir))


@query("j03_crossmatch_same_cell", f"SELECT x_id, y_id FROM " + _matched_sql(f"""(SELECT a.id AS x_id, b.id AS y_id, (a.x-b.x)^2 + (a.y-b.y)^2 + (a.z-b.z)^2 AS d2
    FROM {_CELLED(_CUSTOMER)} a JOIN {_CELLED(_PART)} b USING (pix_nest) WHERE (a.x-b.x)^2 + (a.y-b.y)^2 + (a.z-b.z)^2 < {chord_of(_RADIUS) ** 2!r}::double)"""))
def crossmatch_same_cell(spark, sf_dir):
    return _degree_match(spark, sf_dir, border=False, cell_order=3).select("x_id", "y_id")


# The same objects displaced by 0, 0.3, ... 1.8 arc seconds, and each one copied to a second id.
_SHIFTED = f"""(SELECT id + k * 1000000 AS id, sqrt(1-z*z) * cos(phi) AS x, sqrt(1-z*z) * sin(phi) AS y, z FROM (
    SELECT id, phi, sin(radians("dec" + (id % 7) * 0.3::double / 3600::double)) AS z FROM {_CUSTOMER}), (SELECT unnest([0, 1]) AS k))"""
_ARCSEC_PAIRS = f"""(SELECT a.id AS x_id, b.id AS y_id, (a.x-b.x)^2 + (a.y-b.y)^2 + (a.z-b.z)^2 AS d2 FROM {_CUSTOMER} a JOIN {_SHIFTED} b
    ON abs(a.z - b.z) < 0.00001 AND (a.x-b.x)^2 + (a.y-b.y)^2 + (a.z-b.z)^2 < {chord_of(math.radians(1 / 3600)) ** 2!r}::double)"""


def _shifted(spark, sf_dir):
    rows = sky(spark, sf_dir, "customer").select("id", "phi", F.expr("sin(radians(dec + (id % 7) * 0.3D / 3600D))").alias("z"))
    rows = rows.withColumn("id", F.explode(F.expr("array(id, id + 1000000)")))
    return rows.select("id", F.expr("sqrt(1-z*z) * cos(phi)").alias("x"), F.expr("sqrt(1-z*z) * sin(phi)").alias("y"), "z")


@query("j03_crossmatch_one_arcsecond", f"SELECT x_id, y_id, {r_sql(f'2 * degrees(asin(sqrt(d2) / 2)) * 3600', 4)} AS sep_arcsec FROM {_matched_sql(_ARCSEC_PAIRS)}")
def crossmatch_arcsecond(spark, sf_dir):
    found = match.crossmatch(sky(spark, sf_dir, "customer"), _shifted(spark, sf_dir))
    return found.select("x_id", "y_id", rounded("sep_arcsec", 4).alias("sep_arcsec"))


@query("a16_closest_per_x", f"SELECT x_id, y_id FROM (SELECT *, row_number() OVER (PARTITION BY x_id ORDER BY d2, y_id) AS k FROM {_PAIRS}) WHERE k = 1")
def closest_per_x(spark, sf_dir):
    x, y = (sky(spark, sf_dir, name).select("id", "x", "y", "z") for name in ("customer", "part"))
    found = match.nearest_within(x, match.distinct_positions(y), _RADIUS)
    return match.nearest_per(found, "a_id", "b_id", "d2").select(F.col("a_id").alias("x_id"), F.col("b_id").alias("y_id"))


@query("a17_distinct_cells", f"SELECT DISTINCT pix_nest FROM {duck.nest_sql(_ORDERS, 6)}")
def distinct_cells(spark, sf_dir):
    return match.distinct_cells(sky(spark, sf_dir, "orders"), 6)


@query("f07_rows_in_cells_of", f"SELECT id FROM {duck.nest_sql(_ORDERS, 6)} WHERE pix_nest IN (SELECT pix_nest FROM {duck.nest_sql(_CUSTOMER, 6)})")
def rows_in_cells_of(spark, sf_dir):
    return match.in_cells_of(sky(spark, sf_dir, "orders"), sky(spark, sf_dir, "customer"), 6).select("id")


_RADII = (1.0, 10.0, 60.0)


def _shifted_sql(radius: float) -> str:
    return f"(SELECT id, sqrt(1-z*z) * cos(phi) AS x, sqrt(1-z*z) * sin(phi) AS y, z FROM (SELECT id, phi, sin(radians(\"dec\" + (id % 7) * {0.3 * radius!r}::double / 3600)) AS z FROM {_CUSTOMER}))"


@query("f07_crossmatch_prefiltered", " UNION ALL ".join(f"SELECT {radius!r}::double AS radius, x_id, y_id FROM " + _matched_sql(
    f"""(SELECT a.id AS x_id, b.id AS y_id, (a.x-b.x)^2 + (a.y-b.y)^2 + (a.z-b.z)^2 AS d2 FROM {_CUSTOMER} a JOIN {_shifted_sql(radius)} b
    ON abs(a.z - b.z) < 0.001 AND (a.x-b.x)^2 + (a.y-b.y)^2 + (a.z-b.z)^2 < {chord_of(math.radians(radius / 3600)) ** 2!r}::double)""") for radius in _RADII))
def crossmatch_prefiltered(spark, sf_dir):
    """Through the workload: objects moved by 0, 0.3, ... 1.8 radii, with rows dropped first that are out of reach."""
    found = []
    for radius in _RADII:
        folder = scratch_folder(spark, "prefilter")
        x = sky(spark, sf_dir, "customer")
        y = x.withColumn("dec", F.expr(f"dec + (id % 7) * {0.3 * radius!r}D / 3600D"))
        for name, rows in (("x", x), ("y", y)):
            rows.select(F.concat_ws(",", "id", "ra", "dec")).write.text(f"{folder}/{name}")
        run_crossmatch(spark, f"{folder}/x", f"{folder}/y", f"{folder}/out", radius, prefilter_order=12)
        found.append(results.read_matches(spark, f"{folder}/out").select(F.lit(radius).alias("radius"), "x_id", "y_id"))
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("f07_prefilter_keeps_matches", f"SELECT x_id, y_id FROM {_matched_sql(_ARCSEC_PAIRS)}")
def prefilter_keeps_matches(spark, sf_dir):
    x, y = sky(spark, sf_dir, "customer"), _shifted(spark, sf_dir)
    return match.crossmatch(x, match.in_cells_of(y, x, 11, math.radians(1.0 / 3600.0))).select("x_id", "y_id")


@query("f04_home_cell_once", f"SELECT x_id AS id_1, y_id AS id_2, 1::bigint AS n FROM {_PAIRS}")
def home_cell_once(spark, sf_dir):
    """One side stays in its home cell and the other is copied to all cells it reaches: every close pair still meets once."""
    alone = (F.count("*").over(Window.partitionBy("id")) == 1).alias("alone")
    left, right = (sky(spark, sf_dir, name).select("id", "x", "y", "z", alone) for name in ("customer", "part"))
    a, b, keys = candidate_sides(left, right, _RADIUS, 2)
    pair = [F.col("a_id").alias("id_1"), F.col("b_id").alias("id_2")]
    meet = lambda a, b: join_by_work(a, b, keys).where(F.expr(D2) < F.lit(chord_of(_RADIUS) ** 2))
    # Rows whose id is theirs alone meet in one group, and are counted there without a shuffle of all pairs.
    once = meet(a.where("a_alone"), b.where("b_alone")).groupBy(*keys, *pair).agg(F.count("*").alias("n")).drop(*keys)
    others = meet(a.where("NOT a_alone"), b).unionByName(meet(a.where("a_alone"), b.where("NOT b_alone")))
    return once.unionByName(others.groupBy(*pair).agg(F.count("*").alias("n")))


@query("s05_write_matches", f"SELECT x_id, y_id, {r_sql(f'sqrt(d2) / {_LIMIT!r}')} AS sep_rel FROM {_matched_sql(_PAIRS)}")
def write_matches(spark, sf_dir):
    path = scratch_folder(spark, "matches")
    results.write_matches(_degree_match(spark, sf_dir), path)
    return results.read_matches(spark, path).select("x_id", "y_id", rounded("sep_rel").alias("sep_rel"))


_OTHER = f"(SELECT id AS x_id, id + id % 3 AS y_id FROM {_CUSTOMER})"


@query("j07_compare_matches", f"""SELECT (SELECT count(*) FROM {_matched_sql(_PAIRS)})::bigint AS n_mine, (SELECT count(*) FROM {_OTHER})::bigint AS n_other, count(*)::bigint AS n_joined,
    coalesce(sum(m.y_id - o.y_id), 0)::bigint AS sum_diff, count(*) FILTER (WHERE m.y_id <> o.y_id)::bigint AS n_different FROM {_matched_sql(_PAIRS)} m JOIN {_OTHER} o USING (x_id)""")
def compare_matches(spark, sf_dir):
    export = sky(spark, sf_dir, "customer").select(F.expr(
        "concat_ws(',', cast(id AS string), 'a', 'b', cast(id + id % 3 AS string), 'c', 'd', '0.5')").alias("value"))
    return match.compare_matches(_degree_match(spark, sf_dir), results.parse_match_export(export))

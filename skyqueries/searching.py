"""Region searches over points and over cells, and enclosing cones."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from skylattice.functions.angles import chord_of
from skylattice.functions.cells import max_pixel_radius, with_nest, with_ring
from skylattice.operators import coverage, regions, rings
from skylattice.operators.regions import Cap, Convex, Polygon, Strip, vector_of_degrees
from skyqueries import duck
from skyqueries.fixtures import VECTORS_SQL, r_sql, rounded, sky, sky_sql, table, vectors
from skyqueries.registry import query

_ORDERS, _CUSTOMER, _SUPPLIER = sky_sql("orders"), sky_sql("customer"), sky_sql("supplier")

# One cone per supplier: 1 to 7 degrees.
_CONES = f"(SELECT id AS disc_id, x AS cx, y AS cy, z AS cz, radians(1 + id % 7) AS radius FROM {_SUPPLIER})"


def _cones(spark, sf_dir):
    return sky(spark, sf_dir, "supplier").select(
        F.col("id").alias("disc_id"), F.col("x").alias("cx"), F.col("y").alias("cy"), F.col("z").alias("cz"),
        F.expr("radians(1D + id % 7)").alias("radius"))


_D2 = "(p.x-c.cx)^2 + (p.y-c.cy)^2 + (p.z-c.cz)^2"
_INSIDE = f"{_D2} < (2 * sin(c.radius / 2))^2"


@query("f08_points_in_cones", f"SELECT disc_id, id FROM {_CONES} c JOIN {_CUSTOMER} p ON {_INSIDE}")
def points_in_cones(spark, sf_dir):
    points = sky(spark, sf_dir, "customer").select("id", "x", "y", "z")
    return regions.points_in_discs(points, _cones(spark, sf_dir), math.radians(7.0)).select("disc_id", "id")


def _cells_sql(order: int) -> str:
    """Every cell centre of an order as x, y, z."""
    return f"(SELECT pix, cx AS x, cy AS y, cz AS z FROM {duck.centre_sql(f'(SELECT unnest(range(0, {12 << (2 * order)})) AS pix)', order, 'pix')})"


@query("f08_cells_in_cones", f"SELECT disc_id, pix AS pix_nest FROM {_CONES} c JOIN {_cells_sql(5)} p ON {_INSIDE}")
def cells_in_cones(spark, sf_dir):
    return regions.at_order(regions.disc_cells(_cones(spark, sf_dir), 5), 5).select("disc_id", "pix_nest")


@query("f09_inclusive_cone_cover", f"SELECT disc_id, count(*)::bigint AS n_points, count(*)::bigint AS n_covered, true AS small_excess FROM {_CONES} c JOIN {_CUSTOMER} p ON {_INSIDE} GROUP BY disc_id")
def inclusive_cone_cover(spark, sf_dir):
    """Every point of a cone lies in a cell of its cover, and no cell's centre is further out than the cell's radius."""
    cones, order = _cones(spark, sf_dir), 4
    cells = regions.at_order(regions.disc_cells(cones, order, fact=4), order).select("disc_id", "pix_nest")
    inside = regions.points_in_discs(sky(spark, sf_dir, "customer").select("id", "x", "y", "z"), cones, math.radians(7.0))
    tagged = with_nest(inside, order, vector=("x", "y", "z"))
    covered = tagged.join(cells.withColumn("hit", F.lit(1)), ["disc_id", "pix_nest"], "left").groupBy("disc_id").agg(
        F.count("*").alias("n_points"), F.count("hit").alias("n_covered"))
    from skylattice.functions.cells import with_centre

    far = with_centre(cells, order).join(cones, "disc_id").groupBy("disc_id").agg(
        F.every(F.expr("acos(least(1D, x*cx + y*cy + z*cz))") <= F.col("radius") + F.lit(max_pixel_radius(order) + 1e-9)).alias("small_excess"))
    return covered.join(far, "disc_id").select("disc_id", "n_points", "n_covered", "small_excess")


_RING_CELLS = lambda order: duck.ring_of_nest_sql(_cells_sql(order).replace("pix, cx", "pix, pix AS pix_nest, cx"), order)


def _ring_ranges_sql(keys: str, cells: str) -> str:
    """Ranges of a query with `keys`, `z` and `pix_ring`: runs of neighbouring numbers of one height."""
    return f"""SELECT {keys}, min(pix_ring)::bigint AS lo, (max(pix_ring) + 1)::bigint AS hi FROM (
        SELECT *, pix_ring - row_number() OVER (PARTITION BY {keys}, round(z, 9) ORDER BY pix_ring) AS island FROM {cells}) GROUP BY {keys}, round(z, 9), island"""


@query("f08_ring_ranges_of_cones", _ring_ranges_sql("disc_id", f"(SELECT disc_id, p.z, pix_ring FROM {_CONES} c JOIN {_RING_CELLS(5)} p ON {_INSIDE})"))
def ring_ranges_of_cones(spark, sf_dir):
    return rings.disc_ring_ranges(_cones(spark, sf_dir), 5).select("disc_id", "lo", "hi")


_RADII = [math.radians(deg) for deg in (1.013, 2.527, 4.891)]
_RING = f"CASE WHEN d2 > {chord_of(_RADII[1]) ** 2!r}::double THEN 1 ELSE 0 END"


@query("f10_ring_search", f"""SELECT disc_id, {_RING} AS ring, pix AS pix_nest FROM (SELECT disc_id, pix, {_D2} AS d2 FROM {_CONES} c JOIN {_cells_sql(5)} p
    ON {_D2} <= {chord_of(_RADII[2]) ** 2!r}::double AND {_D2} > {chord_of(_RADII[0]) ** 2!r}::double)""")
def ring_search(spark, sf_dir):
    return regions.ring_cells(_cones(spark, sf_dir).drop("radius"), 5, _RADII)


# --- polygons ---------------------------------------------------------------------------------------

_BOX = tuple(vector_of_degrees(ra, dec) for ra, dec in ((140, 5), (140, 45), (220, 45), (220, 5)))
_STAR = tuple(vector_of_degrees(180 + 38 * r * math.cos(a), 10 + 30 * r * math.sin(a))
              for a, r in ((math.pi * k / 5 + 0.1, 1.0 if k % 2 == 0 else 0.38) for k in range(10)))


def _halfspaces_sql(vertices) -> str:
    return " AND ".join(
        f"x * {cap.centre[0]!r}::double + y * {cap.centre[1]!r}::double + z * {cap.centre[2]!r}::double > {math.cos(cap.radius)!r}::double"
        for cap in Convex(vertices)._caps())


@query("f11_points_in_convex_polygon", f"SELECT id FROM {_ORDERS} WHERE {_halfspaces_sql(_BOX)}")
def points_in_convex(spark, sf_dir):
    return regions.points_in_region(sky(spark, sf_dir, "orders"), Convex(_BOX)).select("id")


def _occupied_sql(condition: str, order: int) -> str:
    """Order rows whose cell centre satisfies a condition on x, y, z."""
    centred = duck.centre_sql(f"(SELECT id, pix_nest FROM {duck.nest_sql(_ORDERS, order)})", order)
    return f"SELECT id, pix_nest FROM (SELECT id, pix_nest, cx AS x, cy AS y, cz AS z FROM {centred}) WHERE {condition}"


def _occupied(spark, sf_dir, region, order, finest=None):
    """Order rows whose cell belongs to the region's cells."""
    cells = regions.at_order(regions.region_cells(spark, region, order, finest), order)
    return with_nest(sky(spark, sf_dir, "orders"), order).join(cells, "pix_nest").select("id", "pix_nest")


@query("f11_cells_in_convex_polygon", _occupied_sql(_halfspaces_sql(_BOX), 6))
def cells_in_convex(spark, sf_dir):
    return _occupied(spark, sf_dir, Convex(_BOX), 6)


def _cover_check(spark, sf_dir, region, order, finest):
    """Points inside the region, and how many of them lie in its inclusive cells."""
    inside = regions.points_in_region(sky(spark, sf_dir, "orders"), region)
    cells = regions.at_order(regions.region_cells(spark, region, order, finest), order)
    tagged = with_nest(inside, order, vector=("x", "y", "z")).join(cells.withColumn("hit", F.lit(1)), "pix_nest", "left")
    return tagged.agg(F.count("*").alias("n_inside"), F.count("hit").alias("n_covered"))


@query("f11_inclusive_convex_polygon", f"SELECT count(*)::bigint AS n_inside, count(*)::bigint AS n_covered FROM {_ORDERS} WHERE {_halfspaces_sql(_BOX)}")
def inclusive_convex(spark, sf_dir):
    return _cover_check(spark, sf_dir, Convex(_BOX), 3, 5)


def _triangles_sql(vertices) -> str:
    """A star-shaped polygon as the union of triangles from its middle: another route than counting crossings."""
    middle = tuple(sum(parts) for parts in zip(*vertices))
    parts = [_halfspaces_sql((middle, a, b)).replace("> 6.123233995736766e-17::double", ">= 0") for a, b in zip(vertices, vertices[1:] + vertices[:1])]
    return "(" + " OR ".join(f"({part})" for part in parts) + ")"


@query("f12_points_in_general_polygon", f"SELECT id FROM {_ORDERS} WHERE {_triangles_sql(_STAR)}")
def points_in_general(spark, sf_dir):
    return regions.points_in_region(sky(spark, sf_dir, "orders"), Polygon(_STAR)).select("id")


@query("f12_cells_in_general_polygon", _occupied_sql(_triangles_sql(_STAR), 6))
def cells_in_general(spark, sf_dir):
    return _occupied(spark, sf_dir, Polygon(_STAR), 6)


@query("f12_inclusive_general_polygon", f"SELECT count(*)::bigint AS n_inside, count(*)::bigint AS n_covered FROM {_ORDERS} WHERE {_triangles_sql(_STAR)}")
def inclusive_general(spark, sf_dir):
    return _cover_check(spark, sf_dir, Polygon(_STAR), 3, 5)


# --- strips and boolean expressions -----------------------------------------------------------------

_T1, _T2 = math.radians(50.123), math.radians(77.321)
_STRIP_SQL = f"z < {math.cos(_T1)!r}::double AND z > {math.cos(_T2)!r}::double"


@query("f13_points_in_strip", f"SELECT id FROM {_ORDERS} WHERE {_STRIP_SQL}")
def points_in_strip(spark, sf_dir):
    return regions.points_in_region(sky(spark, sf_dir, "orders"), Strip(_T1, _T2)).select("id")


@query("f13_cells_in_strip", _occupied_sql(_STRIP_SQL, 6))
def cells_in_strip(spark, sf_dir):
    return _occupied(spark, sf_dir, Strip(_T1, _T2), 6)


_STRIPS = "(SELECT id AS strip_id, radians((id * 37 % 1800) / 10::double + 0.0123::double) AS theta1, radians((id * 53 % 1800) / 10::double + 0.0123::double) AS theta2 FROM supplier_sky)"


@query("f13_ring_ranges_of_strips", f"""WITH supplier_sky AS MATERIALIZED {sky_sql('supplier')}, inside AS (SELECT strip_id, pix_ring FROM {_STRIPS} s JOIN {_RING_CELLS(4)} p
    ON CASE WHEN theta1 < theta2 THEN z < cos(theta1) AND z > cos(theta2) ELSE z < cos(theta1) OR z > cos(theta2) END)
    SELECT strip_id, min(pix_ring)::bigint AS lo, (max(pix_ring) + 1)::bigint AS hi FROM (
        SELECT *, pix_ring - row_number() OVER (PARTITION BY strip_id ORDER BY pix_ring) AS island FROM inside) GROUP BY strip_id, island""")
def ring_ranges_of_strips(spark, sf_dir):
    """A table of strips, some of them around both poles."""
    strips = sky(spark, sf_dir, "supplier").select(
        F.col("id").alias("strip_id"), F.expr("radians((id * 37 % 1800) / 10D + 0.0123D)").alias("theta1"), F.expr("radians((id * 53 % 1800) / 10D + 0.0123D)").alias("theta2"))
    return rings.strip_ring_ranges(strips, 4).select("strip_id", "lo", "hi")


_STRIP_CELLS = f"(SELECT id, cz AS z, csth AS sth, cphi AS phi FROM {duck.centre_sql(f'(SELECT id, pix_nest FROM {duck.nest_sql(_ORDERS, 6)})', 6)})"


@query("f13_ring_cells_in_strip", f"SELECT id, pix_ring FROM {duck.ring_sql(f'(SELECT * FROM {_STRIP_CELLS} WHERE {_STRIP_SQL})', 6)}")
def ring_cells_in_strip(spark, sf_dir):
    cells = regions.at_order(regions.region_cells(spark, Strip(_T1, _T2), 6), 6, "ring")
    return with_ring(sky(spark, sf_dir, "orders"), 6).join(cells, "pix_ring").select("id", "pix_ring")


@query("f13_cells_in_open_strip", _occupied_sql(f"(z < {math.cos(_T2)!r}::double OR z > {math.cos(_T1)!r}::double)", 6))
def cells_in_open_strip(spark, sf_dir):
    return _occupied(spark, sf_dir, Strip(_T2, _T1), 6)


@query("f13_inclusive_strip", f"SELECT count(*)::bigint AS n_inside, count(*)::bigint AS n_covered FROM {_ORDERS} WHERE {_STRIP_SQL}")
def inclusive_strip(spark, sf_dir):
    return _cover_check(spark, sf_dir, Strip(_T1, _T2), 3, 4)


_CAPS = [Cap(vector_of_degrees(ra, dec), math.radians(radius)) for ra, dec, radius in ((30, 20, 25.03), (55, 10, 20.07), (40, 60, 30.11), (200, -50, 100.13))]
_EXPRESSION = ((_CAPS[0] & ~_CAPS[1]) | (_CAPS[2] ^ _CAPS[1])) & ~_CAPS[3]


def _cap_sql(cap: Cap) -> str:
    size = math.sqrt(sum(v * v for v in cap.centre))
    a, b, c = (v / size for v in cap.centre)
    return f"(x * {a!r}::double + y * {b!r}::double + z * {c!r}::double > {math.cos(cap.radius)!r}::double)"


_S = [_cap_sql(cap) for cap in _CAPS]
_EXPRESSION_SQL = f"((({_S[0]} AND NOT {_S[1]}) OR ({_S[2]} <> {_S[1]})) AND NOT {_S[3]})"


@query("f14_points_in_expression", f"SELECT id FROM {_ORDERS} WHERE {_EXPRESSION_SQL}")
def points_in_expression(spark, sf_dir):
    return regions.points_in_region(sky(spark, sf_dir, "orders"), _EXPRESSION).select("id")


@query("f14_cells_in_expression", _occupied_sql(_EXPRESSION_SQL, 7))
def cells_in_expression(spark, sf_dir):
    return _occupied(spark, sf_dir, _EXPRESSION, 7)


@query("f14_expression_as_coverage", f"""SELECT count(DISTINCT id)::bigint AS n_points FROM ({_occupied_sql(_EXPRESSION_SQL, 6)})""")
def expression_as_coverage(spark, sf_dir):
    """The expression's cells as merged ranges, and the points they cover."""
    cells = regions.region_cells(spark, _EXPRESSION, 6).withColumn("set_id", F.lit(0))
    ranges = coverage.coalesce(regions.as_ranges(cells, "set_id"), 6)
    points = with_nest(sky(spark, sf_dir, "orders"), 29, "pix29").select("id", "pix29")
    return coverage.points_in_sets(points, ranges, order=6).agg(F.count("*").alias("n_points"))


@query("f15_inclusive_expression", f"SELECT count(*)::bigint AS n_inside, count(*)::bigint AS n_covered FROM {_ORDERS} WHERE {_EXPRESSION_SQL}")
def inclusive_expression(spark, sf_dir):
    return _cover_check(spark, sf_dir, _EXPRESSION, 4, 6)


# --- enclosing cones --------------------------------------------------------------------------------


@query("a18_enclosing_cones", f"""SELECT label, n, {r_sql('cx')} AS cx, {r_sql('cy')} AS cy, {r_sql('cz')} AS cz, {r_sql('radius', 5)} AS radius FROM (
    SELECT label, any_value(n) AS n, any_value(cx) AS cx, any_value(cy) AS cy, any_value(cz) AS cz, max(acos(greatest(-1.0, least(1.0, x*cx + y*cy + z*cz)))) AS radius FROM {VECTORS_SQL} JOIN (
      SELECT label, n, mx / m AS cx, my / m AS cy, mz / m AS cz FROM (SELECT *, sqrt(mx*mx + my*my + mz*mz) AS m FROM (
        SELECT label, count(*)::bigint AS n, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM {VECTORS_SQL} GROUP BY label))) USING (label) GROUP BY label)""")
def enclosing_cones(spark, sf_dir):
    found = regions.enclosing_cone(vectors(spark, sf_dir), "label")
    return found.select("label", "n", *[rounded(c).alias(c) for c in ("cx", "cy", "cz")], rounded("radius", 5).alias("radius"))

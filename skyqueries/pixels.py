"""Projections: angles, vectors, pixel ids, bins."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from skylattice.functions import angles as A
from skylattice.functions import bins as B
from skylattice.functions import cells as C
from skyqueries import duck
from skyqueries.fixtures import r_sql, rounded, sky, sky_sql
from skyqueries.registry import query

PI = math.pi
_ORDERS = sky_sql("orders")
_CUSTOMER = sky_sql("customer")


@query("p01_degrees_to_angles", f"SELECT id, {r_sql('radians(90 - dec)')} AS theta, {r_sql('radians(360 - ra)')} AS phi, {r_sql('radians(ra)')} AS phi_plain FROM {_ORDERS}")
def degrees_to_angles(spark, sf_dir):
    rows = A.with_angles(sky(spark, sf_dir, "orders").select("id", "ra", "dec"))
    return rows.select("id", rounded("theta").alias("theta"), rounded("phi").alias("phi"),
                       rounded(A.phi_of_ra(F.col("ra"), mirror=False)).alias("phi_plain"))


@query("p02_angles_to_degrees", f"SELECT id, {r_sql('360 - degrees(phi)')} AS ra, {r_sql('90 - degrees(theta)')} AS dec FROM {_ORDERS}")
def angles_to_degrees(spark, sf_dir):
    rows = A.with_degrees(sky(spark, sf_dir, "orders").select("id", "theta", "phi"))
    return rows.select("id", rounded("ra").alias("ra"), rounded("dec").alias("dec"))


@query("p03_vector_conversions", f"""SELECT id, {r_sql('x')} AS x, {r_sql('y')} AS y, {r_sql('z')} AS z, {r_sql('theta')} AS theta, {r_sql('phi')} AS phi, {r_sql('z')} AS z_back, {r_sql('theta')} AS theta_of_z FROM {_ORDERS}""")
def vector_conversions(spark, sf_dir):
    rows = A.with_vector(sky(spark, sf_dir, "orders").select("id", "theta", "phi"))
    theta, phi = A.angles_of_vector(F.col("x") * 3.0, F.col("y") * 3.0, F.col("z") * 3.0)
    z, _ = A.zphi_of_vector(F.col("x") * 3.0, F.col("y") * 3.0, F.col("z") * 3.0)
    vx, vy, vz = A.vector_of_zphi(*A.zphi_of_angles(F.col("theta"), F.col("phi")))
    theta_of_z, _ = A.angles_of_zphi(F.col("z"), F.col("phi"))
    return rows.select("id", rounded(vx).alias("x"), rounded(vy).alias("y"), rounded(vz).alias("z"), rounded(theta).alias("theta"),
                       rounded(phi).alias("phi"), rounded(z).alias("z_back"), rounded(theta_of_z).alias("theta_of_z"))


@query("p04_normalise_angles", f"""SELECT id, {r_sql('atan2(abs(sin(t)), cos(t))')} AS theta,
    {r_sql(f'((CASE WHEN sin(t) < 0 THEN p + pi() ELSE p END) % (2*pi()) + 2*pi()) % (2*pi())')} AS phi
    FROM (SELECT id, dec AS t, ra / 10 - 20 AS p FROM {_ORDERS})""")
def normalise_angles(spark, sf_dir):
    theta, phi = A.normalised(F.col("dec"), F.col("ra") / 10 - 20)
    return sky(spark, sf_dir, "orders").select("id", rounded(theta).alias("theta"), rounded(phi).alias("phi"))


_PAIRED = f"(SELECT a.id, a.x AS px, a.y AS py, a.z AS pz, a.theta AS pt, a.phi AS pp, b.x AS qx, b.y AS qy, b.z AS qz, b.theta AS qt, b.phi AS qp FROM {_CUSTOMER} a JOIN {sky_sql('part')} b ON a.id = b.id)"


def _paired(spark, sf_dir):
    pick = lambda name, prefix: sky(spark, sf_dir, name).select(
        "id", *[F.col(c).alias(prefix + s) for c, s in (("x", "x"), ("y", "y"), ("z", "z"), ("theta", "t"), ("phi", "p"))])
    return pick("customer", "p").join(pick("part", "q"), "id"), tuple(F.col("p" + c) for c in "xyz"), tuple(F.col("q" + c) for c in "xyz")


@query("p05_vector_algebra", f"""SELECT id, {r_sql('px*qx+py*qy+pz*qz')} AS dot, {r_sql('py*qz-pz*qy')} AS cross_x, {r_sql('pz*qx-px*qz')} AS cross_y,
    {r_sql('px*qy-py*qx')} AS cross_z, {r_sql('sqrt((px+qx)^2+(py+qy)^2+(pz+qz)^2)')} AS sum_length, {r_sql('2*(px-qx)')} AS diff_x2,
    {r_sql('-pz')} AS flip_z, {r_sql('(pz+qz)/sqrt((px+qx)^2+(py+qy)^2+(pz+qz)^2)')} AS unit_z FROM {_PAIRED}""")
def vector_algebra(spark, sf_dir):
    rows, a, b = _paired(spark, sf_dir)
    cross = A.cross(a, b)
    return rows.select(
        "id", rounded(A.dot(a, b)).alias("dot"), rounded(cross[0]).alias("cross_x"), rounded(cross[1]).alias("cross_y"),
        rounded(cross[2]).alias("cross_z"), rounded(A.length(*A.add(a, b))).alias("sum_length"),
        rounded(A.scale(A.sub(a, b), 2.0)[0]).alias("diff_x2"), rounded(A.flip(a)[2]).alias("flip_z"),
        rounded(A.unit(A.add(a, b))[2]).alias("unit_z"))


@query("p06_angle_between", f"SELECT id, {r_sql('acos(greatest(-1.0, least(1.0, px*qx+py*qy+pz*qz)))', 5)} AS angle FROM {_PAIRED}")
def angle_between(spark, sf_dir):
    rows, a, b = _paired(spark, sf_dir)
    return rows.select("id", rounded(A.angle(a, b), 5).alias("angle"))


@query("p07_haversine", f"SELECT id, {r_sql('acos(greatest(-1.0, least(1.0, px*qx+py*qy+pz*qz)))', 5)} AS separation FROM {_PAIRED}")
def haversine(spark, sf_dir):
    rows, _, _ = _paired(spark, sf_dir)
    return rows.select("id", rounded(A.haversine(F.col("pt"), F.col("pp"), F.col("qt"), F.col("qp")), 5).alias("separation"))


@query("p08_chord_and_cosine", f"SELECT id, {r_sql('(px-qx)^2+(py-qy)^2+(pz-qz)^2')} AS chord2, {r_sql('px*qx+py*qy+pz*qz')} AS cosine FROM {_PAIRED}")
def chord_and_cosine(spark, sf_dir):
    rows, a, b = _paired(spark, sf_dir)
    return rows.select("id", rounded(A.chord2(a, b)).alias("chord2"),
                       rounded(A.cos_distance(F.col("pz"), F.col("pp"), F.col("qz"), F.col("qp"))).alias("cosine"))


_BOTH = duck.nest_sql(duck.nest_sql(_ORDERS, 3, "pix3"), 13, "pix13")


@query("p09_pixelise_nest", f"SELECT id, pix3, pix13, pix13 AS pix13_vector FROM {_BOTH}")
def pixelise_nest(spark, sf_dir):
    rows = C.with_nest(C.with_nest(sky(spark, sf_dir, "orders"), 3, "pix3"), 13, "pix13")
    rows = C.with_nest(rows, 13, "pix13_vector", vector=("x", "y", "z"))
    return rows.select("id", "pix3", "pix13", "pix13_vector")


@query("p10_pixelise_ring", f"SELECT id, pix3, pix13, pix13 AS pix13_vector FROM {duck.ring_sql(duck.ring_sql(_ORDERS, 3, 'pix3'), 13, 'pix13')}")
def pixelise_ring(spark, sf_dir):
    rows = C.with_ring(C.with_ring(sky(spark, sf_dir, "orders"), 3, "pix3"), 13, "pix13")
    rows = C.with_ring(rows, 13, "pix13_vector", vector=("x", "y", "z"))
    return rows.select("id", "pix3", "pix13", "pix13_vector")


_CENTRES = duck.centre_sql(f"(SELECT id, pix_nest FROM {duck.nest_sql(_ORDERS, 8)})", 8)
_CENTRE_COLUMNS = f"{r_sql('atan2(csth, cz)')} AS theta, {r_sql('cphi')} AS phi, {r_sql('cx')} AS x, {r_sql('cy')} AS y, {r_sql('cz')} AS z"


def _centre_columns(prefix=""):
    return [rounded(prefix + c).alias(c) for c in ("theta", "phi", "x", "y", "z")]


@query("p11_centre_nest", f"SELECT id, pix_nest, {_CENTRE_COLUMNS} FROM {_CENTRES}")
def centre_nest(spark, sf_dir):
    rows = C.with_nest(sky(spark, sf_dir, "orders"), 8).select("id", "pix_nest")
    return C.with_centre(rows, 8).select("id", "pix_nest", *_centre_columns())


@query("p11_centre_ring", f"SELECT id, {_CENTRE_COLUMNS} FROM {_CENTRES}")
def centre_ring(spark, sf_dir):
    rows = C.with_ring(sky(spark, sf_dir, "orders"), 8).select("id", "pix_ring")
    return C.with_ring_centre(rows, 8).select("id", *_centre_columns())


_RENUMBER = duck.ring_sql(duck.nest_sql(_ORDERS, 11), 11)


@query("p12_renumber", f"SELECT id, pix_nest, pix_ring, pix_ring AS ring_of_nest, pix_nest AS nest_of_ring FROM {_RENUMBER}")
def renumber(spark, sf_dir):
    rows = C.with_ring(C.with_nest(sky(spark, sf_dir, "orders"), 11), 11).select("id", "pix_nest", "pix_ring")
    rows = C.nest_to_ring(rows, 11, "pix_nest", "ring_of_nest")
    return C.ring_to_nest(rows, 11, "pix_ring", "nest_of_ring").select("id", "pix_nest", "pix_ring", "ring_of_nest", "nest_of_ring")


@query("p13_parent_and_children", f"""SELECT parent, child, n FROM (SELECT pix_nest >> 4 AS parent, count(*)::bigint AS n FROM {duck.nest_sql(_ORDERS, 6)} GROUP BY 1),
    LATERAL (SELECT parent * 4 + unnest([0, 1, 2, 3]) AS child)""")
def parent_and_children(spark, sf_dir):
    rows = C.with_nest(sky(spark, sf_dir, "orders"), 6)
    parents = rows.groupBy(C.nest_parent(F.col("pix_nest"), 6, 4).alias("parent")).agg(F.count("*").alias("n"))
    return C.with_children(parents, 4, 5, "parent").select("parent", "child", "n")


@query("p14_parent_ring", f"SELECT id, pix_ring, parent_ring FROM {duck.ring_of_nest_sql('(SELECT id, pix_ring, pix_nest >> 8 AS parent_nest FROM ' + duck.ring_sql(duck.nest_sql(_ORDERS, 9), 9) + ')', 5, 'parent_nest', 'parent_ring')}")
def parent_ring(spark, sf_dir):
    rows = C.with_ring(sky(spark, sf_dir, "orders"), 9).select("id", "pix_ring")
    return C.ring_parent(rows, 9, 5).select("id", "pix_ring", "parent_ring")


def _corner_cells_sql(order: int) -> str:
    """Cells of an order with the corner points they have, qy rounded position."""
    cells = f"(SELECT unnest(range(0, {12 << (2 * order)})) AS pix)"
    corners = f"(SELECT *, unnest([0, 1, 0, 1]) AS dx, unnest([0, 0, 1, 1]) AS dy FROM {duck.face_parts_sql(cells, order, 'pix')})"
    n = float(1 << order)
    placed = duck.place_sql(corners, f"(k_ix + dx)::double / {n!r}::double", f"(k_iy + dy)::double / {n!r}::double")
    return f"(SELECT pix, (round(cx, 6) + 0)::double AS gx, (round(cy, 6) + 0)::double AS gy, (round(cz, 6) + 0)::double AS gz FROM {placed})"


_TOUCHING = f"""WITH corners AS MATERIALIZED {_corner_cells_sql(5)}, occupied AS (SELECT DISTINCT pix_nest AS pix FROM {duck.nest_sql(_ORDERS, 5)}),
    touching AS (SELECT DISTINCT a.pix, b.pix AS neighbour FROM occupied o JOIN corners a USING (pix) JOIN corners b ON a.gx = b.gx AND a.gy = b.gy AND a.gz = b.gz WHERE a.pix <> b.pix)"""


@query("p15_neighbours_nest", f"{_TOUCHING} SELECT pix, neighbour FROM touching UNION ALL SELECT pix, -1 FROM (SELECT pix, count(*) AS n FROM touching GROUP BY pix), LATERAL (SELECT unnest(range(0, 8 - n)))")
def neighbours_nest(spark, sf_dir):
    cells = C.with_nest(sky(spark, sf_dir, "orders"), 5, "pix").select("pix").distinct()
    return C.with_neighbours(cells, 5, "pix").select("pix", "neighbour")


_RING_TOUCHING = duck.ring_of_nest_sql(f"(SELECT pix_ring AS ring, neighbour FROM {duck.ring_of_nest_sql('(SELECT pix AS pix_nest, neighbour FROM touching)', 5)})", 5, "neighbour", "near")


@query("p15_neighbours_ring", f"{_TOUCHING} SELECT ring AS pix_ring, count(*)::bigint AS n, sum(near)::bigint AS id_sum FROM {_RING_TOUCHING} GROUP BY ring")
def neighbours_ring(spark, sf_dir):
    cells = C.with_ring(sky(spark, sf_dir, "orders"), 5).select("pix_ring").distinct()
    near = C.with_ring_neighbours(cells, 5).where("neighbour >= 0")
    return near.groupBy("pix_ring").agg(F.count("*").alias("n"), F.sum("neighbour").alias("id_sum"))


_EDGE = "(point % 3) / 3::double"
_BOUNDARY = duck.place_sql(
    f"(SELECT *, unnest(range(0, 12))::integer AS point FROM {duck.face_parts_sql(f'(SELECT DISTINCT pix_nest FROM {duck.nest_sql(_ORDERS, 6)})', 6, 'pix_nest')})",
    f"(k_ix + CASE point // 3 WHEN 0 THEN 1 - {_EDGE} WHEN 1 THEN 0 WHEN 2 THEN {_EDGE} ELSE 1 END)::double / 64::double",
    f"(k_iy + CASE point // 3 WHEN 0 THEN 1 WHEN 1 THEN 1 - {_EDGE} WHEN 2 THEN 0 ELSE {_EDGE} END)::double / 64::double")


@query("p16_boundary_points", f"SELECT pix_nest, point, {r_sql('cx')} AS x, {r_sql('cy')} AS y, {r_sql('cz')} AS z FROM {_BOUNDARY}")
def boundary_points(spark, sf_dir):
    cells = C.with_nest(sky(spark, sf_dir, "orders"), 6).select("pix_nest").distinct()
    return C.with_boundary(cells, 6, 3).select("pix_nest", "point", *[rounded(c).alias(c) for c in "xyz"])


@query("p16_ring_boundary_points", f"SELECT pix_ring, point, {r_sql('b.cx')} AS x, {r_sql('b.cy')} AS y, {r_sql('b.cz')} AS z FROM {_BOUNDARY} b JOIN {duck.ring_of_nest_sql(f'(SELECT DISTINCT pix_nest, z, sth, phi FROM {duck.nest_sql(_ORDERS, 6)} QUALIFY row_number() OVER (PARTITION BY pix_nest ORDER BY z) = 1)', 6)} r USING (pix_nest)")
def ring_boundary_points(spark, sf_dir):
    cells = C.with_ring(sky(spark, sf_dir, "orders"), 6).select("pix_ring").distinct()
    return C.with_boundary(cells, 6, 3, "pix_ring", "ring").select("pix_ring", "point", *[rounded(c).alias(c) for c in "xyz"])


@query("p17_unique_ids", f"""SELECT id, uniq, ord AS "order", pix FROM (SELECT id, (id % 14)::integer AS ord, pix13 >> (2 * (13 - id % 14)) AS pix, (pix13 >> (2 * (13 - id % 14))) + 4 ** (id % 14 + 1)::bigint AS uniq FROM {_BOTH})"""
       .replace("4 ** (id % 14 + 1)::bigint", "(4::bigint << (2 * (id % 14)))"))
def unique_ids(spark, sf_dir):
    rows = C.with_nest(sky(spark, sf_dir, "orders"), 13, "pix13").withColumn("level", F.expr("cast(id % 14 AS int)"))
    rows = rows.select("id", C.uniq_of(F.col("level"), F.expr("shiftright(pix13, 2 * (13 - level))")).alias("uniq"))
    return C.with_uniq_parts(rows).select("id", "uniq", "order", "pix")


def _flat(rows):
    return "[" + ", ".join(str(v) for row in rows for v in row) + "]"


_CURVE_SQL = f"""SELECT id, pix_nest, key AS curve_key, pix_nest AS pix_back FROM (SELECT id, pix_nest,
    ((list_extract({_flat([C.CURVE_FACE_PLACE])}, (pix_nest >> 20) + 1)::bigint << 20)
     + (list_reduce(list_prepend(list_extract({_flat([C.CURVE_FACE_SHAPE])}, (pix_nest >> 20) + 1)::bigint, list_transform(range(0, 10), lambda k: (pix_nest >> (2 * (9 - k))) & 3)),
        lambda a, q: ((((a >> 3) << 2) + (list_extract({_flat(C.CURVE_STEPS)}, (a & 7) * 4 + q + 1)::bigint & 3)) << 3) + (list_extract({_flat(C.CURVE_STEPS)}, (a & 7) * 4 + q + 1)::bigint >> 2)) >> 3))::bigint AS key
    FROM {duck.nest_sql(_ORDERS, 10)})"""


@query("p18_curve_key", _CURVE_SQL)
def curve_key(spark, sf_dir):
    rows = C.nest_to_curve(C.with_nest(sky(spark, sf_dir, "orders"), 10).select("id", "pix_nest"), 10)
    return C.curve_to_nest(rows, 10, out="pix_back").select("id", "pix_nest", "curve_key", "pix_back")


@query("p18_cluster_by_curve", f"SELECT id, pix_nest FROM {duck.nest_sql(_ORDERS, 10)}")
def cluster_by_curve(spark, sf_dir):
    rows = C.with_nest(sky(spark, sf_dir, "orders"), 10).select("id", "pix_nest")
    return C.cluster_by_curve(rows, 10, 16).select("id", "pix_nest")


@query("p19_cell_constants", f"""SELECT ord AS "order", (12 * 4::bigint ** ord)::bigint AS npix, count(*)::bigint AS n, count(*)::bigint AS n_within FROM
    (SELECT unnest([1, 4, 7]) AS ord, id FROM {_ORDERS}) GROUP BY ord""".replace("4::bigint ** ord", "(1::bigint << (2 * ord))"))
def cell_constants(spark, sf_dir):
    """No point is further from its cell's centre than the stated radius."""
    points = sky(spark, sf_dir, "orders").select("id", "x", "y", "z")
    found = None
    for order in (1, 4, 7):
        rows = C.with_centre(C.with_nest(points, order, "pix", vector=("x", "y", "z")), order, "pix", "c")
        near = F.expr("power(x-cx,2)+power(y-cy,2)+power(z-cz,2)") <= F.lit(A.chord_of(C.max_pixel_radius(order)) ** 2 * (1 + 1e-12))
        row = rows.agg(F.count("*").alias("n"), F.count_if(near).alias("n_within")).select(
            F.lit(order).alias("order"), F.lit(C.npix(order)).alias("npix"), "n", "n_within")
        found = row if found is None else found.unionByName(row)
    return found


_NEAREST_SEP = f"(SELECT id, acos(greatest(-1.0, least(1.0, px*qx+py*qy+pz*qz))) AS sep FROM {_PAIRED})"


@query("p20_bin_edges", f"""SELECT bin, {r_sql('lo')} AS lo, {r_sql('hi')} AS hi, {r_sql('(lo+hi)/2')} AS centre, (SELECT count(*) FROM {_NEAREST_SEP} WHERE degrees(sep) >= lo AND degrees(sep) < hi)::bigint AS n FROM (
    SELECT k::integer AS bin, (1 + (sqrt(60) - 1) * k / 12)^2 AS lo, (1 + (sqrt(60) - 1) * (k + 1) / 12)^2 AS hi FROM (SELECT unnest(range(0, 12)) AS k))""")
def bin_edges(spark, sf_dir):
    bins = B.make_bins(12, 1.0, 60.0, "sqrt")
    rows, a, b = _paired(spark, sf_dir)
    counts = rows.select(bins.of_chord2(A.chord2(a, b)).alias("bin")).where("bin IS NOT NULL").groupBy("bin").agg(F.count("*").alias("n"))
    listed = bins.frame(spark).join(counts, "bin", "left")
    return listed.select("bin", rounded("lo").alias("lo"), rounded("hi").alias("hi"), rounded("centre").alias("centre"), F.coalesce("n", F.lit(0)).alias("n"))


@query("p21_bin_of_separation", f"""SELECT bin, count(*)::bigint AS n FROM (SELECT floor((sqrt(degrees(sep)) - 1) * 12 / (sqrt(60) - 1))::integer AS bin FROM {_NEAREST_SEP})
    WHERE bin >= 0 AND bin < 12 GROUP BY bin""")
def bin_of_separation(spark, sf_dir):
    rows, a, b = _paired(spark, sf_dir)
    found = rows.select(B.bin_of_separation(A.angle(a, b), 12, 1.0, 60.0, "sqrt").alias("bin")).where("bin IS NOT NULL")
    return found.groupBy("bin").agg(F.count("*").alias("n"))


def _p22_edges():
    return {name: [math.degrees(e) for e in B.make_bins(8, 1.0, 90.0, name).edges] for name in ("linear", "log10")}


_P22 = " UNION ALL ".join(
    f"SELECT '{name}' AS scale, {i} AS bin, count(*)::bigint AS n FROM {_NEAREST_SEP} WHERE degrees(sep) >= {edges[i]!r}::double AND degrees(sep) < {edges[i + 1]!r}::double"
    for name, edges in _p22_edges().items() for i in range(8))


@query("p22_bin_of_chord", _P22)
def bin_of_chord(spark, sf_dir):
    rows, a, b = _paired(spark, sf_dir)
    rows = rows.select(A.chord2(a, b).alias("d2"))
    found = None
    for name in ("linear", "log10"):
        bins = B.make_bins(8, 1.0, 90.0, name)
        counts = rows.select(bins.of_chord2(F.col("d2")).alias("bin")).where("bin IS NOT NULL").groupBy("bin").agg(F.count("*").alias("n"))
        part = bins.frame(spark).join(counts, "bin", "left").select(F.lit(name).alias("scale"), "bin", F.coalesce("n", F.lit(0)).alias("n"))
        found = part if found is None else found.unionByName(part)
    return found

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skylattice.functions import cells as C
from skylattice.operators import regions as R
from skylattice.operators.regions import Cap, Convex, Polygon, Strip, vector


def centres(spark, order):
    rows = C.with_centre(spark.range(C.npix(order)).withColumnRenamed("id", "pix_nest"), order).collect()
    return {row.pix_nest: (row.x, row.y, row.z) for row in rows}


EXPRESSIONS = {
    "cap": Cap(vector(0.8, 1.0), 0.3),
    "tiny cap": Cap(vector(0.8, 1.0), 1e-4),
    "polar cap": Cap((0.0, 0.0, 1.0), 0.2),
    "more than half": Cap(vector(2.0, 4.0), 2.0),
    "strip": Strip(1.0, 1.2),
    "polar strip": Strip(0.0, 0.3),
    "open strip": Strip(2.8, 0.2),
    "convex": Convex((vector(1.0, 1.0), vector(1.3, 1.2), vector(1.0, 1.5), vector(0.7, 1.3))),
    "concave": Polygon((vector(0.6, 0.2), vector(1.2, 0.3), vector(0.9, 0.5), vector(1.3, 0.9), vector(0.5, 1.0))),
    "mixed": (Cap(vector(0.8, 1.0), 0.5) ^ Cap(vector(0.9, 1.3), 0.4)) & ~Strip(0.7, 0.9) | Cap(vector(3.0, 0.0), 0.1),
}


@pytest.mark.parametrize("name", EXPRESSIONS)
def test_cells_are_those_with_their_centre_inside(spark, name):
    region, order = EXPRESSIONS[name], 4
    points = spark.createDataFrame([(k, *v) for k, v in centres(spark, order).items()], "pix long, x double, y double, z double")
    expected = {row.pix for row in R.points_in_region(points, region).collect()}
    found = [row.pix_nest for row in R.at_order(R.region_cells(spark, region, order), order).collect()]
    assert len(found) == len(set(found))
    assert set(found) == expected


@pytest.mark.parametrize("name", ["tiny cap", "convex", "concave", "mixed", "open strip"])
def test_inclusive_cells_hold_every_inside_point(spark, name):
    region, order = EXPRESSIONS[name], 3
    v = np.random.default_rng(1).normal(size=(20000, 3))
    v[:2000] = np.array(vector(0.8, 1.0)) + 1e-4 * v[:2000]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    points = spark.createDataFrame([tuple(map(float, p)) for p in v], "x double, y double, z double")
    inside = C.with_nest(R.points_in_region(points, region), order, vector=("x", "y", "z"))
    needed = {row.pix_nest for row in inside.select("pix_nest").distinct().collect()}
    exact = {row.pix_nest for row in R.at_order(R.region_cells(spark, region, order), order).collect()}
    cover = {row.pix_nest for row in R.at_order(R.region_cells(spark, region, order, finest=order + 2), order).collect()}
    assert needed and needed <= cover and exact <= cover


def test_polygon_equals_convex_polygon(spark):
    corners = (vector(1.0, 6.1), vector(1.4, 6.2), vector(1.3, 6.5), vector(0.9, 6.4))
    v = np.random.default_rng(2).normal(size=(20000, 3)) * 0.3 + np.array(vector(1.15, 6.3))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(v)], "id int, x double, y double, z double")
    ids = lambda region: {row.id for row in R.points_in_region(points, region).collect()}
    assert ids(Polygon(corners)) == ids(Convex(corners)) == ids(Convex(corners[::-1])) == ids(Polygon(corners[::-1]))
    assert ids(~Polygon(corners)) == set(range(20000)) - ids(Convex(corners))


def test_bad_polygons():
    with pytest.raises(ValueError):
        Convex((vector(0.6, 0.2), vector(1.2, 0.3), vector(0.9, 0.5), vector(1.3, 0.9), vector(0.5, 1.0)))._caps()
    with pytest.raises(ValueError):
        Polygon((vector(1.0, 0.0), vector(1.0, 2.1), vector(1.0, 4.2), vector(3.0, 1.0)))._frame()
    with pytest.raises(ValueError):
        Polygon((vector(1.0, 0.0), vector(1.0, 1.0)))._frame()


def test_disc_cells_and_rings(spark):
    order = 4
    cells = centres(spark, order)
    discs = [(1, vector(0.01, 0.0), 0.2), (2, vector(1.5, 6.28), 0.15), (3, vector(2.0, 3.0), 3.0)]
    table = spark.createDataFrame([(i, *v, r) for i, v, r in discs], "disc_id int, cx double, cy double, cz double, radius double")
    found = {(row.disc_id, row.pix_nest) for row in R.at_order(R.disc_cells(table, order), order).collect()}
    apart = lambda a, b: math.acos(max(-1.0, min(1.0, sum(p * q for p, q in zip(a, b)))))
    assert found == {(i, pix) for i, v, r in discs for pix, c in cells.items() if apart(v, c) < r}
    radii = [0.05, 0.11, 0.173]
    rings = {(row.disc_id, row.ring, row.pix_nest) for row in R.ring_cells(table.drop("radius"), order, radii).collect()}
    assert rings == {(i, k, pix) for i, v, _ in discs for pix, c in cells.items() for k in range(2) if radii[k] < apart(v, c) <= radii[k + 1]}


def test_enclosing_cone_holds_all_points(spark):
    v = np.random.default_rng(4).normal(size=(500, 3)) * 0.1 + np.array([1.0, 0.2, -0.4])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    points = spark.createDataFrame([(i % 4, *map(float, p)) for i, p in enumerate(v)], "g int, x double, y double, z double")
    cones = R.enclosing_cone(points, "g")
    joined = points.join(cones, "g").withColumn("sep", F.acos(F.least(F.lit(1.0), F.expr("x*cx + y*cy + z*cz"))))
    assert joined.where("sep > radius + 1e-7").count() == 0
    assert [row.n for row in cones.collect()] == [125] * 4

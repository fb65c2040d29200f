import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skylattice.functions import cells as C


def all_cells(spark, order):
    return spark.range(C.npix(order)).withColumnRenamed("id", "pix")


@pytest.mark.parametrize("order", [0, 1, 4])
def test_ids_are_consistent(spark, order):
    rows = C.with_centre(all_cells(spark, order), order, "pix")
    rows = C.with_nest(rows, order, "from_angles")
    rows = C.with_nest(rows, order, "from_vector", vector=("x", "y", "z"))
    rows = C.nest_to_ring(rows, order, "pix", "ring")
    rows = C.with_ring(rows, order, "ring_direct")
    rows = C.ring_to_nest(rows, order, "ring", "back")
    rows = C.with_ring_centre(rows, order, "ring", "r_")
    rows = C.curve_to_nest(C.nest_to_curve(rows, order, "pix", "key"), order, "key", "uncurved")
    found = rows.agg(
        *[F.count_if(F.col(c) != F.col("pix")).alias(c) for c in ("from_angles", "from_vector", "back", "uncurved")],
        F.count_if(F.col("ring") != F.col("ring_direct")).alias("ring"),
        F.countDistinct("ring").alias("rings"), F.countDistinct("key").alias("keys"),
        F.max(F.expr("abs(x - r_x) + abs(y - r_y) + abs(z - r_z)")).alias("apart"),
    ).first()
    assert (found.from_angles, found.from_vector, found.back, found.uncurved, found.ring) == (0, 0, 0, 0, 0)
    assert found.rings == found["keys"] == C.npix(order)
    assert found.apart < 1e-14


@pytest.mark.parametrize("order", [18, 29])
def test_deep_orders(spark, order):
    rows = spark.range(20000).select(F.expr(f"pmod(xxhash64(id), {C.npix(order)}L)").alias("pix"))
    rows = C.with_nest(C.with_centre(rows, order, "pix"), order, "again")
    rows = C.ring_to_nest(C.nest_to_ring(rows, order, "pix", "ring"), order, "ring", "back")
    rows = rows.withColumn("uniq", C.uniq_of(F.lit(order), F.col("pix"))).withColumnRenamed("pix", "wanted")
    rows = C.with_uniq_parts(rows)
    assert rows.where(f"again <> wanted OR back <> wanted OR pix <> wanted OR `order` <> {order}").count() == 0


@pytest.mark.parametrize("order", [1, 2, 3])
def test_neighbours(spark, order):
    near = C.with_neighbours(all_cells(spark, order), order, "pix")
    pairs = {(row.pix, row.neighbour) for row in near.where("neighbour >= 0").collect()}
    assert near.where("neighbour < 0").count() == 24
    assert len(pairs) == 8 * C.npix(order) - 24
    assert all((b, a) in pairs and a != b for a, b in pairs)
    keys = {row.pix: row.key for row in C.nest_to_curve(all_cells(spark, order), order, "pix", "key").collect()}
    place = {key: pix for pix, key in keys.items()}
    assert all((place[k], place[k + 1]) in pairs for k in range(C.npix(order) - 1))


def test_boundary_surrounds_centre(spark):
    order = 3
    cells = C.with_centre(all_cells(spark, order), order, "pix", "c_")
    rows = C.with_boundary(cells, order, 4, "pix")
    limit = math.cos(C.max_pixel_radius(order)) - 1e-12
    assert rows.count() == 16 * C.npix(order)
    assert rows.where(F.expr("x * c_x + y * c_y + z * c_z") < limit).count() == 0


def test_poles_wrap_and_corners(spark):
    data = [(0.0, 0.0), (0.0, 5.0), (math.pi, 1.0), (math.pi / 2, 0.0), (math.pi / 2, 2 * math.pi), (math.pi / 2, -1e-18),
            (math.acos(2 / 3), math.pi / 4)]
    rows = spark.createDataFrame(data, "theta double, phi double")
    found = C.with_ring(C.with_nest(rows, 5), 5).collect()
    assert all(0 <= row.pix_nest < C.npix(5) and 0 <= row.pix_ring < C.npix(5) for row in found)
    by_place = {(row.theta, row.phi): row.pix_nest for row in found}
    assert by_place[(math.pi / 2, 0.0)] == by_place[(math.pi / 2, 2 * math.pi)]


def test_filter_on_id_stays_above_the_projections(spark):
    rows = C.with_nest(spark.range(1000).selectExpr("id * 0.001D AS theta", "id * 0.005D AS phi"), 18).where("pix_nest > 5")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("COS(") == 1


def test_max_pixel_radius_is_tight(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(20000, 3))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    points = spark.createDataFrame([tuple(map(float, p)) for p in v], "x double, y double, z double")
    rows = C.with_centre(C.with_nest(points, 1, "pix", vector=("x", "y", "z")), 1, "pix", "c_")
    worst = rows.agg(F.max(F.acos(F.least(F.lit(1.0), F.expr("x * c_x + y * c_y + z * c_z"))))).first()[0]
    assert 0.9 * C.max_pixel_radius(1) < worst <= C.max_pixel_radius(1)

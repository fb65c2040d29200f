"""Ring ranges and range sums against cells taken one by one."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skylattice.functions.bins import make_bins
from skylattice.functions.cells import npix, with_ring_centre
from skylattice.operators import coverage, paircount, rings


def centres(spark, order):
    rows = with_ring_centre(spark.range(npix(order)).withColumnRenamed("id", "pix_ring"), order).orderBy("pix_ring").select("x", "y", "z").collect()
    return np.array([tuple(row) for row in rows])


@pytest.mark.parametrize("order", [0, 1, 4])
def test_discs_over_poles_and_longitude_zero(spark, order):
    draw = random.Random(order)
    discs = [(0, 0.0, 0.0, 1.0, 0.3), (1, 0.0, 0.0, -1.0, 1.2), (2, 1.0, 0.0, 0.0, 0.7), (3, 0.0, 1.0, 0.0, 4.0), (4, 0.0, 0.0, 1.0, 0.0), (5, 1.0, 0.0, 0.0, -1.0), (6, -1.0, 0.0, 0.0, None)]
    for i in range(7, 47):
        v = np.array([draw.gauss(0, 1) for _ in range(3)])
        discs.append((i, *map(float, v / np.linalg.norm(v)), draw.choice([0.02, 0.2, 1.0, 2.9])))
    table = spark.createDataFrame(discs, "disc_id int, cx double, cy double, cz double, radius double")
    found = {i: [] for i, *_ in discs}
    for row in rings.disc_ring_ranges(table, order).collect():
        assert row["lo"] < row["hi"]
        found[row["disc_id"]] += range(row["lo"], row["hi"])
    places = centres(spark, order)
    for i, x, y, z, radius in discs:
        inside = [] if radius is None or radius < 0 else np.flatnonzero(np.arccos(np.clip(places @ np.array([x, y, z]), -1, 1)) <= radius).tolist()
        assert sorted(found[i]) == inside


def test_strips(spark):
    draw = random.Random(5)
    strips = [(0, -1.0, 4.0), (1, 0.0, math.pi), (2, 1.0, 1.0001), (3, 2.0, 1.0), (4, -0.5, 0.6), (5, 2.5, 3.5), (6, 3.0, 0.1)]
    strips += [(i, draw.uniform(0, math.pi), draw.uniform(0, math.pi)) for i in range(7, 40)]
    table = spark.createDataFrame(strips, "strip_id int, theta1 double, theta2 double")
    for order in (0, 3):
        found = {i: [] for i, *_ in strips}
        for row in rings.strip_ring_ranges(table, order).collect():
            found[row["strip_id"]] += range(row["lo"], row["hi"])
        z = centres(spark, order)[:, 2]
        for i, a, b in strips:
            above = (z < math.cos(max(a, 0.0))) | (a < 0)
            below = (z > math.cos(min(b, math.pi))) | (b > math.pi)
            assert sorted(found[i]) == np.flatnonzero(above & below if a < b else above | below).tolist()


def test_cell_histogram_meets_no_pairs(spark):
    draw = random.Random(6)
    left, right = (
        spark.createDataFrame([(pix, float(draw.randint(1, 9))) for pix in draw.sample(range(npix(3)), count)], "pix_ring bigint, weight double") for count in (60, 300)
    )
    bins = make_bins(5, 3.137, 40.731)
    found = rings.cell_histogram_by_ranges(left, right, 3, bins)
    expected = paircount.cell_histogram(left, right, 3, bins)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.collect()))
    empty = rings.cell_histogram_by_ranges(left.where("weight < 0"), right, 3, bins)
    assert sorted(map(tuple, empty.collect())) == [(i, 0.0, 0) for i in range(5)]


def test_range_sums_with_overlaps_and_strange_values(spark):
    values = [(pix, float(pix % 7)) for pix in range(0, 768, 2)] + [(101, float("nan")), (103, float("inf")), (105, None)]
    cells = spark.createDataFrame(values, "pix bigint, value double").repartition(3)
    draw, shift = random.Random(7), 2 * (29 - 3)
    ranges = [(draw.randint(1, 3), a, a + draw.randint(0, 90)) for a in [draw.randrange(0, 668) for _ in range(60)]]
    table = spark.createDataFrame([(s, a << shift, b << shift) for s, a, b in ranges], "set_id int, lo bigint, hi bigint")
    found = {(row["set_id"], row["lo"] >> shift, row["hi"] >> shift): (row["cells"], row["total"]) for row in coverage.range_sums(table, cells, 3).collect()}
    known = dict(values)
    assert set(found) == {one for one in ranges if one[1] < one[2]}
    for (_, a, b), (count, total) in found.items():
        inside = [known[pix] or 0.0 for pix in range(a, b) if pix in known]
        assert count == len(inside)
        assert math.isnan(total) if any(not math.isfinite(x) for x in inside) else total == sum(inside)


def test_a_long_range_is_two_look_ups(spark):
    cells = spark.range(3000).select(F.col("id").alias("pix"), F.lit(1.0).alias("value"))
    whole = spark.createDataFrame([(1, 0, npix(29)), (2, 0, 0)], "set_id int, lo bigint, hi bigint")
    found = coverage.weighted_sum(whole, cells, 6)
    assert [tuple(row) for row in found.collect()] == [(1, 3000.0)]

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skylattice.functions.cells import with_centre
from skylattice.operators import cellwalk as W
from skylattice.operators import region_tables as T

STEPS = pa.list_(pa.struct([("op", pa.int32()), *[(k, pa.float64()) for k in "xyzvw"]]))


def sphere(n, seed):
    v = np.random.default_rng(seed).normal(size=(n, 3))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def cap(centre, radius):
    return {"op": 0, "x": float(centre[0]), "y": float(centre[1]), "z": float(centre[2]), "v": radius, "w": math.cos(radius)}


def in_cell(n, top, pix, seed=1):
    """Points all over one cell."""
    width = 2 * (W.FINE - top)
    fine = np.sort((pix << width) + np.random.default_rng(seed).integers(0, 1 << width, n))
    return W.Cells(top, pix, fine, W.centres(W.FINE, fine))


def star(pole, size, corners):
    east = np.cross([0.1, 0.2, 1.0], pole)
    east /= np.linalg.norm(east)
    turn, reach = 2 * np.pi * np.arange(corners) / corners, np.where(np.arange(corners) % 2, 0.4 * size, size)
    found = pole + np.tan(reach)[:, None] * (np.cos(turn)[:, None] * east + np.sin(turn)[:, None] * np.cross(pole, east))
    return (found / np.linalg.norm(found, axis=1, keepdims=True)).ravel()


@pytest.mark.parametrize("kind", ["expressions", "polygons"])
def test_only_points_near_a_border_are_compared(monkeypatch, kind):
    """At a fixed order of cells, as before, the points compared grew with all points; now they grow with the border."""
    middle, share = np.array(W.centres(2, np.array([70]))).ravel(), []
    around = middle + 0.15 * sphere(40, 5)
    around /= np.linalg.norm(around, axis=1, keepdims=True)
    for n in (5_000, 80_000):
        cells, compared, found = in_cell(n, 2, 70), [], 0
        if kind == "expressions":
            batch, make = pa.RecordBatch.from_arrays([pa.array([[cap(v, 0.15)] for v in around], STEPS)], ["w0"]), W.Expressions
        else:
            corners = pa.RecordBatch.from_arrays([pa.array([star(v, 0.2, 8) for v in around]), pa.array([None] * 40, pa.bool_())], ["w0", "w1"])
            sent = next(W._dealing(W.Polygons, 2, 0, True)(iter([corners])))
            batch, make = sent.filter(pa.array(np.asarray(sent.column("_pix")) == 70)), W.Polygons
        settle = make.settle
        with monkeypatch.context() as patched:
            patched.setattr(make, "settle", lambda self, pair, point, *rest: compared.append(len(point)) or settle(self, pair, point, *rest))
            for _, _, size, _ in W.met(make(batch), cells):
                found += int(size.sum())
        share.append(sum(compared) / found)
    assert share[1] < 0.4 * share[0] and share[1] < 0.15


def test_a_crowd_in_one_place():
    """Cells are not cut without end, and many points of one cell are compared in pieces."""
    place = W.centres(W.FINE, np.array([12345678901]))
    fine = np.full(300_000, 12345678901)
    cells = W.Cells(2, 12345678901 >> (2 * (W.FINE - 2)), fine, tuple(np.repeat(part, 300_000) for part in place))
    at = np.array(place).ravel()
    batch = pa.RecordBatch.from_arrays([pa.array([[cap(at, 1e-9)], [cap(at, 0.0)], [cap(at, 0.2)], [cap(-at, 0.2)]], STEPS)], ["w0"])
    sizes = np.zeros(4, np.int64)
    for row, _, size, _ in W.met(W.Expressions(batch), cells):
        np.add.at(sizes, row, size)
    inside = [float(at @ at) > math.cos(radius) for radius in (1e-9, 0.0, 0.2)]
    assert list(sizes) == [300_000 * yes for yes in inside] + [0] and sizes[2] == 300_000


def test_batches_are_of_bounded_size(monkeypatch):
    monkeypatch.setattr(W, "_ROWS", 100)
    cells = in_cell(5000, 3, 5)
    middle = np.array(W.centres(3, np.array([5]))).ravel()
    batch = pa.RecordBatch.from_arrays([pa.array([[cap(middle, 0.05)], [cap(middle, 0.02)], [cap(middle, 0.03)]], STEPS)], ["w0"])
    parts = list(W._rows(W.met(W.Expressions(batch), cells), [pa.array(np.arange(5000))], False))
    got = [(int(r), int(p)) for row, (points,) in parts for r, p in zip(row, points.to_pylist(), strict=True)]
    cosine = np.stack(cells.at, axis=1) @ middle
    assert len(parts) > 10 and sorted(got) == [(r, int(p)) for r, radius in enumerate((0.05, 0.02, 0.03)) for p in np.flatnonzero(cosine > math.cos(radius))]


@pytest.mark.parametrize("order", [0, 3, 11])
def test_centres(spark, order):
    pix = np.unique(np.random.default_rng(2).integers(0, 12 << (2 * order), 500))
    rows = with_centre(spark.createDataFrame([(int(p),) for p in pix], "pix_nest bigint"), order).orderBy("pix_nest").select("x", "y", "z").collect()
    assert np.allclose(np.array(rows), np.stack(W.centres(order, pix), axis=1), atol=1e-15)


def test_rows_that_come_twice_and_columns_that_are_wanted(spark):
    data = spark.createDataFrame([(1, 1.0, 0.0, 0.0, "a"), (1, 1.0, 0.0, 0.0, "a"), (None, 1.0, 0.0, 0.0, None), (3, None, 0.0, 0.0, "b")], "id int, x double, y double, z double, `l 0` string")
    table = spark.createDataFrame([(k, [("cap", 1.0, 0.0, 0.0, 0.1)]) for k in (7, 7, None)], f"region_id int, steps array<{T.STEP_TYPE}>")
    found = T.points_in_expressions(data, table, 4, columns=["l 0", "id"])
    assert found.columns == ["region_id", "l 0", "id"]
    counts = {tuple(row)[:3]: row["count"] for row in found.groupBy(*found.columns).count().collect()}
    assert counts == {(7, "a", 1): 4, (7, None, None): 2, (None, "a", 1): 2, (None, None, None): 1}
    assert T.points_in_expressions(data, table, 4).columns == ["region_id", *data.columns]


def test_crowds_on_both_sides_are_cut(spark):
    """Parts of the points and strips of the regions meet in groups, each pair once."""
    points = spark.range(3000).selectExpr("id", "1D AS x", "id * 1e-6D AS y", "0D AS z")
    placed = W.placed(points, 2, ["id"])
    balls = W.dealt(points, W.balls(0.1, 0.01), 2, ["id"], [F.col(v) for v in "xyz"])
    cut = W.groups(placed, balls, 100).collect()
    assert max(row._parts for row in cut) == 30 and max(row._strips for row in cut) == 30
    found = W.met_rows(placed, balls, W.balls(0.1, 0.01), 2, 100, 8, valued=True, strips=True).toDF("a", "b", "d2")
    assert found.groupBy("a", "b").count().groupBy("count").count().collect() == [(1, 9_000_000)]


@pytest.mark.parametrize("radius", [1e-4, 0.3, 3.2])
def test_walked_pairs_are_all_pairs(spark, radius):
    from skylattice.operators.proximity import within_radius

    def table(n, seed):
        at = np.vstack([sphere(n, seed), sphere(n, seed + 1) * 1e-4 + [0.0, 0.6, 0.8]])
        at = at / np.linalg.norm(at, axis=1, keepdims=True)
        rows = [(i, *map(float, v), f"n{i % 5}") for i, v in enumerate(at)] + [(-1, None, 0.0, 1.0, "none"), (-2, math.nan, 0.0, 1.0, "none")]
        return spark.createDataFrame(rows, "id int, x double, y double, z double, `the name` string")

    a, b = table(150, 3), table(120, 5)
    walked, plain = (within_radius(a, b, radius, hot, walk=walk) for hot, walk in ((20, True), (None, False)))
    assert walked.columns == plain.columns
    assert sorted(map(tuple, walked.collect())) == sorted(map(tuple, plain.collect())) != []
    few = within_radius(a, b, radius, walk=True, columns=["the name", "id"])
    assert few.columns == ["a_the name", "a_id", "b_the name", "b_id", "d2"] and few.count() == plain.count()
    assert within_radius(a, b, radius, columns=["id"]).columns == ["a_id", "b_id", "d2"]


def test_few_copies_are_sent(spark):
    """Rows that meet at 3 degrees: before, 6.8 and 2.7 copies of the two sides at 60 times sf0.1, where cubes hold more than 2,000 rows."""
    at = spark.createDataFrame([tuple(map(float, v)) for v in sphere(20_000, 9)], "x double, y double, z double")
    sent = W.dealt(at, W.balls(math.radians(3.0), 0.003), 2, ["x"], [F.col(v) for v in "xyz"])
    placed = W.placed(at, 2, ["x"])
    assert sent.count() < 3 * 20_000
    assert {(row._parts, row._strips) for row in W.groups(placed, sent, 20).collect()} == {(1, 1)}


def test_rounding_through_whole_numbers_is_rounding(spark):
    from skyqueries.fixtures import rounded, rounded_often

    values = np.concatenate([np.random.default_rng(4).uniform(0, 0.003, 20_000), (np.arange(2000) + 0.5) * 1e-9, np.arange(2000) * 1e-9, [-0.0, -1e-12, -2.5e-9, 5e3, -5e3, 1e300]])
    rows = spark.createDataFrame([(float(v),) for v in values] + [(None,), (math.nan,), (math.inf,)], "d2 double")
    assert rows.where(~rounded("d2", 9).eqNullSafe(rounded_often("d2", 9))).collect() == []

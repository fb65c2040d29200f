import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from skylattice.operators import region_tables as T
from skylattice.operators import regions as R
from skylattice.operators.regions import Cap, Polygon, Strip, vector


def points(spark, n, seed=3, around=None, spread=1.0):
    v = np.random.default_rng(seed).normal(size=(n, 3)) * spread
    v = v if around is None else v + np.array(around)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(v)], "id int, x double, y double, z double")


def star(theta, phi, size, corners, turn=0.0):
    """Alternating long and short arms around a direction."""
    pole = np.array(vector(theta, phi))
    east = np.cross([0.1, 0.2, 1.0], pole)
    east /= np.linalg.norm(east)
    north = np.cross(pole, east)
    found = []
    for k in range(corners):
        r = size * (1.0 if k % 2 == 0 else 0.4)
        a = turn + 2 * math.pi * k / corners
        found.append(tuple(float(part) for part in pole + math.tan(r) * (math.cos(a) * east + math.sin(a) * north)))
    return tuple(found)


SHAPES = {
    1: star(0.8, 1.0, 0.5, 10), 2: star(0.0, 0.0, 0.6, 8, 0.3), 3: star(math.pi, 0.0, 1.2, 6), 4: star(1.5, 6.28, 0.02, 40),
    5: star(1.2, 1.3, 1.5, 4, 0.1), 6: star(0.9, 1.1, 0.4, 300), 7: star(2.0, 4.0, 1e-4, 5),
    # Repeated vertices make no edge; one cell of the coarsest order holds this one.
    8: tuple(v for v in star(0.8, 0.9, 0.1, 6) for _ in range(2)),
}


def polygons(spark, shapes):
    return spark.createDataFrame([(k, [tuple(v) for v in shape]) for k, shape in shapes.items()], f"polygon_id int, vertices array<{T._POINT}>")


@pytest.mark.parametrize("order", [0, 4, 7])
def test_points_in_polygons_equal_the_crossing_rule(spark, order):
    data = points(spark, 4000).unionByName(points(spark, 1500, 5, vector(0.8, 1.0), 0.3)).unionByName(points(spark, 500, 6, vector(1.5, 6.28), 0.02))
    data = data.unionByName(points(spark, 300, 7, vector(2.0, 4.0), 1e-4)).withColumn("id", F.monotonically_increasing_id())
    shapes = SHAPES if order else {k: SHAPES[k] for k in (1, 3, 5, 8)}
    found = sorted((row.polygon_id, row.id) for row in T.points_in_polygons(data, polygons(spark, shapes), order).collect())
    expected = sorted((k, row.id) for k, shape in shapes.items() for row in R.points_in_region(data, Polygon(shape)).collect())
    assert found == expected and {k for k, _ in found} == set(shapes)


def test_the_index_stays_narrow(spark):
    """Cells carry the edges they touch, and whole cells stay coarse."""
    rows = T.polygon_cells(polygons(spark, {6: SHAPES[6]}), 7).selectExpr("`order`", "inside", "size(edges) AS n").collect()
    assert all(row.inside for row in rows if row.order < 7) and all(row.n == 0 for row in rows if row.order < 7)
    assert min(row.order for row in rows) < 7 and sum(row.n for row in rows) < 40 * len(rows)


def test_crowded_cells_are_split(spark):
    one = vector(0.8, 1.0)
    data = spark.createDataFrame([(i, *one) for i in range(500)], "id int, x double, y double, z double").unionByName(points(spark, 500, 8, one, 1e-3))
    found = T.points_in_polygons(data, polygons(spark, SHAPES), 6, hot_rows=20)
    assert found.groupBy("polygon_id").count().where("polygon_id = 1").head()["count"] == 1000


def test_malformed_polygons(spark):
    far = (vector(1.0, 0.0), vector(1.0, 2.1), vector(1.0, 4.2), vector(3.0, 1.0))
    rows = [(1, list(SHAPES[1])), (2, None), (3, list(SHAPES[1][:2])), (4, [SHAPES[1][0]] * 5), (5, list(far)), (6, [(0.0, 0.0, 0.0), *SHAPES[1]]), (7, [None, *SHAPES[1]])]
    table = spark.createDataFrame(rows, f"polygon_id int, vertices array<{T._POINT}>")
    bad = {row.polygon_id: row.problem for row in table.select("polygon_id", T.polygon_problem(F.col("vertices")).alias("problem")).collect()}
    assert [k for k in bad if bad[k] is None] == [1]
    assert bad[2] == "no vertices" and "three" in bad[3] and "three" in bad[4] and "hemisphere" in bad[5] and "direction" in bad[6] and "direction" in bad[7]
    with pytest.raises(PySparkException, match="polygon 5: polygon does not fit"):
        T.points_in_polygons(points(spark, 10), table.where("polygon_id = 5"), 3).collect()


def test_empty_tables_and_odd_points(spark):
    none = polygons(spark, SHAPES).where("false")
    assert T.points_in_polygons(points(spark, 10), none, 3).count() == 0
    assert T.points_in_polygons(points(spark, 10).where("false"), polygons(spark, SHAPES), 3).count() == 0
    odd = spark.createDataFrame([(None, None, None, "n"), (*vector(0.8, 1.0), "y")], "x double, y double, z double, `_p.q` string")
    assert [row["_p.q"] for row in T.points_in_polygons(odd, polygons(spark, {1: SHAPES[1]}), 3).collect()] == ["y"]


def cap(theta, phi, radius):
    return ("cap", *vector(theta, phi), radius)


def strip(low, high):
    return ("strip", low, high, None, None)


def plain(op):
    return (op, None, None, None, None)


A, B, C = (0.8, 1.0, 0.5), (0.9, 1.3, 0.4), (2.0, 4.0, 2.0)
EXPRESSIONS = {
    1: ([cap(*A)], Cap(vector(*A[:2]), A[2])),
    2: ([cap(*A), cap(*B), plain("xor"), strip(0.7, 0.9), plain("not"), plain("and")], (Cap(vector(*A[:2]), A[2]) ^ Cap(vector(*B[:2]), B[2])) & ~Strip(0.7, 0.9)),
    3: ([cap(*C), plain("not")], ~Cap(vector(*C[:2]), C[2])),
    4: ([strip(2.8, 0.2)], Strip(2.8, 0.2)),
    5: ([strip(0.0, 0.3), cap(*A), cap(*B), plain("and"), plain("or")], Strip(0.0, 0.3) | (Cap(vector(*A[:2]), A[2]) & Cap(vector(*B[:2]), B[2]))),
    6: ([cap(0.3, 0.2, 4.0)], None),
}


def regions(spark, rows):
    return spark.createDataFrame(rows, f"region_id int, steps array<{T.STEP_TYPE}>")


def test_expressions_equal_regions(spark):
    data = points(spark, 5000)
    table = regions(spark, [(k, steps) for k, (steps, _) in EXPRESSIONS.items()])
    found = sorted((row.region_id, row.id) for row in T.points_in_expressions(data, table, 4).collect() if row.region_id != 6)
    assert found == sorted((k, row.id) for k, (_, region) in EXPRESSIONS.items() if region for row in R.points_in_region(data, region).collect())
    for finest in (None, 5):
        cells = {(row.region_id, row.pix_nest) for row in R.at_order(T.expression_cells(table, 4, finest), 4).collect() if row.region_id != 6}
        assert cells == {(k, row.pix_nest) for k, (_, region) in EXPRESSIONS.items() if region for row in R.at_order(R.region_cells(spark, region, 4, finest), 4).collect()}


def test_malformed_expressions(spark):
    rows = [
        (1, EXPRESSIONS[2][0]), (2, None), (3, []), (4, [plain("and")]), (5, [cap(*A), cap(*B)]), (6, [cap(*A), plain("nor")]), (7, [("cap", 1.0, None, 0.0, 0.1)]),
        (8, [cap(*A), plain("or"), cap(*B)]), (9, [None]),
    ]
    bad = {row.region_id: row.problem for row in regions(spark, rows).select("region_id", T.expression_problem(F.col("steps")).alias("problem")).collect()}
    assert [k for k in bad if bad[k] is None] == [1] and bad[5] == "operands are left over" and bad[8] == "a step lacks operands" and bad[9] == "unknown step"
    with pytest.raises(PySparkException, match="region 4: a step lacks operands"):
        T.points_in_expressions(points(spark, 10), regions(spark, rows[3:4]), 3).collect()


@pytest.mark.parametrize("search", ["polygons", "expressions"])
def test_points_do_not_go_through_the_driver(spark, search):
    # Of a range the optimizer knows the size, and that it is small.
    points = spark.range(3).selectExpr("id", "IF(id = 0, 1D, IF(id = 1, 0D, 0.6D)) AS x", "IF(id = 1, 1D, 0D) AS y", "IF(id = 2, 0.8D, 0D) AS z")
    if search == "polygons":
        corner = "struct(1D AS x, {}D AS y, {}D AS z)"
        regions = spark.range(1).selectExpr("id AS polygon_id", f"array({corner.format(-0.1, -0.1)}, {corner.format(0.1, -0.1)}, {corner.format(0.0, 0.2)}) AS vertices")
        found = T.points_in_polygons(points, regions, order=3)
    else:
        regions = spark.range(1).selectExpr("id AS region_id", "array(struct('cap' AS op, 1D AS x, 0D AS y, 0D AS z, 0.2D AS radius)) AS steps")
        found = T.points_in_expressions(points, regions, order=3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line and "_part" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)
    assert [row.id for row in found.collect()] == [0]

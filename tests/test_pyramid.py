"""The count pyramid against the join that meets every pair."""

import pytest
from pyspark.sql import functions as F

from skylattice.functions.bins import bins_from_edges, make_bins
from skylattice.operators import paircount, pyramid
from tests.test_pairs import frame, sphere


def tagged(spark, n, seed, clump=0):
    points = None
    for is_random in (0, 1):
        rows = frame(spark, sphere(n + 40 * is_random, seed + is_random, clump), copies=1 + is_random)
        rows = paircount.as_points(rows, bool(is_random), (F.col("id") % 3).cast("int"))
        points = rows if points is None else points.unionByName(rows)
    return points


def compared(found, expected):
    rows = [sorted(map(tuple, df.select("kind", "bin", "region_1", "region_2", "weighted", "pairs").collect())) for df in (found, expected)]
    assert rows[0] == rows[1] and rows[0]


@pytest.mark.parametrize(
    "bins,upper_closed",
    [(make_bins(6, 2.0, 40.0), False), (make_bins(4, 0.0, 180.0, "linear"), False), (make_bins(5, 0.0, 30.0, "linear"), True), (bins_from_edges([0.001, 0.02, 1, 170]), False)],
)
def test_equals_all_pairs(spark, bins, upper_closed):
    points = tagged(spark, 160, 20, clump=60)
    found = pyramid.pyramid_sums(points, bins, upper_closed, leaf_rows=3)
    compared(found.sums, paircount.pair_sums(points, bins, upper_closed))
    data, random = (points.where(f"is_random = {i}").count() for i in (0, 1))
    assert found.account.agg(F.sum("pairs")).head()[0] == data * data + random * random + data * random
    assert {row["how"] for row in found.account.collect()} <= {"outside", "counted", "points"}


def test_only_some_kinds(spark):
    points, bins = tagged(spark, 90, 30), make_bins(5, 1.0, 60.0)
    for kinds in (("dd",), ("dr",), ("dd", "rr")):
        compared(pyramid.pyramid_sums(points, bins, kinds=kinds, leaf_rows=4).sums, paircount.pair_sums(points, bins).where(F.col("kind").isin(list(kinds))))


def test_a_crowd_is_split_below_the_order_of_the_leaves(spark):
    rows = frame(spark, sphere(1500, 40, clump=1200))
    points = paircount.as_points(rows)
    nodes, leaves = pyramid.count_tree(points, 20, 1)
    assert nodes.where("leaf").agg(F.max("rows")).head()[0] <= 20 and leaves.count() == 1500
    assert nodes.where("leaf").agg(F.sum("n")).head()[0] == 1500 == nodes.where("node < 64 AND node >= 16").agg(F.sum("n")).head()[0]
    bins = make_bins(4, 5.0, 90.0)
    found = pyramid.pyramid_sums(points, bins, leaf_rows=20)
    compared(found.sums, paircount.pair_sums(points, bins))
    # The crowd's own pairs lie outside the bins: they are dismissed as nodes.
    account = {row["how"]: row["pairs"] for row in found.account.collect()}
    assert account["outside"] > 1200 * 1200 * 0.9 and account.get("points", 0) < 0.1 * 1500 * 1500


def test_work_grows_slower_than_pairs(spark):
    bins, work = make_bins(3, 20.0, 90.0), []
    for n in (4000, 16_000):
        account = pyramid.pyramid_sums(paircount.as_points(frame(spark, sphere(n, 50))), bins, leaf_rows=16).account
        rows = {row["how"]: (row["node_pairs"], row["pairs"]) for row in account.collect()}
        assert sum(pairs for _, pairs in rows.values()) == n * n
        work.append(sum(nodes for nodes, _ in rows.values()) + rows["points"][1])
    assert work[1] < 10 * work[0] < 10 * 0.6 * 4000 * 4000  # all pairs would be 16 times as many


def test_empty_and_single(spark):
    none = paircount.as_points(frame(spark, sphere(4, 60))).where("x > 5")
    bins = make_bins(3, 0.0, 20.0, "linear")
    assert [tuple(row) for row in pyramid.pyramid_auto(none, bins).orderBy("bin").collect()] == [(i, 0.0, 0) for i in range(3)]
    one = frame(spark, sphere(4, 60)).where("id = 3")
    assert [row["pairs"] for row in pyramid.pyramid_auto(one, bins).orderBy("bin").collect()] == [1, 0, 0]
    left, right = frame(spark, sphere(50, 61)), frame(spark, sphere(70, 62), copies=2)
    found, expected = (sorted(map(tuple, f(left, right, bins).collect())) for f in (pyramid.pyramid_cross, paircount.cross_histogram))
    assert found == expected


def test_near_pairs_travel_as_blocks_and_not_as_points(spark):
    """Open leaf pairs carry lists of partners: no join makes a row for each pair of points, and no node is opened for a few points."""
    points, bins = paircount.as_points(frame(spark, sphere(3000, 70))), make_bins(6, 5.0, 40.0)
    found = pyramid.pyramid_sums(points, bins)
    account = {row["how"]: row["node_pairs"] for row in found.account.collect()}
    assert sum(account.values()) < 3000
    plan = found.sums._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroup" in plan
    compared(found.sums, paircount.pair_sums(points, bins))


def test_weights_of_every_kind(spark):
    """NULL and many different weights, and points without a position, against plain sums; no row for a bin without pairs."""
    import numpy as np

    v, rng = sphere(700, 71), np.random.default_rng(72)
    weights = [None if i % 50 == 0 else float(rng.uniform(0.5, 2.0)) for i in range(700)]
    rows = [(*map(float, p), w, 0, int(i % 3)) for i, (p, w) in enumerate(zip(v, weights))] + [(None, None, None, 1.0, 0, 0), (float("nan"), 0.0, 0.0, 1.0, 0, 1)]
    points = spark.createDataFrame(rows, "x double, y double, z double, weight double, is_random int, region int")
    bins = make_bins(5, 0.0, 50.0, "linear")
    d2 = ((v[:, None, 0] - v[None, :, 0]) ** 2 + (v[:, None, 1] - v[None, :, 1]) ** 2) + (v[:, None, 2] - v[None, :, 2]) ** 2
    at, w, expected = np.searchsorted(bins.edges2, d2, "right") - 1, np.array([0.0 if w is None else w for w in weights]), {}
    for i, j in zip(*np.nonzero(at < 5)):
        key = (int(at[i, j]), min(i % 3, j % 3), max(i % 3, j % 3))
        one = expected.setdefault(key, [0.0, 0])
        one[0] += w[i] * w[j]
        one[1] += 1
    for extra in (0, 1):  # a row without a position is a pair with itself
        expected[(0, extra, extra)][0] += 1.0
        expected[(0, extra, extra)][1] += 1
    for hot_rows in (100, 250_000):
        found = {(r.bin, r.region_1, r.region_2): (r.weighted, r.pairs) for r in paircount.pair_sums(points, bins, hot_rows=hot_rows).collect()}
        assert {key: value[1] for key, value in found.items()} == {key: value[1] for key, value in expected.items()}
        assert {key: value[0] for key, value in found.items()} == {key: pytest.approx(value[0]) for key, value in expected.items()}

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skylattice.functions.bins import Bins, bins_from_edges, make_bins
from skylattice.operators import correlation, match, paircount
from skylattice.operators.proximity import within_radius

RADIUS = math.radians(4.0)


def sphere(n, seed, clump=0):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, 3))
    if clump:
        v[:clump] = np.array([0.3, 0.2, 0.9]) + 0.01 * rng.normal(size=(clump, 3))
    v[-3:] = [[0, 0, 1], [0, 0, -1], [1, 0, 0]]
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def frame(spark, v, weight=None, copies=1):
    rows = [(i + k * 100000, *map(float, p), float(1 + i % 3 if weight is None else weight[i]))
            for k in range(copies) for i, p in enumerate(v)]
    return spark.createDataFrame(rows, "id long, x double, y double, z double, weight double")


def chord2(a, b):
    return ((a[:, None, :] - b[None, :, :]) ** 2).sum(-1)


@pytest.mark.parametrize("hot_rows", [None, 5, 20000])
@pytest.mark.parametrize("radius", [1e-7, RADIUS, 1.0, math.pi])
def test_within_radius(spark, radius, hot_rows):
    a, b = sphere(150, 1, clump=40), sphere(120, 2, clump=50)
    d2 = chord2(a, b)
    expected = {(i, j) for i, j in zip(*np.nonzero(d2 < (2 * math.sin(radius / 2)) ** 2))}
    pairs = within_radius(frame(spark, a), frame(spark, b), radius, hot_rows)
    found = [(row.a_id, row.b_id) for row in pairs.select("a_id", "b_id").collect()]
    assert len(found) == len(set(found))
    assert set(found) == expected


def _field(rng, n, width):
    """Separate positions around one direction, unevenly dense."""
    v = np.array([0.3, 0.2, 0.9]) + rng.normal(size=(n, 3)) * width * rng.uniform(0.02, 1.0, size=(n, 1))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def test_crowded_field_is_matched_in_rounds(spark, monkeypatch):
    """20,000 x and 20,000 y within one radius: equal to all pairs, at a small share of their number."""
    rng, n, arcsec = np.random.default_rng(11), 20_000, math.radians(1.0 / 3600.0)
    a, b = (np.concatenate([_field(rng, n, 0.15 * arcsec), sphere(300, seed)]) for seed in (21, 22))
    b[-100:] = a[-100:]
    limit = (2 * math.sin(arcsec / 2)) ** 2
    chosen = {}
    for start in range(0, len(b), 500):
        d2 = sum((b[start : start + 500, None, k] - a[None, :, k]) ** 2 for k in range(3))
        for j, i in enumerate(d2.argmin(axis=1)):
            if d2[j, i] < limit:
                chosen[int(i)] = min(chosen.get(int(i), (9.0, 0)), (float(d2[j, i]), start + j))
    met, plain = [], match._meetings

    def counted(*args):
        pairs = plain(*args)
        met.append(pairs.count())
        return pairs

    monkeypatch.setattr(match, "_meetings", counted)
    found = match.crossmatch(frame(spark, a), frame(spark, b), 1.0)
    assert {(row.x_id, row.y_id) for row in found.collect()} == {(i, j) for i, (_, j) in chosen.items()}
    assert len(met) > 2 and sum(met) < n * n / 50


def nearest(a, b, limit):
    d2 = chord2(b, a)
    chosen = {}
    for j in range(len(b)):
        i = min(range(len(a)), key=lambda i: (d2[j, i], i))
        if d2[j, i] < limit:
            best = chosen.get(i)
            if best is None or (d2[j, i], j) < best:
                chosen[i] = (d2[j, i], j)
    return {(i, j) for i, (_, j) in chosen.items()}


@pytest.mark.parametrize("hot_rows, crowd", [(4, 2000), (20000, 2000), (4, 5), (None, 1)])
def test_crossmatch_with_copies_and_clump(spark, hot_rows, crowd):
    a, b = sphere(200, 5, clump=60), sphere(250, 6, clump=80)
    limit = (2 * math.sin(RADIUS / 2)) ** 2
    expected = nearest(a, b, limit)
    found = match.crossmatch(frame(spark, a, copies=3), frame(spark, b, copies=2), 4.0 * 3600, hot_rows=hot_rows, crowd=crowd)
    assert {(row.x_id, row.y_id) for row in found.collect()} == expected
    assert found.where("sep_rel < 0 OR sep_rel >= 1").count() == 0


def test_crossmatch_of_nothing(spark):
    empty = frame(spark, sphere(10, 1)).where("id < 0")
    assert match.crossmatch(empty, frame(spark, sphere(10, 1)), 3600.0).count() == 0
    compared = match.compare_matches(*[spark.createDataFrame([], "x_id long, y_id long")] * 2).first()
    assert (compared.n_mine, compared.n_joined, compared.sum_diff) == (0, 0, 0)


def histogram(d2, w, bins: Bins, closed=False):
    edges = np.array(bins.edges2)
    index = np.searchsorted(edges, d2, side="left" if closed else "right") - 1
    ok = (index >= 0) & (index < bins.count)
    return np.bincount(index[ok], weights=w[ok], minlength=bins.count)


@pytest.mark.parametrize("hot_rows", [6, 4000])
@pytest.mark.parametrize("first", [0.0, 3.0])
def test_pair_sums(spark, first, hot_rows):
    bins = make_bins(5, first, 40.0, "linear")
    data, random = sphere(90, 8, clump=30), sphere(130, 9)
    wd, wr = (1.0 + np.arange(len(v)) % 3 for v in (data, random))
    points = paircount.as_points(frame(spark, data, copies=2), False).unionByName(paircount.as_points(frame(spark, random), True))
    sums = paircount.pair_sums(points, bins, hot_rows=hot_rows)
    found = {(row.kind, row.bin): row.weighted for row in sums.collect()}
    twice, wt = np.concatenate([data, data]), np.concatenate([wd, wd])
    for kind, (a, p), (b, q) in (("dd", (twice, wt), (twice, wt)), ("dr", (twice, wt), (random, wr)), ("rr", (random, wr), (random, wr))):
        expected = histogram(chord2(a, b), np.outer(p, q), bins)
        assert [found.get((kind, i), 0.0) for i in range(5)] == pytest.approx(list(expected), abs=1e-9)


def test_closed_edges_and_ladder(spark):
    bins = bins_from_edges([10.0, 20.0, 30.0])
    e = bins.edges2
    rows = spark.createDataFrame([(v,) for v in (e[0], e[1], e[2], 0.0, 3.9)], "d2 double")
    found = rows.select(bins.of_chord2(F.col("d2")), bins.of_chord2(F.col("d2"), True)).collect()
    assert [tuple(row) for row in found] == [(0, None), (1, 0), (None, 1), (None, None), (None, None)]


def test_custom_scale():
    bins = make_bins(4, 1.0, 16.0, (lambda deg: math.log2(deg), lambda v: 2.0**v))
    assert [round(math.degrees(edge), 9) for edge in bins.edges] == [1.0, 2.0, 4.0, 8.0, 16.0]


def test_leave_one_out_equals_recounting(spark):
    bins = make_bins(4, 5.0, 50.0, "sqrt")
    data, random = sphere(120, 11), sphere(240, 12)
    region = lambda v: ((v[:, 2] > 0) * 2 + (v[:, 0] > 0)).astype(int)
    rd, rr = region(data), region(random)

    def points(v, r, is_random):
        rows = [(*map(float, p), 1.0, is_random, int(k)) for p, k in zip(v, r)]
        return spark.createDataFrame(rows, "x double, y double, z double, weight double, is_random int, region int")

    table = points(data, rd, 0).unionByName(points(random, rr, 1))
    weights = table.groupBy("is_random", "region").agg(F.sum("weight").alias("weight"))
    listed = spark.createDataFrame([(k,) for k in range(5)], "region int")  # region 4 holds nothing
    reals = correlation.realisations(paircount.pair_sums(table, bins), weights, listed, bins)
    found = {(row.region, row.bin): row.xi for row in reals.collect()}
    assert len(found) == 6 * bins.count
    expected = {}
    for k in [None, 0, 1, 2, 3, 4]:
        d, r = data[rd != k] if k is not None else data, random[rr != k] if k is not None else random
        n = len(r) / len(d)
        one = lambda a, b: histogram(chord2(a, b), np.ones((len(a), len(b))), bins)
        xi = (n * n * one(d, d) - 2 * n * one(d, r) + one(r, r)) / one(r, r)
        expected.update({(k, i): xi[i] for i in range(bins.count)})
    assert {key: pytest.approx(value, abs=1e-9) for key, value in expected.items()} == found
    x = np.array([[expected[(k, i)] for i in range(bins.count)] for k in range(5)])
    dev = x - x.mean(0)
    cov = dev.T @ dev * 4 / 5
    rows = correlation.correlation_matrix(correlation.covariance(reals)).collect()
    assert len(rows) == bins.count**2
    for row in rows:
        assert row.cov == pytest.approx(cov[row.bin_i, row.bin_j], abs=1e-9)
        assert row["corr"] == pytest.approx(cov[row.bin_i, row.bin_j] / math.sqrt(cov[row.bin_i, row.bin_i] * cov[row.bin_j, row.bin_j]), abs=1e-7)
    summary = {row.bin: row for row in correlation.estimate(reals).collect()}
    for i in range(bins.count):
        assert summary[i].error == pytest.approx(math.sqrt(cov[i, i]), abs=1e-9)
        assert summary[i].xi_jk_mean == pytest.approx(x[:, i].mean(), abs=1e-9)


def test_undefined_estimates_are_null(spark):
    reals = spark.createDataFrame([(None, 0, 1.0), (0, 0, 1.0), (1, 0, None), (None, 1, 2.0), (0, 1, 2.0), (1, 1, 2.0)], "region int, bin int, xi double")
    assert {row.bin: row.xi_jk_mean for row in correlation.jackknife_mean(reals).collect()} == {0: None, 1: 2.0}
    matrix = {(row.bin_i, row.bin_j): (row.cov, row["corr"]) for row in correlation.correlation_matrix(correlation.covariance(reals)).collect()}
    assert matrix[(0, 0)] == (None, None)
    assert matrix[(1, 1)] == (0.0, None)


def test_key_that_is_hot_on_one_side_is_split(spark):
    """Many rows of one table and few of the other in one cube: the many are dealt in strips, and each pair still meets once."""
    from skylattice.operators.proximity import candidate_sides

    place = lambda n: spark.range(n).selectExpr("id", "1D AS x", "id * 1e-9D AS y", "0D AS z")
    a, b, keys = candidate_sides(place(6000), place(20), 0.01, 200)
    groups = [row["count"] for row in a.groupBy(*keys).count().collect()]
    assert max(groups) < 1200 and sum(groups) == 6000
    assert a.join(b, keys).groupBy("a_id", "b_id").count().groupBy("count").count().collect() == [(1, 120000)]


def test_copies_of_a_hot_key_follow_its_rows(spark):
    """One cube with everything, at a few rows a strip: rows are copied for as many groups as the tasks can use, not for each strip."""
    from skylattice.operators.proximity import candidate_sides

    copies = []
    for n in (2000, 8000):
        left, right = (frame(spark, sphere(n, seed, clump=n)) for seed in (71, 72))
        a, b, _ = candidate_sides(left, right, 1.0, 2)
        copies.append((a.count() + b.count()) / n)
    assert copies[1] < 1.3 * copies[0]  # every strip with every strip would make it four times as much


@pytest.mark.parametrize("crowd", [3, 10**6])
def test_crowded_cells_without_border(spark, crowd):
    """Rounds within a nested cell find what all pairs of the cell give."""
    from skylattice.functions.cells import with_nest

    a, b = (frame(spark, sphere(300, seed, clump=120)) for seed in (81, 82))
    found = match.crossmatch(a, b, 12.0 * 3600, border=False, cell_order=2, crowd=crowd)
    cells = [{row.id: (row.pix_nest, np.array([row.x, row.y, row.z])) for row in with_nest(df, 2, vector=("x", "y", "z")).collect()} for df in (a, b)]
    limit, chosen = (2 * math.sin(math.radians(12.0) / 2)) ** 2, {}
    for j, (cell, at) in cells[1].items():
        near = [(((at - v) ** 2).sum(), i) for i, (other, v) in cells[0].items() if other == cell]
        if near and min(near)[0] < limit:
            d2, i = min(near)
            chosen[i] = min(chosen.get(i, (9.0, 0)), (d2, j))
    assert {(row.x_id, row.y_id) for row in found.collect()} == {(i, j) for i, (_, j) in chosen.items()}


def test_rounds_send_no_side_through_the_driver(spark):
    points = frame(spark, sphere(50, 91)).select("id", "x", "y", "z", F.lit(0).cast("bigint").alias("cell"))
    plan = match._meetings(points, points, 0.1, None)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan

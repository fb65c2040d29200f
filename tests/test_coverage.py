import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skylattice.operators import coverage, ranking
from skylattice.sources.coverage_text import format_coverage, join_pieces, parse_coverage

SKY = coverage.SKY_END


def frame(spark, rows):
    return spark.createDataFrame(rows, "set_id long, lo long, hi long")


def random_ranges(seed, n, order, sets=3):
    rng = random.Random(seed)
    unit, cells = 4 ** (29 - order), 12 * 4**order
    rows = []
    for _ in range(n):
        lo = rng.randrange(cells)
        rows.append((rng.randrange(sets), lo * unit, min(cells, lo + rng.choice([0, 1, 2, 5, cells // 50])) * unit))
    rows += [(0, 0, unit), (1, SKY - unit, SKY), (1, 0, SKY // 2)]
    return rows


def values(rows, order):
    unit = 4 ** (29 - order)
    found = {}
    for set_id, lo, hi in rows:
        found.setdefault(set_id, set()).update(range(lo // unit, hi // unit))
    return found


def ranges_of(found, order):
    unit, out = 4 ** (29 - order), set()
    for set_id, cells in found.items():
        start = None
        for v in sorted(cells):
            if v - 1 not in cells:
                start = v
            if v + 1 not in cells:
                out.add((set_id, start * unit, (v + 1) * unit))
    return out


def rows_of(df):
    rows = [tuple(row) for row in df.select("set_id", "lo", "hi").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("told", [4, 29])
def test_set_algebra(spark, told):
    order = 4
    a, b = random_ranges(1, 150, order), random_ranges(2, 120, order, sets=4)
    va, vb = values(a, order), values(b, order)
    sets = set(va) | set(vb)
    da, db = frame(spark, a), frame(spark, b)
    for operation, combine in ((coverage.union, set.union), (coverage.intersection, set.intersection),
                               (coverage.difference, set.difference), (coverage.symmetric_difference, set.symmetric_difference)):
        expected = {s: combine(va.get(s, set()), vb.get(s, set())) for s in sets}
        assert rows_of(operation(da, db, told)) == ranges_of(expected, order)


def test_blocks_do_not_matter(spark, monkeypatch):
    """Six bits per block: running totals go through several levels, and ranges cross many blocks."""
    monkeypatch.setattr(ranking, "BLOCK_BITS", 6)
    order = 5
    a = random_ranges(3, 200, order)
    assert rows_of(coverage.coalesce(frame(spark, a), order)) == ranges_of(values(a, order), order)


def test_complement_of_everything_and_of_empty(spark):
    rows = frame(spark, [(1, 0, SKY), (2, 5, 5), (3, 0, 10), (4, 10, 20), (4, 20, 30)])
    assert rows_of(coverage.complement(rows)) == {(2, 0, SKY), (3, 10, SKY), (4, 0, 10), (4, 30, SKY)}


def test_single_positions_at_order_29(spark):
    rows = frame(spark, [(1, SKY - 1, SKY), (1, 0, 1), (1, 1, 2), (1, 2**61, 2**61 + 1)])
    merged = coverage.coalesce(rows)
    assert rows_of(merged) == {(1, 0, 2), (1, 2**61, 2**61 + 1), (1, SKY - 1, SKY)}
    cells = coverage.to_uniq(merged)
    assert {(row.order, row.pix) for row in cells.collect()} == {(29, 0), (29, 1), (29, 2**61), (29, SKY - 1)}
    assert rows_of(coverage.from_uniq(cells)) == rows_of(merged)


def test_contains_and_overlaps(spark):
    order = 4
    unit = 4 ** (29 - order)
    a = random_ranges(7, 60, order)
    covered = values(a, order)
    rng = random.Random(9)
    probes = [(rng.randrange(3), k, lo * unit, (lo + rng.choice([1, 2, 9])) * unit) for k in range(200) for lo in [rng.randrange(12 * 4**order - 9)]]
    found = coverage.contains_ranges(frame(spark, a), spark.createDataFrame(probes, "set_id long, probe_id long, lo long, hi long"), order)
    got = {row.probe_id: (row.contains, row.overlaps) for row in found.collect()}
    for set_id, k, lo, hi in probes:
        cells = set(range(lo // unit, hi // unit))
        assert got[k] == (cells <= covered[set_id], bool(cells & covered[set_id]))


def test_set_predicates(spark):
    a, b = frame(spark, [(1, 0, 10), (1, 10, 20), (2, 0, 5)]), frame(spark, [(1, 5, 15), (2, 5, 6), (3, 1, 2)])
    flags = lambda df: {row[0]: row[1] for row in df.collect()}
    assert flags(coverage.contains_set(a, b)) == {1: True, 2: False, 3: False}
    assert flags(coverage.overlaps_set(a, b)) == {1: True, 2: False, 3: False}
    assert flags(coverage.equal_sets(a, frame(spark, [(1, 0, 20), (2, 0, 4)]))) == {1: True, 2: False}


@pytest.mark.parametrize("keep", [True, False])
def test_degrade(spark, keep):
    order, to = 5, 3
    a = random_ranges(4, 80, order)
    expected = {}
    for set_id, cells in values(a, order).items():
        parents = {}
        for v in cells:
            parents[v // 16] = parents.get(v // 16, 0) + 1
        expected[set_id] = {p for p, n in parents.items() if keep or n == 16}
    assert rows_of(coverage.degrade(frame(spark, a), to, keep, order)) == ranges_of(expected, to)


def test_finest_order(spark):
    rows = frame(spark, [(1, 0, 4**29), (2, 0, 1), (3, 4**25, 3 * 4**25), (4, 0, 0)])
    assert {row.set_id: row.max_order for row in coverage.finest_order(rows).collect()} == {1: 0, 2: 29, 3: 4}


@pytest.mark.parametrize("json", [False, True])
def test_text_round_trip(spark, json):
    a = random_ranges(5, 40, 4)
    merged = rows_of(coverage.coalesce(frame(spark, a), 4))
    text = format_coverage(frame(spark, a), json, 4)
    assert rows_of(parse_coverage(text, 4)) == merged
    assert rows_of(parse_coverage(join_pieces(text, json), 4)) == merged


def test_untidy_text(spark):
    texts = spark.createDataFrame([(1, " 1/0 , 3,,2 / 17 - 20  8/"), (2, '{"1" : [0, 3], "2":[17,18,19,20]}'), (3, "5"), (4, "")], "set_id long, text string")
    one = {(0, 4**28), (3 * 4**28, 4**29), (17 * 4**27, 21 * 4**27)}
    found = rows_of(parse_coverage(texts))
    assert {(lo, hi) for s, lo, hi in found if s == 1} == one
    assert {(lo, hi) for s, lo, hi in found if s == 2} == one
    assert {(lo, hi) for s, lo, hi in found if s == 3} == {(5 * 4**29, 6 * 4**29)}
    assert not [s for s, _, _ in found if s == 4]


def test_ascii_format(spark):
    rows = frame(spark, [(1, 0, 4**28), (1, 3 * 4**28, 4**29), (1, 17 * 4**27, 19 * 4**27), (2, 0, SKY)])
    pieces = {(row.set_id, row.order, row.part): row.text for row in format_coverage(rows).collect()}
    assert pieces == {(1, 1, 0): "1/0,3", (1, 2, 0): "2/17-18", (2, 0, 0): "0/0-11"}
    text = {row.set_id: row.text for row in join_pieces(format_coverage(rows)).collect()}
    assert text == {1: "1/0,3 2/17-18", 2: "0/0-11"}


def test_weighted_sum_and_points(spark):
    a = random_ranges(6, 30, 3)
    covered = values(a, 3)
    pixels = spark.range(12 * 4**3).select(F.col("id").alias("pix"), (F.col("id") * 0.5).alias("value"))
    found = {row.set_id: row.total for row in coverage.weighted_sum(frame(spark, a), pixels, 3, 3).collect()}
    assert found == {s: pytest.approx(0.5 * sum(cells)) for s, cells in covered.items()}


def test_prefix_sum_groups_stay_small(spark, monkeypatch):
    monkeypatch.setattr(ranking, "BLOCK_BITS", 5)
    rows = spark.range(3000).select((F.col("id") * 7 % 4096).alias("p"), F.lit(1).cast("long").alias("one")).distinct()
    found = ranking.prefix_sum(rows, [], "p", {"before": "one"}, 12)
    expected = sorted({i * 7 % 4096 for i in range(3000)})
    assert [tuple(row) for row in found.orderBy("p").select("p", "before").collect()] == [(p, i) for i, p in enumerate(expected)]


def test_lookup_orders_are_the_cheapest():
    """Against every way to choose orders; the cells of the registered query become fewer than four keys each."""
    from itertools import combinations

    draw = np.random.default_rng(3)
    for _ in range(60):
        orders = sorted(draw.choice(np.arange(0, 14), size=int(draw.integers(1, 7)), replace=False).tolist())
        cells, points = {o: int(draw.integers(1, 10**6)) for o in orders}, int(10 ** draw.uniform(0, 9))

        def cost(chosen):
            level = {o: min(c for c in chosen if c >= o) for o in orders}
            return points * len(set(level.values())) + sum(cells[o] * 4 ** (level[o] - o) for o in orders)

        floors = sorted({max(o, 5) for o in orders})
        ways = [c + (floors[-1],) for k in range(len(floors)) for c in combinations(floors[:-1], k)]
        found = coverage.lookup_orders(cells, points)
        assert set(found) == set(orders) and all(found[o] >= o for o in orders)
        assert cost(sorted(set(found.values()))) == min(map(cost, ways))
    assert coverage.lookup_orders({}, 5) == {}


def test_lookup_writes_few_keys(spark):
    """Many cells of neighbouring orders and few points: cells stay as they are."""
    size = lambda order: 1 << (2 * (29 - order))
    ranges = spark.range(20_000).selectExpr(
        "id % 7 AS set_id", f"pmod(id * 7919, 49152) * {size(9)}L AS lo").selectExpr("set_id", "lo", f"lo + (1 + lo % 37) * {size(9)}L AS hi")
    points = spark.range(500).selectExpr("id", f"pmod(id * 104729, 49152) * {size(9)}L AS pix29")
    cells, orders = coverage._lookup_cells(ranges, 9, points)
    made = coverage.to_uniq(coverage.coalesce(ranges, 9), 9).count()
    assert cells.count() < 4 * made and max(orders) <= 9
    inside = {(row.set_id, row.id) for row in coverage.points_in_sets(points, ranges, order=9).select("set_id", "id").collect()}
    spans = [(row.set_id, row.lo, row.hi) for row in ranges.collect()]
    by_set = {}
    for one, lo, hi in spans:
        by_set.setdefault(one, []).append((lo, hi))
    assert inside == {(one, row.id) for row in points.collect() for one, own in by_set.items() if any(lo <= row.pix29 < hi for lo, hi in own)}
    assert coverage.points_in_sets(points, ranges.where("false"), order=9).count() == 0

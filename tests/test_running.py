"""Running totals by ranges against totals counted in Python."""

import itertools
import random

import pytest

from skylattice.operators.running import running


def expected(rows):
    totals, seen = [], {}
    for key, place, value, bits in sorted(rows):
        total, mixed = seen.get(key, (0, 0))
        seen[key] = total + value, mixed ^ bits
        totals.append((key, place, value, bits, *seen[key]))
    return totals


@pytest.mark.parametrize("hot", [False, True])
def test_groups_that_go_over_partitions(spark, hot):
    draw = random.Random(3)
    rows = [(0 if hot and i % 3 else draw.randrange(40), i, draw.randrange(-5, 50), draw.getrandbits(62)) for i in range(20_000)]
    draw.shuffle(rows)
    table = spark.createDataFrame(rows, "key bigint, place bigint, value bigint, bits bigint").repartition(7)
    found = running(table, ["key"], ["place"], sums={"total": "value"}, xors={"mixed": "bits"})
    assert found.columns == ["key", "place", "value", "bits", "total", "mixed"]
    assert sorted(map(tuple, found.collect())) == expected(rows)


def test_equal_rows_are_spread(spark):
    table = spark.createDataFrame([("a", None)] * 5000 + [("a", 1)] * 3 + [("b", 0)], "key string, place int").selectExpr("*", "1L AS one", "0.5D AS half")
    found = running(table, ["key"], ["place"], sums={"n": "one", "halves": "half"}, spread=True).collect()
    of_a = sorted((row["n"], row["place"], row["halves"]) for row in found if row["key"] == "a")
    assert [n for n, _, _ in of_a] == list(range(1, 5004)) and [place for _, place, _ in of_a[5000:]] == [1, 1, 1]
    assert all(half == n / 2 for n, _, half in of_a)
    assert [(row["n"], row["halves"]) for row in found if row["key"] == "b"] == [(1, 0.5)]


def test_without_keys_and_without_rows(spark):
    table = spark.range(1000).selectExpr("id", "id AS value")
    found = running(table, [], ["id"], sums={"total": "value"}).orderBy("id").collect()
    assert [row["total"] for row in found] == list(itertools.accumulate(range(1000)))
    assert running(table.where("id < 0"), ["id"], ["value"], sums={"total": "value"}).count() == 0

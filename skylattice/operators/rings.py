"""Searches whose results are ranges of ring-numbered cells, in closed form: a row for each ring that is touched, not for each cell."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.functions.bins import Bins
from skylattice.functions.cells import npix, staged, with_ring_centre
from skylattice.operators.paircount import with_empty_bins
from skylattice.operators.running import running


def _z_of_ring(ring: str, order: int) -> str:
    """Height of ring 1 .. 4 * 2^order - 1, counted from the north."""
    n = 1 << order
    cap = lambda i: f"(cast({i} AS double) * {i} / {3.0 * n * n!r}D)"
    return f"(CASE WHEN {ring} < {n} THEN 1D - {cap(ring)} WHEN {ring} <= {3 * n} THEN ({2 * n} - {ring}) * {2.0 / (3.0 * n)!r}D ELSE {cap(f'({4 * n} - {ring})')} - 1D END)"


def _cells_of_ring(ring: str, order: int) -> str:
    n = 1 << order
    return f"(4L * least({ring}, {n}, {4 * n} - {ring}))"


def _start_of_ring(ring: str, order: int) -> str:
    """The first cell of a ring; that of ring 4 * 2^order is the number of cells."""
    n = 1 << order
    return (
        f"(CASE WHEN {ring} < {n} THEN 2L * {ring} * ({ring} - 1L) WHEN {ring} <= {3 * n} THEN {2 * n * (n - 1)}L + ({ring} - {n}L) * {4 * n}L"
        f" ELSE {npix(order)}L - 2L * ({4 * n}L - {ring}) * ({4 * n}L - {ring} + 1L) END)"
    )


def _rings_north_of(z: str, order: int) -> str:
    """About how many rings lie north of height z: never off by more than one."""
    n = 1 << order
    cap = lambda height: f"cast(floor({n} * sqrt(greatest(0D, 3D * (1D - {height})))) AS bigint)"
    return f"(CASE WHEN {z} > 2D/3D THEN {cap(z)} WHEN {z} >= -2D/3D THEN cast(floor({n} * (2D - 1.5D * {z})) AS bigint) ELSE {4 * n}L - {cap(f'(-({z}))')} END)"


def disc_ring_ranges(discs: DataFrame, order: int) -> DataFrame:
    """(columns of `discs`, `ring`, `lo`, `hi`): the ring-numbered cells lo .. hi - 1 whose centres lie in each disc, its edge included.

    `discs` has `cx`, `cy`, `cz` (a unit vector) and `radius`.  A ring gives one range, two where they go over longitude zero, none where no centre lies
    inside.  A negative or NULL radius has no cells; one of pi or more has all.
    """
    n, turn = 1 << order, 2 * math.pi
    rows = staged(
        discs.where("radius >= 0"),
        {"_d_t": "acos(greatest(-1D, least(1D, cz)))", "_d_s": "sqrt(cx * cx + cy * cy)", "_d_p": "atan2(cy, cx)", "_d_r": f"least(radius, {math.pi!r}D)"},
        {"_d_from": "cos(greatest(0D, _d_t - _d_r))", "_d_to": f"cos(least({math.pi!r}D, _d_t + _d_r))"},
        {"_d_from": f"greatest(1L, {_rings_north_of('_d_from', order)} - 1L)", "_d_to": f"least({4 * n - 1}L, {_rings_north_of('_d_to', order)} + 2L)"},
    )
    rows = rows.withColumn("ring", F.explode(F.sequence("_d_from", "_d_to")))
    rows = staged(
        rows,
        {"_d_z": _z_of_ring("ring", order), "_d_n": _cells_of_ring("ring", order)},
        {"_d_x": "cos(_d_r) - _d_z * cz", "_d_den": "sqrt(greatest(0D, (1D - _d_z) * (1D + _d_z))) * _d_s"},
        # Half the width of the disc at the height of the ring, as an angle around the axis.
        {"_d_half": f"CASE WHEN _d_x <= -_d_den OR _d_r >= {math.pi!r}D THEN {math.pi!r}D WHEN _d_x <= _d_den THEN acos(_d_x / _d_den) END"},
    ).where("_d_half IS NOT NULL")
    shift = f"IF(ring > {n} AND ring < {3 * n} AND (ring + {n}) % 2 = 1, 0D, 0.5D)"
    rows = staged(
        rows,
        {"_d_a": f"cast(ceil((_d_p - _d_half) * _d_n / {turn!r}D - {shift}) AS bigint)", "_d_b": f"cast(floor((_d_p + _d_half) * _d_n / {turn!r}D - {shift}) AS bigint)"},
        {"_d_count": f"IF(_d_half >= {math.pi!r}D, _d_n, least(_d_n, _d_b - _d_a + 1L))"},
        {"_d_lo": f"IF(_d_count = _d_n, 0L, pmod(_d_a, _d_n)) + {_start_of_ring('ring', order)}", "_d_end": f"_d_n + {_start_of_ring('ring', order)}"},
    ).where("_d_count > 0")
    one = "struct(_d_lo AS lo, least(_d_lo + _d_count, _d_end) AS hi)"
    over = "struct(_d_end - _d_n AS lo, _d_lo + _d_count - _d_n AS hi)"
    found = rows.withColumn("_d_both", F.explode(F.expr(f"IF(_d_lo + _d_count > _d_end, array({one}, {over}), array({one}))")))
    return found.select(*discs.columns, "ring", "_d_both.lo", "_d_both.hi")


def strip_ring_ranges(strips: DataFrame, order: int) -> DataFrame:
    """(columns of `strips`, `lo`, `hi`): the ring-numbered cells whose centres lie strictly between the colatitudes `theta1` and `theta2`.

    One range for each strip; where theta1 >= theta2, the two outside of [theta2, theta1].  Empty ranges are left out.
    """
    n = 1 << order

    def first_ring(limit: str, test: str) -> str:
        """The first ring whose height is `test` the limit, or 4 n."""
        near = f"filter(sequence(-2L, 3L), k -> {_rings_north_of(limit, order)} + k BETWEEN 1 AND {4 * n - 1} AND {_z_of_ring(f'({_rings_north_of(limit, order)} + k)', order)} {test} {limit})"
        return f"coalesce({_rings_north_of(limit, order)} + array_min({near}), {4 * n}L)"

    clipped = lambda name: f"cos(greatest(0D, least({math.pi!r}D, {name})))"
    rows = staged(strips, {"_d_above": clipped("theta1"), "_d_below": clipped("theta2")})
    start = lambda ring: _start_of_ring(ring, order)
    # A limit beyond a pole is open.
    rows = staged(rows, {
        "_d_a": f"IF(theta1 < 0, 1L, {first_ring('_d_above', '<')})", "_d_b": f"IF(theta2 > {math.pi!r}D, {4 * n}L, {first_ring('_d_below', '<=')})",
    })
    rows = staged(rows, {"_d_a": start("_d_a"), "_d_b": start("_d_b")})
    parts = f"IF(theta1 < theta2, array(struct(_d_a AS lo, _d_b AS hi)), array(struct(0L AS lo, _d_b AS hi), struct(_d_a AS lo, {npix(order)}L AS hi)))"
    return rows.withColumn("_d_both", F.explode(F.expr(parts))).where("_d_both.lo < _d_both.hi").select(*strips.columns, "_d_both.lo", "_d_both.hi")


def totals_at(cells: DataFrame, pix: str, values: dict[str, str], places: DataFrame, at: str) -> DataFrame:
    """`places` with the sums of `values` (new column -> column of `cells`) over all cells with a smaller number than `at`.

    Cells and places are merged in one order, and a running total of it is at each place what is asked for.  NULL values count as 0.
    """
    asked = places.withColumns({"_t_at": F.col(at).cast("bigint"), "_t_cell": F.lit(0)})
    given = cells.select(F.col(pix).cast("bigint").alias("_t_at"), F.lit(1).alias("_t_cell"), *[F.col(old).alias(f"_t_{new}") for new, old in values.items()])
    merged = asked.unionByName(given, allowMissingColumns=True)
    found = running(merged, [], ["_t_at", "_t_cell"], sums={new: f"_t_{new}" for new in values}, spread=True)
    return found.where("_t_cell = 0").select(*places.columns, *values)


def cell_histogram_by_ranges(left: DataFrame, right: DataFrame, order: int, bins: Bins) -> DataFrame:
    """`paircount.cell_histogram` of ring-numbered cells (`pix_ring`, `weight`), without meeting pairs of cells.

    The discs around the cells of `left` up to each edge are ranges of ring numbers; what `right` has in a range is the difference of two running totals.  All
    discs of an edge add up before the totals are looked up, so no more than all cells times the edges are.
    """
    discs = with_ring_centre(left, order, "pix_ring", "c").select("weight", "cx", "cy", "cz")
    edges = F.explode(F.array(*[F.struct(F.lit(i).alias("edge"), F.lit(edge).alias("radius")) for i, edge in enumerate(bins.edges)]))
    discs = discs.withColumn("_e", edges).select("weight", "cx", "cy", "cz", "_e.edge", "_e.radius")
    ranges = disc_ring_ranges(discs, order)
    ends = F.explode(F.array(F.struct(F.col("hi").alias("at"), F.lit(1).alias("sign")), F.struct(F.col("lo").alias("at"), F.lit(-1).alias("sign"))))
    places = ranges.select("edge", "weight", ends.alias("_e")).groupBy("edge", F.col("_e.at").alias("at")).agg(
        F.sum(F.col("weight") * F.col("_e.sign")).alias("times"), F.sum("_e.sign").alias("discs")
    )
    cells = right.select("pix_ring", F.col("weight").cast("double").alias("weight"), F.lit(1).cast("bigint").alias("one"))
    found = totals_at(cells, "pix_ring", {"total": "weight", "cells": "one"}, places, "at")
    within = found.groupBy("edge").agg(F.sum(F.col("times") * F.col("total")).alias("weighted"), F.sum(F.col("discs") * F.col("cells")).alias("pairs"))
    # (lo, hi] is what is within hi without what is within lo.
    signed = F.explode(F.array(F.struct(F.col("edge").alias("bin"), F.lit(-1).alias("sign")), F.struct((F.col("edge") - 1).alias("bin"), F.lit(1).alias("sign"))))
    binned = within.withColumn("_e", signed).where(F.col("_e.bin").between(0, bins.count - 1)).groupBy(F.col("_e.bin").cast("int").alias("bin")).agg(
        F.sum(F.col("weighted") * F.col("_e.sign")).alias("weighted"), F.sum(F.col("pairs") * F.col("_e.sign")).alias("pairs")
    )
    return with_empty_bins(binned, bins)


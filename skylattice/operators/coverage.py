"""Coverage sets: tables of half-open integer ranges (`set_id`, `lo`, `hi`), many sets in one table.

A sky coverage map is such a set of nested ids at order 29; `order` arguments then say how fine the ranges really are.
All set operations are one sweep over range ends: ends are summed per position (combining on the map side), the
running depth of each side gives the state between two positions, and positions where the state changes are paired up to
the result's ranges.  The running sums come from `prefix_sum`, so one huge set is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylattice.functions.cells import MAX_ORDER, npix, order_of_uniq
from skylattice.operators.ranking import prefix_sum
from skylattice.operators.rings import totals_at
from skylattice.session import checkpointed

SKY_END = npix(MAX_ORDER)


def _ends(ranges: DataFrame, side: str = "a", other: str | None = None) -> DataFrame:
    """Two rows per range, +1 at its start and -1 at its end; empty ranges are ignored."""
    steps = F.array(
        F.struct(F.col("lo").alias("pos"), F.lit(1).cast("bigint").alias(side)),
        F.struct(F.col("hi").alias("pos"), F.lit(-1).cast("bigint").alias(side)),
    )
    ends = ranges.where("lo < hi").select("set_id", F.inline(steps))
    return ends.withColumn(other, F.lit(0).cast("bigint")).select("set_id", "pos", "a", "b") if other else ends


def _sweep(ends: DataFrame, keep: Callable[..., Column], order: int) -> DataFrame:
    """Ranges on which `keep(inside a[, inside b])` holds, as few and as long as possible."""
    low_bits, bits = 2 * (MAX_ORDER - order), 2 * order + 4
    sides = [name for name in ("a", "b") if name in ends.columns]
    steps = ends.groupBy("set_id", "pos").agg(*[F.sum(side).alias(side) for side in sides])
    steps = steps.where(" OR ".join(f"{side} <> 0" for side in sides))
    depth = prefix_sum(steps, ["set_id"], "pos", {f"depth_{side}": side for side in sides}, bits, low_bits)
    before = keep(*[F.col(f"depth_{side}") > 0 for side in sides])
    after = keep(*[F.col(f"depth_{side}") + F.col(side) > 0 for side in sides])
    changes = depth.where(before != after).select("set_id", "pos", F.lit(1).cast("bigint").alias("one"))
    # Changes alternate start, end, start, end: numbers 2k and 2k+1 are one range.
    numbered = prefix_sum(changes, ["set_id"], "pos", {"number": "one"}, bits, low_bits)
    return numbered.groupBy("set_id", F.shiftright("number", 1).alias("_k")).agg(
        F.min("pos").alias("lo"), F.max("pos").alias("hi")
    ).drop("_k")


def _two_sided(a: DataFrame, b: DataFrame, keep: Callable[[Column, Column], Column], order: int) -> DataFrame:
    return _sweep(_ends(a, "a", "b").unionByName(_ends(b, "b", "a")), keep, order)


def coalesce(ranges: DataFrame, order: int = MAX_ORDER) -> DataFrame:
    """Merge overlapping and touching ranges."""
    return _sweep(_ends(ranges), lambda inside: inside, order)


def union(a: DataFrame, b: DataFrame, order: int = MAX_ORDER) -> DataFrame:
    return coalesce(a.select("set_id", "lo", "hi").unionByName(b.select("set_id", "lo", "hi")), order)


def intersection(a: DataFrame, b: DataFrame, order: int = MAX_ORDER) -> DataFrame:
    return _two_sided(a, b, lambda in_a, in_b: in_a & in_b, order)


def difference(a: DataFrame, b: DataFrame, order: int = MAX_ORDER) -> DataFrame:
    return _two_sided(a, b, lambda in_a, in_b: in_a & ~in_b, order)


def symmetric_difference(a: DataFrame, b: DataFrame, order: int = MAX_ORDER) -> DataFrame:
    return _two_sided(a, b, lambda in_a, in_b: in_a != in_b, order)


def complement(ranges: DataFrame, order: int = MAX_ORDER) -> DataFrame:
    """The rest of the sky for every set in the table."""
    sky = ranges.select("set_id").distinct().select(
        "set_id", F.lit(0).cast("bigint").alias("lo"), F.lit(SKY_END).alias("hi")
    )
    return difference(sky, ranges, order)


def contains_set(a: DataFrame, b: DataFrame, order: int = MAX_ORDER) -> DataFrame:
    """(`set_id`, `contains`): does a hold all of b?  One row per set of either table; an empty b is contained."""
    return _flag_sets(a, b, difference(b, a, order), "contains", when_found=False)


def overlaps_set(a: DataFrame, b: DataFrame, order: int = MAX_ORDER) -> DataFrame:
    """(`set_id`, `overlaps`): do a and b share a value?"""
    return _flag_sets(a, b, intersection(a, b, order), "overlaps", when_found=True)


def equal_sets(a: DataFrame, b: DataFrame, order: int = MAX_ORDER) -> DataFrame:
    """(`set_id`, `equal`): do a and b cover the same values, however they are cut in ranges?"""
    return _flag_sets(a, b, symmetric_difference(a, b, order), "equal", when_found=False)


def _flag_sets(a: DataFrame, b: DataFrame, found: DataFrame, name: str, when_found: bool) -> DataFrame:
    marks = (
        a.select("set_id", F.lit(0).alias("hit")).unionByName(b.select("set_id", F.lit(0).alias("hit")))
        .unionByName(found.select("set_id", F.lit(1).alias("hit")))
    )
    return marks.groupBy("set_id").agg((F.max("hit") == F.lit(1 if when_found else 0)).alias(name))


def contains_ranges(ranges: DataFrame, probes: DataFrame, order: int = MAX_ORDER) -> DataFrame:
    """(`set_id`, `probe_id`, `contains`, `overlaps`) for probe ranges (`set_id`, `probe_id`, `lo`, `hi`).

    The number of covered values below a position is a running total, so a probe needs it only at its two ends:
    a covered count of zero means no overlap, a full one means contained.  An empty probe is contained and overlaps nothing.
    """
    # Coverage steps and probe ends share one ordered table; probes add nothing to the depth.
    solid = coalesce(ranges, order)
    zero = F.lit(0).cast("bigint")
    # Sum of step * position: -lo at starts, +hi at ends.  Below p inside a range the open range adds p - lo.
    steps = solid.select("set_id", F.inline(F.array(
        F.struct(F.col("lo").alias("pos"), F.lit(1).cast("bigint").alias("step")),
        F.struct(F.col("hi").alias("pos"), F.lit(-1).cast("bigint").alias("step")),
    ))).withColumn("moment", F.expr("-cast(step AS decimal(38,0)) * pos"))
    wanted = probes.where("lo < hi").select("set_id", F.explode(F.array("lo", "hi")).alias("pos")).select(
        "set_id", "pos", zero.alias("step"), F.lit(0).cast("decimal(38,0)").alias("moment"))
    table = steps.unionByName(wanted).groupBy("set_id", "pos").agg(
        F.sum("step").alias("step"), F.sum("moment").cast("decimal(38,0)").alias("moment"))
    low_bits, bits = 2 * (MAX_ORDER - order), 2 * order + 4
    below = prefix_sum(table, ["set_id"], "pos", {"open": "step", "closed": "moment"}, bits, low_bits)
    below = below.select("set_id", "pos", (F.col("closed") + F.col("open") * F.col("pos")).cast("bigint").alias("covered"))
    at_ends = (
        probes.where("lo < hi").select("set_id", "probe_id", "lo", "hi", F.explode(F.array("lo", "hi")).alias("pos"))
        .join(below, ["set_id", "pos"])
        .groupBy("set_id", "probe_id", "lo", "hi")
        .agg((F.max("covered") - F.min("covered")).alias("covered"))
    )
    empty = probes.where("lo >= hi").select("set_id", "probe_id", F.lit(True).alias("contains"), F.lit(False).alias("overlaps"))
    return at_ends.select(
        "set_id", "probe_id", (F.col("covered") == F.col("hi") - F.col("lo")).alias("contains"),
        (F.col("covered") > 0).alias("overlaps"),
    ).unionByName(empty)


def summary(ranges: DataFrame, order: int = MAX_ORDER) -> DataFrame:
    """(`set_id`, `n_ranges`, `n_values`, `sky_fraction`) of the merged ranges."""
    return coalesce(ranges, order).groupBy("set_id").agg(
        F.count("*").alias("n_ranges"), F.sum(F.col("hi") - F.col("lo")).alias("n_values"),
    ).withColumn("sky_fraction", F.col("n_values") / F.lit(float(SKY_END)))


def is_empty(sets: DataFrame, ranges: DataFrame) -> DataFrame:
    """(`set_id`, `empty`) for every listed set."""
    marks = sets.select("set_id", F.lit(0).alias("hit")).unionByName(
        ranges.where("lo < hi").select("set_id", F.lit(1).alias("hit")))
    return marks.groupBy("set_id").agg((F.max("hit") == 0).alias("empty"))


# --- cells and ranges -------------------------------------------------------------------------------


def from_pixel_ranges(pixels: DataFrame, order: int, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Ranges of nested cells of one order as a coverage map: shifted to order 29 and merged."""
    shift = 2 * (MAX_ORDER - order)
    return coalesce(
        pixels.select("set_id", F.shiftleft(lo, shift).alias("lo"), F.shiftleft(hi, shift).alias("hi")), order)


def from_values(values: DataFrame, value: str = "value") -> DataFrame:
    """Ranges of a table of single values (`set_id`, value)."""
    return coalesce(values.select("set_id", F.col(value).alias("lo"), (F.col(value) + 1).alias("hi")))


def from_cells(cells: DataFrame, order: int = MAX_ORDER) -> DataFrame:
    """Merged ranges of cells (`set_id`, `order`, `pix`) of mixed orders; overlaps and duplicates allowed.

    The `order` argument is the finest order that occurs.
    """
    return coalesce(cells.select(
        "set_id",
        F.expr(f"shiftleft(pix, 2 * ({MAX_ORDER} - `order`))").alias("lo"),
        F.expr(f"shiftleft(pix + 1, 2 * ({MAX_ORDER} - `order`))").alias("hi"),
    ), order)


def from_uniq(uniqs: DataFrame, order: int = MAX_ORDER) -> DataFrame:
    """Merged ranges of unique cell ids (`set_id`, `uniq`)."""
    cells = uniqs.withColumn("order", order_of_uniq(F.col("uniq")))
    return from_cells(cells.withColumn("pix", F.col("uniq") - F.expr("shiftleft(4L, 2 * `order`)")), order)


def to_cell_runs(merged: DataFrame, order: int = MAX_ORDER) -> DataFrame:
    """(`set_id`, `order`, `first`, `last`): runs of cells at the lowest possible order; input merged, `last` exclusive.

    Whole cells of order o inside [lo, hi) are [ceil(lo / s), floor(hi / s)).  The first order with any takes them
    all; each finer order adds what fits to the left and right of the whole cells one order above.
    """
    runs = merged.withColumn("order", F.explode(F.sequence(F.lit(0), F.lit(order))))
    runs = runs.withColumn("_s", 2 * (F.lit(MAX_ORDER) - F.col("order")))
    runs = runs.withColumns({
        "_a": F.expr("shiftright(lo + shiftleft(1L, _s) - 1L, _s)"),
        "_b": F.expr("shiftright(hi, _s)"),
        # The order above, in cells of this order; at order 0 there is none.
        "_pa": F.expr("IF(`order` = 0, 1L, 4L * shiftright(lo + shiftleft(1L, _s + 2) - 1L, _s + 2))"),
        "_pb": F.expr("IF(`order` = 0, 0L, 4L * shiftright(hi, _s + 2))"),
    })
    pieces = F.expr(
        "CASE WHEN _a >= _b THEN array() WHEN _pa >= _pb THEN array(struct(_a AS first, _b AS last))"
        " ELSE array(struct(_a AS first, _pa AS last), struct(_pb AS first, _b AS last)) END"
    )
    return runs.select("set_id", "order", F.inline(pieces)).where("first < last")


def to_uniq(merged: DataFrame, order: int = MAX_ORDER) -> DataFrame:
    """(`set_id`, `order`, `pix`, `uniq`): the well-formed cells of merged ranges."""
    runs = to_cell_runs(merged, order)
    # A run is a handful of cells by construction (at most 12 at order 0, fewer than 8 elsewhere).
    cells = runs.select("set_id", "order", F.explode(F.expr("sequence(first, last - 1)")).alias("pix"))
    return cells.withColumn("uniq", F.col("pix") + F.expr("shiftleft(4L, 2 * `order`)"))


def degrade(ranges: DataFrame, to_order: int, keep_partial: bool, order: int = MAX_ORDER) -> DataFrame:
    """Coarser map: partly covered cells are kept whole or dropped."""
    # Merge first: two touching ranges can fill a cell that neither fills alone.
    size = 1 << (2 * (MAX_ORDER - to_order))
    down, up = f"{{0}} & {-size}L", f"({{0}} + {size - 1}L) & {-size}L"
    lo, hi = (down, up) if keep_partial else (up, down)
    return coalesce(coalesce(ranges, order).select(
        "set_id", F.expr(lo.format("lo")).alias("lo"), F.expr(hi.format("hi")).alias("hi")), to_order)


def finest_order(ranges: DataFrame, order: int = MAX_ORDER) -> DataFrame:
    """(`set_id`, `max_order`): the order needed to describe the map exactly; NULL for bounds all zero."""
    bits = coalesce(ranges, order).groupBy("set_id").agg(F.bit_or(F.col("lo").bitwiseOR(F.col("hi"))).alias("bits"))
    trailing = "length(bin(bits & -bits)) - 1"
    return bits.select(
        "set_id", F.expr(f"CASE WHEN bits <> 0 THEN {MAX_ORDER} - shiftright({trailing}, 1) END").alias("max_order"))


def to_pixels(ranges: DataFrame, to_order: int, order: int = MAX_ORDER, chunk: int = 65536) -> DataFrame:
    """(`set_id`, `pix`): every cell of `to_order` the map touches."""
    shift = 2 * (MAX_ORDER - to_order)
    merged = degrade(ranges, to_order, True, order).select(
        "set_id", F.shiftright("lo", shift).alias("lo"), F.shiftright("hi", shift).alias("hi"))
    return expand(merged, chunk)


def expand(ranges: DataFrame, chunk: int = 65536) -> DataFrame:
    """(`set_id`, `pix`): every value of every range, long ranges in chunks that are dealt to all tasks."""
    pieces = ranges.where("lo < hi").select(
        "set_id", "hi", F.explode(F.expr(f"sequence(lo, hi - 1, {chunk}L)")).alias("start"))
    pieces = pieces.repartition("set_id", "start")
    return pieces.select("set_id", F.explode(F.expr(f"sequence(start, least(start + {chunk}L, hi) - 1)")).alias("pix"))


# --- points and values against coverage -------------------------------------------------------------


#: No key is coarser than a cell of this order, one in 12,288 of the sky.
_COARSEST_LOOKUP = 5


def lookup_orders(cells_by_order: dict[int, int], points: int) -> dict[int, int]:
    """For each order that occurs the order its cells are written out to, so that keys of cells and of points are fewest in all.

    Every order looked up costs one key a point; a cell taken down by k orders becomes 4^k keys.
    """
    counts: dict[int, int] = {}
    for order, cells in cells_by_order.items():
        level = max(order, _COARSEST_LOOKUP)
        counts[level] = counts.get(level, 0) + cells * 4 ** (level - order)
    levels = sorted(counts)
    # From the finest order up: the least cost of the orders from place i on, and the first order looked up then.
    best: list[tuple[int, int]] = [(0, 0)] * (len(levels) + 1)
    for i in reversed(range(len(levels))):
        ways = []
        for j in range(i, len(levels)):
            written = sum(counts[level] * 4 ** (levels[j] - level) for level in levels[i : j + 1])
            ways.append((points + written + best[j + 1][0], j))
        best[i] = min(ways)
    target, i = {}, 0
    while i < len(levels):
        j = best[i][1]
        target.update({level: levels[j] for level in levels[i : j + 1]})
        i = j + 1
    return {order: target[max(order, _COARSEST_LOOKUP)] for order in cells_by_order}


def _lookup_cells(ranges: DataFrame, order: int, points: DataFrame) -> tuple[DataFrame, list[int]]:
    """(`set_id`, `order`, `pix`) with few orders only, and those orders, chosen by the numbers of cells and of points.

    The map's cells are made once; their numbers by order come from that table.
    """
    cells = checkpointed(to_uniq(coalesce(ranges, order), order).select("set_id", "order", "pix"))
    by_order = {row["order"]: row["count"] for row in cells.groupBy("order").count().collect()}
    if not by_order:
        return cells, []
    target = lookup_orders(by_order, points.count())
    level = F.create_map(*[F.lit(part) for pair in target.items() for part in pair])[F.col("order")]
    cells = cells.withColumn("level", level)
    first = F.expr("shiftleft(pix, 2 * (level - `order`))")
    parts = F.sequence(first, first + F.expr("shiftleft(1L, 2 * (level - `order`))") - 1)
    return cells.select("set_id", F.col("level").alias("order"), F.explode(parts).alias("pix")), sorted(set(target.values()))


def _looked_up(points: DataFrame, pix29: str, orders: list[int]) -> DataFrame:
    """One row per point and order, with the point's cell of that order."""
    keys = F.array(*[F.lit(one) for one in orders]).cast("array<int>")
    return points.withColumn("order", F.explode(keys)).withColumn("pix", F.expr(f"shiftright({pix29}, 2 * ({MAX_ORDER} - `order`))"))


def points_in_sets(points: DataFrame, ranges: DataFrame, pix29: str = "pix29", order: int = MAX_ORDER) -> DataFrame:
    """Rows of `points` (with a nested id at order 29) joined to every set that covers them: adds `set_id`.

    The map becomes cells of a few orders, chosen by cost (`lookup_orders`); a point lies in one cell per order, so each point is
    looked up once per order, by equality.
    """
    cells, orders = _lookup_cells(ranges, order, points)
    return _looked_up(points, pix29, orders).join(cells, ["order", "pix"]).drop("order", "pix")


def contains_values(ranges: DataFrame, values: DataFrame, order: int = MAX_ORDER) -> DataFrame:
    """(`set_id`, `value`) rows of `values` that lie in their own set."""
    cells, orders = _lookup_cells(ranges, order, values)
    return _looked_up(values, "value", orders).join(cells, ["set_id", "order", "pix"], "left_semi").select("set_id", "value")


def _signed_totals(ranges: DataFrame, pixel_values: DataFrame, values_order: int) -> DataFrame:
    """`ranges` twice, with the number and the sum of the values before the end of each and, negative, before its start."""
    shift = 2 * (MAX_ORDER - values_order)
    value = F.coalesce(F.col("value").cast("double"), F.lit(0.0))
    strange = F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    cells = pixel_values.where("pix IS NOT NULL").select(
        F.shiftleft("pix", shift).alias("pix29"), F.when(strange, 0.0).otherwise(value).alias("value"), strange.cast("bigint").alias("strange"),
        F.lit(1).cast("bigint").alias("one"))
    ends = F.explode(F.expr("array(struct(hi AS at, 1 AS sign), struct(lo AS at, -1 AS sign))"))
    places = ranges.where("lo < hi").withColumn("_end", ends).selectExpr("set_id", "lo", "hi", "_end.at", "_end.sign")
    found = totals_at(cells, "pix29", {"total": "value", "cells": "one", "odd": "strange"}, places, "at")
    return found.select("set_id", "lo", "hi", *[(F.col("sign") * F.col(name)).alias(name) for name in ("total", "cells", "odd")])


def _total() -> Column:
    return F.when(F.sum("odd") > 0, F.lit(float("nan"))).otherwise(F.sum("total")).alias("total")


def range_sums(ranges: DataFrame, pixel_values: DataFrame, values_order: int) -> DataFrame:
    """(`set_id`, `lo`, `hi`, `cells`, `total`): number and sum of the cells of a pixel map (`pix`, `value`) whose first sub-cell lies in each different range.

    Ranges may overlap; each is two look-ups in the running totals of the map, whatever its length.  A range with a value that is not finite has NaN; NULLs count as
    0.  Sums of whole numbers are exact; others carry the rounding of the map's running total.
    """
    return _signed_totals(ranges.select("set_id", "lo", "hi").distinct(), pixel_values, values_order).groupBy("set_id", "lo", "hi").agg(
        F.sum("cells").alias("cells"), _total())


def weighted_sum(ranges: DataFrame, pixel_values: DataFrame, values_order: int, order: int = MAX_ORDER) -> DataFrame:
    """(`set_id`, `total`): sum of a pixel map (`pix`, `value`) over each set, cells counted by their first sub-cell.

    With sets no finer than the map this is the sum over the covered cells, in doubles; see `range_sums` for NULLs and rounding.  Sets
    without cells of the map are left out.
    """
    found = _signed_totals(coalesce(ranges, order), pixel_values, values_order).groupBy("set_id").agg(F.sum("cells").alias("cells"), _total())
    return found.where("cells > 0").select("set_id", "total")

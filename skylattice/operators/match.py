"""Nearest-match join of two catalogues and the comparison of two match tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.functions.angles import chord_of, separation_of_chord2
from skylattice.functions.cells import MAX_ORDER, nest_parent, with_neighbours, with_nest
from skylattice.operators.proximity import D2, cube_side, estimated_sizes, in_home_cube, in_touched_cubes, split_hot_keys, within_radius
from skylattice.session import checkpointed

#: A cube with more rows than this of the searched side is crowded: its rows are looked up in rounds.
CROWD = 256
#: Each round's radius is this share of the next one's, and none is below a chord that doubles resolve.
_SHRINK, _LEAST_CHORD = 4.0, 1e-12


def distinct_positions(points: DataFrame) -> DataFrame:
    """One row per exact position, with the smallest id there.

    Ties go to the smaller id, so no other copy can appear in a match: dropping copies first changes nothing in
    the result and keeps a large group of copies from pairing with another one.
    """
    return points.groupBy("x", "y", "z").agg(F.min("id").alias("id"))


def crossmatch(
    x: DataFrame, y: DataFrame, radius_arcsec: float = 1.0, border: bool = True, cell_order: int = 5,
    hot_rows: int | None = 2000, crowd: int = CROWD,
) -> DataFrame:
    """Each y takes its nearest x closer than the radius, then each x keeps the closest y that chose it.

    Both tables need `id`, `x`, `y`, `z`.  Ties go to the smaller id.  Output: `x_id`, `y_id`, `sep_arcsec`, and
    `sep_rel` = chord over the limiting chord, in [0, 1).  Not symmetric, and not mutual nearest neighbours.

    Where more than `crowd` positions lie in one cube of the join (about two radii wide), or in one cell without `border`, the
    radius grows in rounds from a small one.
    """
    radius = math.radians(radius_arcsec / 3600.0)
    limit = chord_of(radius)
    chosen = nearest_within(distinct_positions(y), distinct_positions(x), radius, hot_rows, crowd, None if border else cell_order)
    kept = nearest_per(chosen, "b_id", "a_id", "d2")
    return kept.select(
        F.col("b_id").alias("x_id"),
        F.col("a_id").alias("y_id"),
        (F.degrees(separation_of_chord2(F.col("d2"))) * 3600.0).alias("sep_arcsec"),
        (F.sqrt("d2") / F.lit(limit)).alias("sep_rel"),
    )


def _meetings(left: DataFrame, right: DataFrame, chord: float, hot_rows: int | None) -> DataFrame:
    """Pairs of one `cell` that share a cube for this chord, with `d2`: all closer ones, others, and in rare cases a pair twice."""
    prefixed = lambda df, prefix: df.select(*[F.col(name).alias(prefix + name) for name in ("id", "x", "y", "z", "cell")])
    a = in_home_cube(prefixed(left, "a_"), 2.0 * chord, "a_x", "a_y", "a_z", hashed=True)
    b = in_touched_cubes(prefixed(right, "b_"), 2.0 * chord, chord, "b_x", "b_y", "b_z", hashed=True)
    a, b = (rows.withColumn("cube", F.xxhash64("cube", f"{prefix}cell")) for rows, prefix in ((a, "a_"), (b, "b_")))
    keys = ["cube"]
    if hot_rows:
        a, b, keys = split_hot_keys(a, b, "cube", hot_rows, ["a_id", "a_x", "a_y", "a_z"], ["b_id", "b_x", "b_y", "b_z"])
    # The size of a checkpointed table is not known to the planner: without the hint it may send a whole side through the driver.
    return a.hint("merge").join(b, keys).where("a_cell = b_cell").select("a_id", "b_id", F.expr(D2).alias("d2"))


def nearest_within(
    left: DataFrame, right: DataFrame, radius: float, hot_rows: int | None = 2000, crowd: int = CROWD, cell_order: int | None = None
) -> DataFrame:
    """(`a_id`, `b_id`, `d2`): for each left row the nearest right row closer than `radius` radians; ties to the smaller id.

    Both sides are (`id`, `x`, `y`, `z`), each position once.  Left rows in cubes with more than `crowd` right rows are
    looked up in rounds: first within a radius at which no cube is crowded, then four times as far, up to `radius`.  A row
    that has found one is settled, as all nearer ones were seen, so work follows the distance to the nearest and not the
    number of rows within the radius.  With `cell_order` only rows that share a nested cell of that order meet, and crowds are
    those of cells.
    """
    chord = chord_of(min(radius, math.pi))
    side = cube_side(chord)
    if cell_order is None:
        touched, homed = in_touched_cubes(right, side, chord), in_home_cube(left, side)
    else:
        touched, homed = (with_nest(rows, cell_order, "cube", vector=("x", "y", "z")) for rows in (right, left))
    # Estimated on a sample of a large table: what counts as crowded decides speed alone.
    crowded = estimated_sizes(touched, "cube", ["id"], crowd, "_n").where(F.col("_n") > crowd).select("cube")
    nearest = lambda pairs: nearest_per(pairs.select("a_id", "b_id", "d2"), "a_id", "b_id", "d2")
    if crowded.limit(1).count() == 0:
        return nearest(within_radius(left, right, radius, hot_rows, cell_order))
    crowded = checkpointed(crowded)
    found = nearest(within_radius(homed.join(crowded, "cube", "left_anti").drop("cube"), right, radius, hot_rows, cell_order))
    cell = (F.lit(0) if cell_order is None else F.col("cube")).cast("bigint").alias("cell")
    waiting = checkpointed(homed.join(crowded, "cube", "left_semi").select("id", "x", "y", "z", cell))
    near = checkpointed(touched.join(crowded, "cube", "left_semi").select("id", "x", "y", "z", cell).distinct())
    chords = [chord]
    while chords[-1] / _SHRINK > _LEAST_CHORD:
        size = 2.0 * chords[-1]
        most = in_home_cube(near, size, hashed=True).groupBy("cube", "cell").count().agg(F.max("count")).head()[0]
        # Few enough, so that even all pairs of such a cube are cheap.
        if most <= min(crowd, 64):
            break
        chords.append(chords[-1] / _SHRINK)
    for step in reversed(chords):
        pairs = _meetings(waiting, near, step, hot_rows).where(F.col("d2") < F.lit(step * step))
        settled = checkpointed(nearest(pairs))
        found = found.unionByName(settled)
        waiting = checkpointed(waiting.join(settled.select(F.col("a_id").alias("id")).hint("merge"), "id", "left_anti"))
    return found


def nearest_per(pairs: DataFrame, group: str, partner: str, distance: str) -> DataFrame:
    """One row per `group`: the smallest `distance` and the smallest `partner` id at it.

    Both steps are hash aggregates of plain numbers that combine on the map side (the minimum of a structure would sort all
    pairs): first the smallest id at each distance, then, with no ties left, the id at the smallest distance.
    """
    single = pairs.groupBy(group, distance).agg(F.min(partner).alias(partner))
    return single.groupBy(group).agg(F.min_by(partner, distance).alias(partner), F.min(distance).alias(distance))


def narrowest_order(radius: float, finest: int = MAX_ORDER) -> int:
    """Finest order whose cells are all at least `radius` radians wide, so a ball reaches no further than the next cell; -1 if none is.

    Cells of 4^k x 12 have an area of pi / 3 / 4^k and sides below 1.5 / 2^k, hence are wider than 0.5 / 2^k everywhere.
    """
    return max(-1, min(finest, math.floor(math.log2(0.5 / radius)))) if radius > 0 else finest


def distinct_cells(points: DataFrame, order: int, border_order: int | None = None) -> DataFrame:
    """The cells (`pix_nest`) of this order that hold a point.

    With `border_order` a point also counts for the cells around it: those of its eight neighbours at that finer order.
    """
    if border_order is None:
        return with_nest(points, order, vector=("x", "y", "z")).select("pix_nest").distinct()
    fine = with_nest(points, border_order, "fine", vector=("x", "y", "z")).select("fine").distinct()
    around = with_neighbours(fine, border_order, "fine").select(
        F.explode(F.array("fine", "neighbour")).alias("fine")
    )
    return around.where("fine >= 0").select(nest_parent(F.col("fine"), border_order, order).alias("pix_nest")).distinct()


def in_cells_of(y: DataFrame, x: DataFrame, order: int, radius: float | None = None) -> DataFrame:
    """Rows of y in a cell of this order that holds a row of x, or, with `radius` (radians), is within reach of one.

    With a radius every row of y that has a row of x closer than it is kept, whatever the order: the cells around a row of x are
    taken at the finest order that a ball of the radius cannot cross, and a coarser `order` is used where need be.
    """
    border = None if radius is None else narrowest_order(radius)
    if border is not None:
        order = min(order, border)
        if order < 0:
            return y
    tagged = with_nest(y, order, "pix_nest", vector=("x", "y", "z"))
    return tagged.join(distinct_cells(x, order, border), "pix_nest", "left_semi").drop("pix_nest")


def compare_matches(mine: DataFrame, other: DataFrame) -> DataFrame:
    """One row: sizes of both match tables, how many x ids they share, and how far the matched y ids differ.

    An x id occurs at most once per match table, so one grouping on it does the join.
    """
    absent = F.lit(None).cast("bigint")
    by_x = (
        mine.select("x_id", F.col("y_id").alias("mine"), absent.alias("other"))
        .unionByName(other.select("x_id", absent.alias("mine"), F.col("y_id").alias("other")))
        .groupBy("x_id")
        .agg(F.min("mine").alias("mine"), F.min("other").alias("other"))
    )
    return by_x.agg(
        F.count("mine").alias("n_mine"),
        F.count("other").alias("n_other"),
        F.count(F.col("mine") - F.col("other")).alias("n_joined"),
        F.coalesce(F.sum(F.col("mine") - F.col("other")), F.lit(0)).alias("sum_diff"),
        F.count_if(F.col("mine") != F.col("other")).alias("n_different"),
    )

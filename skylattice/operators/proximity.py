"""Exact within-radius join of two point tables.

Points are unit vectors.  Space is cut in cubes at least twice the chord of the radius wide; one side stays in its
own cube, the other is copied to every cube its ball touches, and an equi-join on the cube id is refined by
distance.  Every pair meets in exactly one cube, so nothing is counted twice, and there are no poles or
longitude wraps to treat.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.functions.angles import chord_of
from skylattice.functions.cells import with_nest
from skylattice.operators import cellwalk
from skylattice.operators.blocks import is_placed

# Squared chord of a joined pair.  Products, because power() is an out-of-line call per pair.
D2 = "(a_x - b_x) * (a_x - b_x) + (a_y - b_y) * (a_y - b_y) + (a_z - b_z) * (a_z - b_z)"

# A cube index has 21 bits per axis, which bounds the cube side from below.
_AXIS_BITS = 21
_AXIS_OFFSET = 1 << (_AXIS_BITS - 1)
_MIN_SIDE = 4.0 / (1 << _AXIS_BITS)


def cube_side(chord: float, cubes_per_ball: float = 1.0) -> float:
    """Side for balls of this radius; `cubes_per_ball` > 1 trades more copies for fewer wasted candidates."""
    return max(2.0 * chord / cubes_per_ball, _MIN_SIDE)


def _cube_id(x: str, y: str, z: str) -> Column:
    """One long per cube, so that the join hashes and compares a single primitive."""
    parts = [f"cast({v} AS bigint) + {_AXIS_OFFSET}L" for v in (x, y, z)]
    cube = f"shiftleft({parts[0]}, {2 * _AXIS_BITS}) | shiftleft({parts[1]}, {_AXIS_BITS}) | ({parts[2]})"
    # Never NULL: a join on it needs no null filter, which would compute the positions a second time.
    return F.expr(f"coalesce({cube}, -1L)")


def _hashed_id(x: str, y: str, z: str) -> Column:
    """For cubes of any size.  Two cubes may share an id: pairs then meet that are far apart, or meet twice."""
    return F.xxhash64(F.expr(x), F.expr(y), F.expr(z))


def in_home_cube(
    points: DataFrame, side: float, x: str = "x", y: str = "y", z: str = "z", out: str = "cube", hashed: bool = False
) -> DataFrame:
    name = _hashed_id if hashed else _cube_id
    return points.withColumn(out, name(*(f"floor({v} / {side!r}D)" for v in (x, y, z))))


def in_touched_cubes(
    points: DataFrame, side: float, chord: float, x: str = "x", y: str = "y", z: str = "z", out: str = "cube", hashed: bool = False
) -> DataFrame:
    """One copy per cube that the ball of this chord around the point reaches."""
    reach = chord * (1.0 + 1e-9) + 1e-15
    for axis, v in zip("xyz", (x, y, z)):
        points = points.withColumn(
            f"_g{axis}",
            F.explode(F.expr(f"sequence(floor(({v} - {reach!r}D) / {side!r}D), floor(({v} + {reach!r}D) / {side!r}D))")),
        )
    gaps = [f"greatest(_g{a} * {side!r}D - {v}, {v} - (_g{a} + 1) * {side!r}D, 0D)" for a, v in zip("xyz", (x, y, z))]
    return (
        points.where(F.expr(" + ".join(f"{gap} * {gap}" for gap in gaps) + f" <= {(reach * 1.000001) ** 2!r}D"))
        .withColumn(out, (_hashed_id if hashed else _cube_id)("_gx", "_gy", "_gz"))
        .drop("_gx", "_gy", "_gz")
    )


# Key sizes are estimated on this fraction of the rows, taken by a hash so that every evaluation agrees.
_SAMPLE = 64


def estimated_sizes(side: DataFrame, key: str, identity: list[str], rows: int, out: str) -> DataFrame:
    fraction = _SAMPLE if rows >= 16 * _SAMPLE else 1
    if fraction > 1:
        side = side.where(F.pmod(F.xxhash64(*identity), F.lit(fraction)) == 0)
    return side.groupBy(key).agg((F.count("*") * fraction).alias(out))


def pair_tasks(spark: SparkSession) -> int:
    """Tasks of a join whose work are its pairs."""
    return 8 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


# Groups of equal work that a join is cut in, for each of its tasks.
_GROUPS = 4


def split_hot_keys(
    left: DataFrame, right: DataFrame, key: str, rows: int, left_identity: list[str], right_identity: list[str]
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Spread the pairs of any key with more than about `rows` rows on a side over a rectangle of smaller groups.

    The left rows of a hot key are dealt into strips by a hash of their identity columns, and so are the right rows;
    each strip is copied to every strip of the other side, so all pairs still meet exactly once.  A group holds about
    `rows` x `rows` candidates, or, where that would make more groups than the tasks can use, a key's fair share of all
    candidates: copies are made for balance alone, and their number follows the rows.  A hot key has at least two strips.
    Sizes are estimates: they decide the balance, not the result.  Rows that are
    equal in all identity columns stay in one strip: catalogues need an id, or their copies merged.
    Returns both sides and the columns to join on.
    """
    # A key may be large on one side only, and then be missing from the other side's sample: it counts as one strip there.
    every = estimated_sizes(left, key, left_identity, rows, "_nl").join(estimated_sizes(right, key, right_identity, rows, "_nr"), key, "full")
    work = every.agg(F.coalesce(F.sum(F.col("_nl") * F.col("_nr").cast("double")), F.lit(0.0))).head()[0]
    share = max(rows, math.ceil(math.sqrt(work / (_GROUPS * pair_tasks(left.sparkSession)))))
    strips = lambda n: F.greatest(F.ceil(n / F.lit(share)), F.least(F.ceil(n / F.lit(rows)), F.lit(2)), F.lit(1))
    sizes = every.where((F.col("_nl") > rows) | (F.col("_nr") > rows)).select(
        F.col(key), *[strips(F.coalesce(f"_n{side}", F.lit(0))).alias(f"_strips_{side}") for side in "lr"]
    )

    def dealt(side: DataFrame, identity: list[str], own: str, other: str) -> DataFrame:
        # At most one row per hot key on the right of this join, so the hot rows only stream past it.
        side = side.join(sizes, key, "left")
        return (
            side.withColumn(f"_s{own}", F.pmod(F.xxhash64(*identity, F.lit(1)), F.coalesce(f"_strips_{own}", F.lit(1))))
            .withColumn(f"_s{other}", F.explode(F.expr(f"sequence(0L, coalesce(_strips_{other}, 1L) - 1L)")))
            .drop("_strips_l", "_strips_r")
        )

    return dealt(left, left_identity, "l", "r"), dealt(right, right_identity, "r", "l"), [key, "_sl", "_sr"]


def join_by_work(a: DataFrame, b: DataFrame, keys: list[str], tasks: int | None = None) -> DataFrame:
    """The equi-join of a pair count, over a fixed number of tasks.

    A few kilobytes of points can mean millions of pairs, so neither the number of tasks nor a broadcast may follow
    from the bytes: both sides are dealt by key to `tasks` tasks and merged there, which spills if it has to.
    """
    spark = a.sparkSession
    if tasks is None:
        tasks = pair_tasks(spark)
    return a.repartition(tasks, *keys).hint("merge").join(b.repartition(tasks, *keys), keys)


def _prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select([F.col(c).alias(prefix + c) for c in df.columns])


def candidate_sides(
    left: DataFrame, right: DataFrame, radius: float, hot_rows: int | None, cell_order: int | None = None
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides (columns prefixed `a_` and `b_`) and the keys on which every pair within the radius meets once.

    With `cell_order` only pairs that share a nested cell of that order meet.
    """
    if cell_order is None:
        chord = chord_of(min(radius, math.pi))
        side = cube_side(chord)
        a = in_home_cube(_prefixed(left, "a_"), side, "a_x", "a_y", "a_z")
        b = in_touched_cubes(_prefixed(right, "b_"), side, chord, "b_x", "b_y", "b_z")
    else:
        a = with_nest(_prefixed(left, "a_"), cell_order, "cube", vector=("a_x", "a_y", "a_z"))
        b = with_nest(_prefixed(right, "b_"), cell_order, "cube", vector=("b_x", "b_y", "b_z"))
    if not hot_rows:
        return a, b, ["cube"]
    own = lambda side, prefix: [name for name in side.columns if name.startswith(prefix)]
    return split_hot_keys(a, b, "cube", hot_rows, own(a, "a_"), own(b, "b_"))


def within_radius(
    left: DataFrame, right: DataFrame, radius: float, hot_rows: int | None = 2000, cell_order: int | None = None, walk: bool = False,
    columns: list[str] | None = None,
) -> DataFrame:
    """All ordered pairs (left row, right row) closer than `radius` radians.

    Both sides carry the unit vector `x`, `y`, `z`.  Output columns are prefixed `a_` and `b_`, plus the squared
    chord `d2`.  Give the smaller table as `right`: that side is copied (about 2.5 times).  `cell_order` is the
    border-less variant, in which only pairs in one nested cell of that order can meet.

    With `walk` both sides are sent once to coarse cells, with few copies, and meet there by `cellwalk`: for tables that have many pairs to a row.
    `columns` are the columns of both sides that are wanted, if not all.
    """
    limit = chord_of(min(radius, math.pi)) ** 2
    names = [columns or side.columns for side in (left, right)]
    if walk and cell_order is None:
        return _walked(left, right, min(radius, math.pi), limit, hot_rows, *names)
    a, b, keys = candidate_sides(left, right, radius, hot_rows, cell_order)
    pairs = a.join(b, keys).drop(*keys).withColumn("d2", F.expr(D2)).where(F.col("d2") < F.lit(limit))
    return pairs.select(*[F.col(f"`{prefix}{name}`") for prefix, some in zip(("a_", "b_"), names) for name in some], "d2") if columns else pairs


def _walked(left: DataFrame, right: DataFrame, radius: float, limit: float, hot_rows: int | None, names: list[str], others: list[str]) -> DataFrame:
    # Cells at least four times as wide as the radius: about two copies of the right side where they are just that.
    top = max(0, min(5, math.floor(math.log2(math.sqrt(math.pi / 3) / (4 * max(radius, 1e-9))))))
    make, at = cellwalk.balls(radius, limit), [F.col(v).cast("double") for v in "xyz"]
    sent = cellwalk.dealt(right.where(is_placed()), make, top, others, at)
    met = cellwalk.met_rows(cellwalk.placed(left, top, names), sent, make, top, hot_rows, cellwalk.tasks_of(left.sparkSession), valued=True, strips=True)
    width = len(others)
    found = met.toDF(*[f"b_{name}" for name in others], *[f"a_{name}" for name in names], "d2")
    return found.select(*[F.col(f"`{name}`") for name in (*found.columns[width:-1], *found.columns[:width], "d2")])

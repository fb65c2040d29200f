"""Sky regions as boolean expressions of caps, polygons and strips, applied to points or turned into cells.

A region answers two questions as Column expressions over a unit vector: is the point inside, and how does a disc of
radius `slack` around it lie (zone 0 outside, 1 maybe touching with its centre outside, 2 centre inside, 3 entirely inside).
Points are filtered by the first; cells are found by walking down the pixel hierarchy with the second, one
`explode` per order and no shuffle, dropping cells in zone 0 and keeping cells in zone 3 whole.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.functions.angles import angle, chord_of
from skylattice.functions.cells import nest_to_ring, MAX_ORDER, max_pixel_radius, with_centre
from skylattice.operators.proximity import within_radius

Vec = tuple[float, float, float]


def vector(theta: float, phi: float) -> Vec:
    return math.sin(theta) * math.cos(phi), math.sin(theta) * math.sin(phi), math.cos(theta)


def vector_of_degrees(ra: float, dec: float, mirror: bool = True) -> Vec:
    return vector(math.radians(90.0 - dec), math.radians(360.0 - ra if mirror else ra))


def _cross(a: Vec, b: Vec) -> Vec:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def _unit(a: Vec) -> Vec:
    size = math.sqrt(sum(v * v for v in a))
    return a[0] / size, a[1] / size, a[2] / size


def _dot(a: Vec, b: Vec) -> float:
    return sum(p * q for p, q in zip(a, b))


class Region:
    """Combine with `&`, `|`, `^` and `~`."""

    def contains(self, x: Column, y: Column, z: Column) -> Column:
        raise NotImplementedError

    def zone(self, x: Column, y: Column, z: Column, slack: float) -> Column:
        raise NotImplementedError

    def __and__(self, other: "Region") -> "Region":
        return Both((self, other))

    def __or__(self, other: "Region") -> "Region":
        return Either((self, other))

    def __xor__(self, other: "Region") -> "Region":
        return OneOf(self, other)

    def __invert__(self) -> "Region":
        return Outside(self)


@dataclass(frozen=True)
class Cap(Region):
    """Points strictly closer than `radius` to `centre`."""

    centre: Vec
    radius: float

    def _cosine(self, x: Column, y: Column, z: Column) -> Column:
        a, b, c = _unit(self.centre)
        return x * F.lit(a) + y * F.lit(b) + z * F.lit(c)

    def contains(self, x, y, z):
        return self._cosine(x, y, z) > F.lit(math.cos(self.radius))

    def zone(self, x, y, z, slack):
        cosine = self._cosine(x, y, z)
        outer = -1.01 if self.radius + slack >= math.pi else math.cos(self.radius + slack)
        inner = 1.01 if self.radius - slack <= 0.0 else math.cos(self.radius - slack)
        return (
            F.when(cosine <= F.lit(outer), 0)
            .when(cosine <= F.lit(math.cos(self.radius)), 1)
            .when(cosine <= F.lit(inner), 2)
            .otherwise(3)
        )


@dataclass(frozen=True)
class Strip(Region):
    """Colatitudes between theta1 and theta2; with theta1 > theta2 the two polar parts outside (theta2, theta1)."""

    theta1: float
    theta2: float

    def contains(self, x, y, z):
        above, below = z < F.lit(math.cos(self.theta1)), z > F.lit(math.cos(self.theta2))
        return (above & below) if self.theta1 < self.theta2 else (above | below)

    def zone(self, x, y, z, slack):
        if self.theta1 >= self.theta2:
            return (Strip(-1.0, self.theta2) | Strip(self.theta1, 4.0)).zone(x, y, z, slack)
        clip = lambda angle: F.lit(math.cos(min(math.pi, max(0.0, angle))))
        # Limits beyond a pole are open: no point lies past it.
        from_north = lambda angle: F.lit(True) if angle <= 0.0 else z < clip(angle)
        from_south = lambda angle: F.lit(True) if angle >= math.pi else z > clip(angle)
        within = lambda margin: from_north(self.theta1 + margin if self.theta1 > 0 else 0.0) & from_south(
            self.theta2 - margin if self.theta2 < math.pi else math.pi)
        return F.when(within(slack), 3).when(within(0.0), 2).when(within(-slack), 1).otherwise(0)


@dataclass(frozen=True)
class Convex(Region):
    """Convex polygon: the points on the inner side of every edge's great circle.  Either vertex orientation."""

    vertices: tuple[Vec, ...]

    def _caps(self) -> list[Cap]:
        corners = [_unit(v) for v in self.vertices]
        if len(corners) < 3:
            raise ValueError("a polygon needs three vertices")
        normals = [_unit(_cross(a, b)) for a, b in zip(corners, corners[1:] + corners[:1])]
        middle = tuple(sum(parts) for parts in zip(*corners))
        sign = 1.0 if _dot(normals[0], middle) > 0 else -1.0
        normals = [tuple(sign * part for part in normal) for normal in normals]
        if any(_dot(n, v) < -1e-12 for n in normals for v in corners):
            raise ValueError("polygon is not convex")
        return [Cap(normal, math.pi / 2) for normal in normals]

    def contains(self, x, y, z):
        return Both(tuple(self._caps())).contains(x, y, z)

    def zone(self, x, y, z, slack):
        return Both(tuple(self._caps())).zone(x, y, z, slack)


@dataclass(frozen=True)
class Polygon(Region):
    """Any simple polygon within a hemisphere, concave allowed.

    Projected from the sphere's centre on the plane touching the middle of the vertices, great circles are straight lines; a
    point is inside if a ray from it crosses the outline an odd number of times.
    """

    vertices: tuple[Vec, ...]

    def _frame(self) -> tuple[Vec, Vec, Vec]:
        corners = [_unit(v) for v in self.vertices]
        if len(corners) < 3:
            raise ValueError("a polygon needs three vertices")
        pole = _unit(tuple(sum(parts) for parts in zip(*corners)))
        if min(_dot(pole, v) for v in corners) <= 1e-6:
            raise ValueError("polygon does not fit in a hemisphere")
        helper = min(((1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0)), key=lambda axis: abs(_dot(axis, pole)))
        east = _unit(_cross(helper, pole))
        return pole, east, _cross(pole, east)

    def contains(self, x, y, z):
        pole, east, north = self._frame()
        form = lambda w: x * F.lit(w[0]) + y * F.lit(w[1]) + z * F.lit(w[2])
        mix = lambda *terms: tuple(sum(factor * axis[i] for factor, axis in terms) for i in range(3))
        plane = [(_dot(p, east) / _dot(p, pole), _dot(p, north) / _dot(p, pole)) for p in self.vertices]
        # In the plane a point is (east, north) / pole.  Multiplied by its positive depth, every comparison of the
        # crossing test is the sign of a linear form in x, y, z.
        above = [form(mix((v, pole), (-1.0, north))) > F.lit(0.0) for _, v in plane]
        crossings = []
        for i, ((u1, v1), (u2, v2)) in enumerate(zip(plane, plane[1:] + plane[:1])):
            if v1 == v2:
                continue
            slope = (u2 - u1) / (v2 - v1)
            left = form(mix((1.0, east), (-slope, north), (slope * v1 - u1, pole))) < F.lit(0.0)
            crossings.append(((above[i] != above[(i + 1) % len(plane)]) & left).cast("int"))
        return (form(pole) > F.lit(0.0)) & (reduce(lambda p, q: p + q, crossings) % 2 == 1)

    def zone(self, x, y, z, slack):
        near = []
        corners = [_unit(v) for v in self.vertices]
        for a, b in zip(corners, corners[1:] + corners[:1]):
            # Close to an edge: within the slack of its great circle, and of the disc around the edge's middle.
            normal, middle = _unit(_cross(a, b)), _unit(tuple(p + q for p, q in zip(a, b)))
            half = math.acos(max(-1.0, min(1.0, _dot(a, middle))))
            off = F.abs(x * F.lit(normal[0]) + y * F.lit(normal[1]) + z * F.lit(normal[2]))
            along = x * F.lit(middle[0]) + y * F.lit(middle[1]) + z * F.lit(middle[2])
            band = F.lit(True) if slack >= math.pi / 2 else off <= F.lit(math.sin(slack))
            near.append(band & (along >= F.lit(math.cos(min(math.pi, half + slack)) - 1e-12)))
        touched = reduce(lambda p, q: p | q, near)
        # Outside 0, or 1 if touched; inside 3, or 2 if touched.
        return F.abs(3 * self.contains(x, y, z).cast("int") - touched.cast("int"))


@dataclass(frozen=True)
class Both(Region):
    parts: tuple[Region, ...]

    def contains(self, x, y, z):
        return reduce(lambda p, q: p & q, [part.contains(x, y, z) for part in self.parts])

    def zone(self, x, y, z, slack):
        return F.least(*[part.zone(x, y, z, slack) for part in self.parts])


@dataclass(frozen=True)
class Either(Region):
    parts: tuple[Region, ...]

    def contains(self, x, y, z):
        return reduce(lambda p, q: p | q, [part.contains(x, y, z) for part in self.parts])

    def zone(self, x, y, z, slack):
        return F.greatest(*[part.zone(x, y, z, slack) for part in self.parts])


@dataclass(frozen=True)
class OneOf(Region):
    left: Region
    right: Region

    def contains(self, x, y, z):
        return self.left.contains(x, y, z) != self.right.contains(x, y, z)

    def zone(self, x, y, z, slack):
        either = Both((self.left, Outside(self.right))), Both((Outside(self.left), self.right))
        return Either(either).zone(x, y, z, slack)


@dataclass(frozen=True)
class Outside(Region):
    part: Region

    def contains(self, x, y, z):
        return ~self.part.contains(x, y, z)

    def zone(self, x, y, z, slack):
        return 3 - self.part.zone(x, y, z, slack)


def points_in_region(points: DataFrame, region: Region) -> DataFrame:
    inside = F.explode(F.array(region.contains(F.col("x"), F.col("y"), F.col("z"))))
    # Through a generator, so that the filter is not merged with whatever computes x, y and z.
    return points.select("*", inside.alias("_inside")).where("_inside").drop("_inside")


Zone = Callable[[Column, Column, Column, float], Column]


def _walk(starts: DataFrame, zone: Zone, order: int, finest: int | None) -> DataFrame:
    """Cells found for every row of `starts`: adds `order` and `pix` (`order` <= the wanted one: whole cells stay coarse).

    `finest` None takes cells whose centre is inside.  Otherwise the search is inclusive, and border cells are
    decided by their sub-cells down to that order; the doubtful ones left there count.
    """
    keys = starts.columns
    last = order if finest is None else max(order, finest)
    cells = starts.withColumns({"order": F.lit(0), "_done": F.lit(False)}).withColumn(
        "pix", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(11).cast("bigint"))))
    for level in range(last + 1):
        if level:
            # A finished cell stays as it is; any other is replaced by its four children.
            cells = cells.withColumn("pix", F.explode(F.expr(
                "CASE WHEN _done THEN array(pix) ELSE sequence(4L * pix, 4L * pix + 3L) END")))
        if level == 3:
            # A few regions may cover much sky: deal the first few hundred cells of each to all tasks.
            cells = cells.repartition(*keys, "order", "pix")
        centred = with_centre(cells.withColumn("_at", F.expr("IF(_done, 0L, pix)")), level, "_at", "_w_")
        state = F.when(F.col("_done"), 3).otherwise(
            zone(F.col("_w_x"), F.col("_w_y"), F.col("_w_z"), max_pixel_radius(level)))
        # One evaluation of the zone: generators keep later filters from copying the expression.
        cells = centred.select(*cells.columns, F.explode(F.array(state)).alias("_zone"))
        cells = cells.where(F.col("_zone") >= (2 if finest is None and level == last else 1))
        settled = F.col("_zone") >= (3 if level < order else 2) if level < last else F.lit(True)
        cells = cells.select(
            *keys,
            F.when(F.col("_done"), F.col("order")).otherwise(F.lit(level)).alias("order"),
            (F.col("_done") | settled).alias("_done"),
            "pix",
        )
    if last == order:
        return cells.drop("_done")
    return cells.select(
        *keys,
        F.least(F.col("order"), F.lit(order)).alias("order"),
        F.expr(f"shiftright(pix, 2 * greatest(0, `order` - {order}))").alias("pix"),
    ).distinct()


def _whole_sky(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.lit(0).alias("region_id"))


def region_cells(spark: SparkSession, region: Region, order: int, finest: int | None = None) -> DataFrame:
    """(`order`, `pix`): cells of the region; coarser cells stand for all their sub-cells.

    Exact (cells of `order` with their centre inside) by default; with `finest` >= order a superset that holds every cell touching the region.
    """
    return _walk(_whole_sky(spark), region.zone, order, finest).drop("region_id")


def at_order(cells: DataFrame, order: int, scheme: str = "nest") -> DataFrame:
    """Cells of mixed orders written out at one order: `order` and `pix` replaced by `pix_nest` or, with scheme "ring", `pix_ring`."""
    if scheme == "ring":
        return nest_to_ring(at_order(cells, order), order, "pix_nest", "pix_ring").drop("pix_nest")
    shift = f"2 * ({order} - `order`)"
    # Large whole cells first become order-`mid` cells dealt to all tasks, so no task writes out a base face alone.
    mid = max(0, order - 6)
    coarse = cells.withColumn("_mid", F.explode(F.expr(
        f"CASE WHEN `order` >= {mid} THEN array(pix) ELSE sequence(shiftleft(pix, 2 * ({mid} - `order`)),"
        f" shiftleft(pix + 1, 2 * ({mid} - `order`)) - 1) END")))
    coarse = coarse.withColumn("order", F.greatest(F.col("order"), F.lit(mid))).drop("pix")
    keys = [c for c in coarse.columns if c not in ("order", "_mid")]
    coarse = coarse.repartition(*keys, "order", "_mid")
    return coarse.withColumn(
        "pix_nest", F.explode(F.expr(f"sequence(shiftleft(_mid, {shift}), shiftleft(_mid + 1, {shift}) - 1)"))
    ).drop("order", "_mid")


def as_ranges(cells: DataFrame, set_id: str) -> DataFrame:
    """Cells as unmerged coverage ranges at order 29 (`set_id`, `lo`, `hi`)."""
    shift = f"2 * ({MAX_ORDER} - `order`)"
    return cells.select(
        F.col(set_id).alias("set_id"), F.expr(f"shiftleft(pix, {shift})").alias("lo"), F.expr(f"shiftleft(pix + 1, {shift})").alias("hi"))


# --- tables of discs --------------------------------------------------------------------------------


def disc_cells(discs: DataFrame, order: int, fact: int | None = None) -> DataFrame:
    """Cells of every disc of a table (`disc_id`, `cx`, `cy`, `cz`, `radius`): (`disc_id`, `order`, `pix`).

    By default cells with their centre in the disc (edge included); with `fact` all cells overlapping it, refined to
    log2(fact) orders deeper and possibly a few too many.
    """
    cosine = lambda x, y, z: x * F.col("cx") + y * F.col("cy") + z * F.col("cz")

    def zone(x: Column, y: Column, z: Column, slack: float) -> Column:
        near, r = cosine(x, y, z), F.col("radius")
        return (
            F.when((r + slack < math.pi) & (near < F.cos(r + slack)), 0)
            .when(near < F.cos(r), 1)
            .when((r <= slack) | (near <= F.cos(r - slack)), 2)
            .otherwise(3)
        )

    finest = None if fact is None else order + int(math.log2(fact))
    return _walk(discs.select("disc_id", "cx", "cy", "cz", "radius"), zone, order, finest).select("disc_id", "order", "pix")


def points_in_discs(points: DataFrame, discs: DataFrame, max_radius: float, hot_rows: int | None = 2000) -> DataFrame:
    """(`disc_id`, point columns, `d2`) for points strictly inside each disc; `max_radius` bounds all radii."""
    centres = discs.select("disc_id", "radius", F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("cz").alias("z"))
    found = within_radius(points, centres, max_radius, hot_rows)
    found = found.where(F.col("d2") < 4.0 * F.sin(F.col("b_radius") / 2.0) * F.sin(F.col("b_radius") / 2.0))
    return found.select(F.col("b_disc_id").alias("disc_id"), *[F.col(f"a_{c}").alias(c) for c in points.columns], "d2")


def ring_cells(centres: DataFrame, order: int, radii: Sequence[float]) -> DataFrame:
    """(`disc_id`, `ring`, `pix_nest`): cells whose centre lies in (radii[i], radii[i+1]] around each centre.

    `centres` is (`disc_id`, `cx`, `cy`, `cz`).
    """
    edges2 = [chord_of(radius) ** 2 for radius in radii]
    discs = centres.withColumn("radius", F.lit(float(radii[-1]) * (1 + 1e-12)))
    cells = at_order(disc_cells(discs, order), order)
    cells = with_centre(cells, order, "pix_nest", "_w_").join(centres, "disc_id")
    cells = cells.withColumn("d2", F.expr("(_w_x - cx) * (_w_x - cx) + (_w_y - cy) * (_w_y - cy) + (_w_z - cz) * (_w_z - cz)"))
    ring = F.when(F.col("d2") > F.lit(edges2[-1]), F.lit(None).cast("int"))
    for index in range(len(edges2) - 2, -1, -1):
        ring = ring.when(F.col("d2") > F.lit(edges2[index]), F.lit(index))
    return cells.select("disc_id", ring.alias("ring"), "pix_nest").where("ring IS NOT NULL")


# --- enclosing cones --------------------------------------------------------------------------------


def enclosing_cone(points: DataFrame, group: str) -> DataFrame:
    """(`group`, `cx`, `cy`, `cz`, `radius`, `n`): a cone around each group's mean direction that holds all its points.

    Not the smallest one, but never more than twice as wide.  Where the directions cancel, the cone is around the member with the largest
    (x, y, z) instead.
    """
    mean = points.groupBy(group).agg(
        F.avg("x").alias("mx"), F.avg("y").alias("my"), F.avg("z").alias("mz"), F.count("*").alias("n"),
        F.max(F.struct("x", "y", "z")).alias("one"))
    size = F.expr("sqrt(mx * mx + my * my + mz * mz)")
    centre = mean.select(group, "n", *[
        F.when(size > 1e-12, F.try_divide(F.col(f"m{v}"), size)).otherwise(F.col(f"one.{v}")).alias(f"c{v}") for v in "xyz"
    ])
    # Separation by atan2 of cross and dot products: exact for tiny cones as well.
    a, b = tuple(F.col(c) for c in "xyz"), tuple(F.col(c) for c in ("cx", "cy", "cz"))
    spread = points.join(centre, group).withColumn("_sep", angle(a, b))
    # The centre columns depend on the group alone, so the partial aggregate absorbs a large group on the map side.
    return spread.groupBy(group).agg(
        F.first("cx").alias("cx"), F.first("cy").alias("cy"), F.first("cz").alias("cz"),
        F.max("_sep").alias("radius"), F.first("n").alias("n"))

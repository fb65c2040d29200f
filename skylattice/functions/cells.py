"""Equal-area sphere pixels (order 0..29, 12 * 4^order cells) as staged projections.

Each function takes a DataFrame and adds columns.  The formulas reuse their intermediate values many times, so they
are written as short chains of projections rather than one nested expression: the optimizer keeps the
shared values as local variables of one generated loop.  Ids follow the published pixelisation
(Gorski et al. 2005): `pix_nest` is hierarchical, `pix_ring` counts along rings from the north pole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_ORDER = 29

# Neighbouring base face by direction (rows S, SE, E, SW, centre, NE, W, NW, N) and face 0..11.
FACE_NEIGHBOURS = [
    [8, 9, 10, 11, -1, -1, -1, -1, 10, 11, 8, 9],
    [5, 6, 7, 4, 8, 9, 10, 11, 9, 10, 11, 8],
    [-1, -1, -1, -1, 5, 6, 7, 4, -1, -1, -1, -1],
    [4, 5, 6, 7, 11, 8, 9, 10, 11, 8, 9, 10],
    [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11],
    [1, 2, 3, 0, 0, 1, 2, 3, 5, 6, 7, 4],
    [-1, -1, -1, -1, 7, 4, 5, 6, -1, -1, -1, -1],
    [3, 0, 1, 2, 3, 0, 1, 2, 4, 5, 6, 7],
    [2, 3, 0, 1, -1, -1, -1, -1, 0, 1, 2, 3],
]
# Bits 1 = flip x, 2 = flip y, 4 = swap x and y, by the same direction and face row (north, equator, south).
FACE_TURNS = [
    [0, 0, 3],
    [0, 0, 6],
    [0, 0, 0],
    [0, 0, 5],
    [0, 0, 0],
    [5, 0, 0],
    [0, 0, 0],
    [6, 0, 0],
    [3, 0, 0],
]
# The eight neighbour steps in the order SW, W, NW, N, NE, E, SE, S.
NEIGHBOUR_STEPS = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]

# The space-filling curve.  Row = curve shape 0..7, column = quadrant; value = 4 * next shape + digit.
CURVE_STEPS = [
    [16, 1, 27, 2],
    [31, 20, 6, 5],
    [10, 19, 9, 24],
    [13, 14, 28, 23],
    [0, 11, 17, 18],
    [21, 4, 22, 15],
    [26, 25, 3, 8],
    [7, 30, 12, 29],
]
# First curve shape on each base face, and the face's place along the whole curve.
CURVE_FACE_SHAPE = [2, 5, 2, 5, 3, 6, 3, 6, 2, 3, 2, 3]
CURVE_FACE_PLACE = [0, 5, 6, 11, 10, 1, 4, 7, 2, 3, 8, 9]


def npix(order: int) -> int:
    return 12 << (2 * order)


def max_pixel_radius(order: int) -> float:
    """Largest angle between the centre of a cell of this order and any of its points."""
    nside = 1 << order
    z1, phi1 = 2.0 / 3.0, math.pi / (4 * nside)
    z2 = 1.0 - (1.0 - 1.0 / nside) ** 2 / 3.0
    s1, s2 = math.sqrt(1 - z1 * z1), math.sqrt(1 - z2 * z2)
    a = (s1 * math.cos(phi1), s1 * math.sin(phi1), z1)
    b = (s2, 0.0, z2)
    normal = (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])
    return math.atan2(math.sqrt(sum(v * v for v in normal)), sum(p * q for p, q in zip(a, b)))


def staged(df: DataFrame, *stages: dict[str, str]) -> DataFrame:
    """Apply projections of SQL expressions one after the other."""
    for stage in stages:
        df = df.withColumns({name: F.expr(text) for name, text in stage.items()})
    return df


def _sealed(df: DataFrame, *results: str) -> DataFrame:
    """Drop working columns and emit the results through a one-element generator.

    A filter or join key on a result would otherwise be pushed below the staged projections, where every shared
    value is written out again at each use and the expression grows exponentially.  Nothing is pushed below a
    generator, and it stays inside the generated loop.
    """
    kept = [name for name in df.columns if name not in results and not name.startswith("_c_")]
    return df.select(*kept, F.inline(F.array(F.struct(*results))))


# --- bit interleaving -------------------------------------------------------------------------------

_SPREAD = [(16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F),
           (2, 0x3333333333333333), (1, 0x5555555555555555)]
_EVEN_BITS = 0x5555555555555555
_GATHER = [(1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF),
           (8, 0x0000FFFF0000FFFF), (16, 0x00000000FFFFFFFF)]


def _spread(df: DataFrame, order: int, names: list[str]) -> DataFrame:
    """Move bit k of each column to bit 2k."""
    stages = [
        {name: f"({name} | shiftleft({name}, {shift})) & {mask}L" for name in names}
        for shift, mask in _SPREAD
        if shift < order
    ]
    return staged(df, *stages)


def _gather(df: DataFrame, order: int, names: list[str]) -> DataFrame:
    """Inverse of `_spread`; odd bits are ignored."""
    stages = [{name: f"{name} & {_EVEN_BITS}L" for name in names}]
    stages += [
        {name: f"({name} | shiftright({name}, {shift})) & {mask}L" for name in names}
        for shift, mask in _GATHER
        if shift < order
    ]
    return staged(df, *stages)


def _encode_nest(df: DataFrame, order: int, out: str) -> DataFrame:
    """Face and x, y inside the face (`_c_face`, `_c_ix`, `_c_iy`) -> nested id."""
    df = _spread(df, order, ["_c_ix", "_c_iy"])
    return staged(df, {out: f"shiftleft(_c_face, {2 * order}) | _c_ix | shiftleft(_c_iy, 1)"})


def _decode_nest(df: DataFrame, order: int, pix: str) -> DataFrame:
    df = staged(df, {
        "_c_face": f"shiftright({pix}, {2 * order})",
        "_c_ix": f"{pix} & {(1 << (2 * order)) - 1}L",
        "_c_iy": f"shiftright({pix} & {(1 << (2 * order)) - 1}L, 1)",
    })
    return _gather(df, order, ["_c_ix", "_c_iy"])


# --- position -> cell -------------------------------------------------------------------------------


def _location(df: DataFrame, theta: str, phi: str, vector: tuple[str, str, str] | None) -> DataFrame:
    """`_c_z`, `_c_za` = |z|, `_c_turn` (longitude in quarter turns, [0, 4)), `_c_col` (its quarter) and `_c_sigma`.

    Sigma = sqrt(3 (1 - |z|)) is how far the pole caps of the projection shrink a parallel (1 at their edge, 0 at the pole).
    """
    if vector is None:
        first = {"_c_z": f"cos({theta})", "_c_sth": f"sin({theta})", "_c_phi": phi}
    else:
        x, y, z = vector
        first = {
            "_c_z": f"{z} / sqrt({x}*{x} + {y}*{y} + {z}*{z})",
            "_c_sth": f"sqrt({x}*{x} + {y}*{y}) / sqrt({x}*{x} + {y}*{y} + {z}*{z})",
            "_c_phi": f"atan2({y}, {x})",
        }
    return staged(
        df, first,
        {"_c_za": "abs(_c_z)", "_c_turn": f"pmod(_c_phi * {2.0 / math.pi!r}D, 4.0D)"},
        {
            "_c_col": "least(3L, floor(_c_turn))",
            # 1 - |z| = sin^2 / (1 + |z|), which near the poles keeps the digits that the difference would lose.
            "_c_sigma": f"CASE WHEN _c_za < {_NEAR_POLE!r}D THEN sqrt(3.0D * (1.0D - _c_za)) ELSE _c_sth * sqrt(3.0D / (1.0D + _c_za)) END",
        },
    )


#: From this |z| on sigma is taken from the sine.
_NEAR_POLE = 0.95
#: In the belt between the pole caps |z| is at most this.
_BELT = "_c_za <= 2.0D / 3.0D"


def with_nest(
    df: DataFrame, order: int, out: str = "pix_nest", theta: str = "theta", phi: str = "phi",
    vector: tuple[str, str, str] | None = None,
) -> DataFrame:
    """Add the nested cell id of each position, given as angles or as a vector.

    The sphere is projected on the plane (equal-area cylinder in the belt, interrupted Collignon in the caps), in units in which the
    twelve faces are squares on their tips: tips 1 above and below the middle, and 8 once around.  Turned by 45 degrees the squares
    stand on a grid.  Its axes here run to the north-east and the south-east, so a whole number of each names the face, and the
    fractions are the place in it.
    """
    last = (1 << order) - 1
    df = staged(
        _location(df, theta, phi, vector),
        # In the belt x runs around and y = 3/2 z; in a cap both are taken from the tip of its face at the belt.
        {"_c_east": f"CASE WHEN {_BELT} THEN _c_turn ELSE (_c_turn - _c_col) * _c_sigma END",
         "_c_north": f"CASE WHEN {_BELT} THEN 0.75D * _c_z ELSE 0D END"},
        {"_c_a": f"CASE WHEN {_BELT} THEN 0.5D + _c_east + _c_north ELSE least(1.0D, _c_sigma - _c_east) END",
         "_c_b": f"CASE WHEN {_BELT} THEN 0.5D + _c_east - _c_north ELSE least(1.0D, _c_east) END"},
        {"_c_row": f"CASE WHEN {_BELT} THEN 1L - floor(_c_a) + floor(_c_b) WHEN _c_z >= 0D THEN 0L ELSE 2L END",
         "_c_col": f"CASE WHEN {_BELT} THEN least(floor(_c_a), floor(_c_b)) & 3L ELSE _c_col END",
         # Caps: distance from the tip at the pole, along both edges that meet there.
         "_c_fx": f"CASE WHEN {_BELT} THEN _c_a - floor(_c_a) WHEN _c_z >= 0D THEN 1.0D - _c_a ELSE _c_b END",
         "_c_fy": f"CASE WHEN {_BELT} THEN 1.0D - (_c_b - floor(_c_b)) WHEN _c_z >= 0D THEN 1.0D - _c_b ELSE _c_a END"},
        {"_c_face": "4L * _c_row + _c_col",
         **{f"_c_i{v}": f"least({last}L, floor(_c_f{v} * {float(1 << order)}D))" for v in "xy"}},
    )
    return _sealed(_encode_nest(df, order, out), out)


def with_ring(
    df: DataFrame, order: int, out: str = "pix_ring", theta: str = "theta", phi: str = "phi",
    vector: tuple[str, str, str] | None = None,
) -> DataFrame:
    """Add the ring-scheme cell id of each position, by ring number and place in the ring."""
    n = 1 << order
    df = staged(
        _location(df, theta, phi, vector),
        {
            "_c_equ": "_c_za <= 2.0D / 3.0D",
            "_c_jp": f"CASE WHEN _c_za <= 2.0D / 3.0D THEN floor({n}D * (0.5D + _c_turn) - {0.75 * n!r}D * _c_z)"
                     f" ELSE floor({n}D * (_c_turn - _c_col) * _c_sigma) END",
            "_c_jm": f"CASE WHEN _c_za <= 2.0D / 3.0D THEN floor({n}D * (0.5D + _c_turn) + {0.75 * n!r}D * _c_z)"
                     f" ELSE floor({n}D * (1.0D - (_c_turn - _c_col)) * _c_sigma) END",
        },
        # Ring counted from the equatorial belt's first ring, or from the nearer pole.
        {"_c_ir": f"CASE WHEN _c_equ THEN {n + 1}L + _c_jp - _c_jm ELSE least({n}L, _c_jp + _c_jm + 1L) END"},
        {"_c_ip": f"CASE WHEN _c_equ THEN pmod(shiftright(_c_jp + _c_jm - {n}L + 2L - (_c_ir & 1L), 1), {4 * n}L)"
                  " ELSE pmod(floor(_c_turn * _c_ir), 4L * _c_ir) END"},
        {out: f"CASE WHEN _c_equ THEN {2 * n * (n - 1)}L + (_c_ir - 1L) * {4 * n}L + _c_ip"
              f" WHEN _c_z > 0D THEN 2L * _c_ir * (_c_ir - 1L) + _c_ip"
              f" ELSE {npix(order)}L - 2L * _c_ir * (_c_ir + 1L) + _c_ip END"},
    )
    return _sealed(df, out)


# --- cell -> position -------------------------------------------------------------------------------


def _face_point(df: DataFrame) -> DataFrame:
    """Face and fractional place in it (`_c_face`, `_c_fx`, `_c_fy` in [0, 1]) -> `_c_z`, `_c_sth`, `_c_phi`.

    The place is turned back by 45 degrees on the plane of `with_nest`, about the middle of its face, and the projection is inverted.
    """
    return staged(
        df,
        {
            "_c_mid": "2 * (_c_face & 3) + IF(_c_face div 4 = 1, 0, 1)",
            "_c_east": "_c_fx - _c_fy",
            "_c_north": "_c_fx + _c_fy - (_c_face div 4)",
        },
        # Beyond 1 a parallel is as long as what is left to the pole at 2.
        {"_c_sigma": "least(1.0D, 2.0D - abs(_c_north))"},
        {"_c_in_cap": "_c_sigma < 1.0D", "_c_down": "_c_sigma * _c_sigma / 3.0D"},
        {"_c_z": "CASE WHEN NOT _c_in_cap THEN _c_north * 2.0D / 3.0D ELSE sign(_c_north) * (1.0D - _c_down) END"},
        {
            "_c_sth": "CASE WHEN _c_in_cap THEN sqrt(_c_down * (2.0D - _c_down)) ELSE sqrt((1.0D - _c_z) * (1.0D + _c_z)) END",
            # The poles have longitude 0.
            "_c_phi": f"CASE WHEN _c_sigma <= 0D THEN 0D ELSE {math.pi / 4!r}D * pmod(_c_mid + _c_east / _c_sigma, 8.0D) END",
        },
    )


def _place(df: DataFrame, prefix: str) -> DataFrame:
    """`_c_z`, `_c_sth`, `_c_phi` -> theta, phi, x, y, z columns."""
    columns = {
        f"{prefix}theta": "atan2(_c_sth, _c_z)",
        f"{prefix}phi": "_c_phi",
        f"{prefix}x": "_c_sth * cos(_c_phi)",
        f"{prefix}y": "_c_sth * sin(_c_phi)",
        f"{prefix}z": "_c_z",
    }
    return _sealed(staged(df, columns), *columns)


def with_centre(df: DataFrame, order: int, pix: str = "pix_nest", prefix: str = "") -> DataFrame:
    """Add the centre of each nested cell: `theta`, `phi` and the unit vector `x`, `y`, `z`."""
    df = staged(_decode_nest(df, order, pix), {
        "_c_fx": f"(_c_ix + 0.5D) / {1 << order}D",
        "_c_fy": f"(_c_iy + 0.5D) / {1 << order}D",
    })
    return _place(_face_point(df), prefix)


def _isqrt(value: str) -> str:
    """Exact integer root of an expression below 2^62: the double root, moved down or up by one if it rounded."""
    root = f"cast(floor(sqrt(cast({value} AS double))) AS bigint)"
    return f"({root} - IF({root} * {root} > {value}, 1L, 0L) + IF(({root} + 1L) * ({root} + 1L) <= {value}, 1L, 0L))"


def _ring_location(df: DataFrame, order: int, pix: str) -> DataFrame:
    n = 1 << order
    cap = 2 * n * (n - 1)
    total = npix(order)
    return staged(
        df,
        {"_c_zone": f"CASE WHEN {pix} < {cap}L THEN 0 WHEN {pix} < {total - cap}L THEN 1 ELSE 2 END"},
        # Cells counted from the nearer pole, or from the start of the equatorial belt.
        {"_c_q": f"CASE _c_zone WHEN 0 THEN {pix} WHEN 1 THEN {pix} - {cap}L ELSE {total - 1}L - {pix} END"},
        {"_c_v": "CASE WHEN _c_zone = 1 THEN 0L ELSE 1L + 2L * _c_q END"},
        {"_c_ring": f"CASE WHEN _c_zone = 1 THEN _c_q div {4 * n}L + {n}L ELSE shiftright(1L + {_isqrt('_c_v')}, 1) END"},
        {"_c_place": f"CASE _c_zone WHEN 1 THEN (_c_q % {4 * n}L) + IF(((_c_ring + {n}L) & 1L) = 1L, 0D, 0.5D)"
                     " WHEN 0 THEN _c_q - 2L * _c_ring * (_c_ring - 1L) + 0.5D"
                     " ELSE 2L * _c_ring * (_c_ring + 1L) - _c_q - 0.5D END",
         "_c_cap": f"cast(_c_ring AS double) * _c_ring / {3.0 * n * n!r}D"},
        {"_c_z": f"CASE _c_zone WHEN 1 THEN ({2 * n}L - _c_ring) * {2.0 / (3.0 * n)!r}D WHEN 0 THEN 1.0D - _c_cap ELSE _c_cap - 1.0D END",
         "_c_phi": f"_c_place * {math.pi / 2!r}D / IF(_c_zone = 1, {n}L, _c_ring)"},
        {"_c_sth": "CASE WHEN _c_zone = 1 THEN sqrt((1.0D - _c_z) * (1.0D + _c_z)) ELSE sqrt(_c_cap * (2.0D - _c_cap)) END"},
    )


def with_ring_centre(df: DataFrame, order: int, pix: str = "pix_ring", prefix: str = "") -> DataFrame:
    """Add the centre of each ring-scheme cell."""
    return _place(_ring_location(df, order, pix), prefix)


def with_boundary(df: DataFrame, order: int, step: int = 1, pix: str = "pix_nest", scheme: str = "nest") -> DataFrame:
    """One row per outline point: `step` points per edge, counter-clockwise from the north corner (`point` 0..4*step-1).

    `scheme` "ring" takes `pix` as a ring-scheme id.
    """
    if scheme == "ring":
        return with_boundary(ring_to_nest(df, order, pix, "_b_nest"), order, step, "_b_nest").drop("_b_nest")
    side = 1 << order
    df = _decode_nest(df, order, pix)
    df = df.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(4 * step - 1))))
    along = f"((point % {step}) / {float(step)!r}D)"
    df = staged(
        df,
        {"_c_edge": f"point div {step}"},
        # Edges run N->W, W->S, S->E, E->N; x falls on the first, y on the second, and so on.
        {
            "_c_fx": f"(_c_ix + CASE _c_edge WHEN 0 THEN 1.0D - {along} WHEN 1 THEN 0D WHEN 2 THEN {along} ELSE 1.0D END) / {side}D",
            "_c_fy": f"(_c_iy + CASE _c_edge WHEN 0 THEN 1.0D WHEN 1 THEN 1.0D - {along} WHEN 2 THEN 0D ELSE {along} END) / {side}D",
        },
    )
    return _place(_face_point(df), "")


# --- renumbering ------------------------------------------------------------------------------------


def nest_to_ring(df: DataFrame, order: int, pix: str = "pix_nest", out: str = "pix_ring") -> DataFrame:
    n = 1 << order
    total = npix(order)
    df = staged(
        _decode_nest(df, order, pix),
        {"_c_jr": f"(shiftright(_c_face, 2) + 2L) * {n}L - _c_ix - _c_iy - 1L"},
        {"_c_nr": f"CASE WHEN _c_jr < {n}L THEN _c_jr WHEN _c_jr > {3 * n}L THEN {4 * n}L - _c_jr ELSE {n}L END",
         "_c_k": f"CASE WHEN _c_jr < {n}L OR _c_jr > {3 * n}L THEN 0L ELSE (_c_jr - {n}L) & 1L END"},
        {"_c_first": f"CASE WHEN _c_jr < {n}L THEN 2L * _c_nr * (_c_nr - 1L) WHEN _c_jr > {3 * n}L THEN {total}L - 2L * _c_nr * (_c_nr + 1L)"
                     f" ELSE {2 * n * (n - 1)}L + (_c_jr - {n}L) * {4 * n}L END",
         "_c_place": "shiftright((2L * (_c_face & 3L) + IF(shiftright(_c_face, 2) = 1, 0L, 1L)) * _c_nr + _c_ix - _c_iy + 1L + _c_k, 1)"},
        {out: "_c_first + pmod(_c_place - 1L, 4L * _c_nr)"},
    )
    return _sealed(df, out)


def ring_to_nest(df: DataFrame, order: int, pix: str = "pix_ring", out: str = "pix_nest") -> DataFrame:
    """Through the centre, which lies half a cell away from every border."""
    df = staged(_ring_location(df, order, pix), {"_r_theta": "atan2(_c_sth, _c_z)", "_r_phi": "_c_phi"})
    df = with_nest(_sealed(df, "_r_theta", "_r_phi"), order, out, "_r_theta", "_r_phi")
    return df.drop("_r_theta", "_r_phi")


def nest_parent(pix: Column, order: int, parent_order: int) -> Column:
    return F.shiftright(pix, 2 * (order - parent_order))


def with_children(df: DataFrame, order: int, child_order: int, pix: str = "pix_nest", out: str = "child") -> DataFrame:
    """One row per descendant of each nested cell, in steps of at most six orders, so that no row holds more than 4^6 ids."""
    df = df.withColumn(out, F.col(pix))
    for start in range(order, child_order, 6):
        shift = 2 * (min(start + 6, child_order) - start)
        first = F.shiftleft(F.col(out), shift)
        df = df.withColumn(out, F.explode(F.sequence(first, first + F.lit((1 << shift) - 1))))
    return df


def ring_parent(df: DataFrame, order: int, parent_order: int, pix: str = "pix_ring", out: str = "parent_ring") -> DataFrame:
    df = ring_to_nest(df, order, pix, "_p_nest")
    df = df.withColumn("_p_nest", nest_parent(F.col("_p_nest"), order, parent_order))
    return nest_to_ring(df, parent_order, "_p_nest", out).drop("_p_nest")


def _literal_array(rows: list[list[int]]) -> str:
    return "array(" + ", ".join(str(value) for row in rows for value in row) + ")"


def with_neighbours(df: DataFrame, order: int, pix: str = "pix_nest", out: str = "neighbour") -> DataFrame:
    """Eight rows per nested cell: `direction` 0..7 (SW, W, NW, N, NE, E, SE, S) and its neighbour, -1 where none exists."""
    n = 1 << order
    df = _decode_nest(df, order, pix)
    df = df.withColumn("direction", F.explode(F.sequence(F.lit(0), F.lit(7))))
    step_x, step_y = (", ".join(str(step[axis]) for step in NEIGHBOUR_STEPS) for axis in (0, 1))
    df = staged(
        df,
        {"_c_x": f"_c_ix + get(array({step_x}), direction)", "_c_y": f"_c_iy + get(array({step_y}), direction)"},
        {"_c_side": f"4 + CASE WHEN _c_x < 0 THEN -1 WHEN _c_x >= {n} THEN 1 ELSE 0 END"
                    f" + CASE WHEN _c_y < 0 THEN -3 WHEN _c_y >= {n} THEN 3 ELSE 0 END",
         "_c_x": f"pmod(_c_x, {n}L)", "_c_y": f"pmod(_c_y, {n}L)"},
        {"_c_to": f"get({_literal_array(FACE_NEIGHBOURS)}, cast(_c_side * 12 + _c_face AS int))",
         "_c_bits": f"get({_literal_array(FACE_TURNS)}, cast(_c_side * 3 + shiftright(_c_face, 2) AS int))"},
        {"_c_x": f"IF((_c_bits & 1) != 0, {n - 1}L - _c_x, _c_x)", "_c_y": f"IF((_c_bits & 2) != 0, {n - 1}L - _c_y, _c_y)"},
        {"_c_ix": "IF((_c_bits & 4) != 0, _c_y, _c_x)", "_c_iy": "IF((_c_bits & 4) != 0, _c_x, _c_y)",
         "_c_face": "cast(_c_to AS bigint)"},
    )
    df = _encode_nest(df, order, out)
    return _sealed(staged(df, {out: f"IF(_c_to < 0, -1L, {out})"}), out)


def with_ring_neighbours(df: DataFrame, order: int, pix: str = "pix_ring", out: str = "neighbour") -> DataFrame:
    """`with_neighbours` in ring numbering on both sides."""
    df = with_neighbours(ring_to_nest(df, order, pix, "_n_nest"), order, "_n_nest", "_n_near")
    df = nest_to_ring(df.withColumn("_n_safe", F.greatest(F.col("_n_near"), F.lit(0))), order, "_n_safe", out)
    df = df.withColumn(out, F.when(F.col("_n_near") < 0, F.lit(-1)).otherwise(F.col(out)).cast("bigint"))
    return df.drop("_n_nest", "_n_near", "_n_safe")


# --- unique ids and the space-filling key -----------------------------------------------------------


def uniq_of(order: Column, pix: Column) -> Column:
    """Order and nested id in one number: pix + 4^(order + 1)."""
    return pix + F.call_function("shiftleft", F.lit(4).cast("bigint"), 2 * order)


def order_of_uniq(uniq: Column) -> Column:
    """Half the bit length of uniq / 4; counted on the binary text, so exact up to 62 bits."""
    return F.shiftright(F.length(F.bin(F.shiftright(uniq, 2))) - 1, 1)


def with_uniq_parts(df: DataFrame, uniq: str = "uniq") -> DataFrame:
    """Add `order` and `pix` of a unique id."""
    return df.withColumn("order", order_of_uniq(F.col(uniq))).withColumn(
        "pix", F.col(uniq) - F.expr("shiftleft(4L, 2 * order)")
    )


def _inverse_curve() -> tuple[list[list[int]], list[int], list[int]]:
    """The curve tables read backwards: from digit to quadrant, and from place on the curve to face."""
    steps = [[0] * 4 for _ in CURVE_STEPS]
    for shape, row in enumerate(CURVE_STEPS):
        for quadrant, value in enumerate(row):
            steps[shape][value & 3] = (value & ~3) | quadrant
    faces = [CURVE_FACE_PLACE.index(place) for place in range(12)]
    return steps, [CURVE_FACE_SHAPE[face] for face in faces], faces


def _curve(df: DataFrame, order: int, source: str, out: str, tables: tuple[list[list[int]], list[int], list[int]]) -> DataFrame:
    steps, shapes, faces = tables
    face = f"cast(shiftright({source}, {2 * order}) AS int)"
    # `_c_t` is the last table value (next shape and digit), `_c_key` the digits before it.
    df = staged(df, {"_c_t": f"4 * get({_literal_array([shapes])}, {face})",
                     "_c_key": f"cast(get({_literal_array([faces])}, {face}) AS bigint)"})
    for level in range(order - 1, -1, -1):
        quadrant = f"cast(shiftright({source}, {2 * level}) & 3L AS int)"
        df = staged(df, {
            "_c_t": f"get({_literal_array(steps)}, 4 * shiftright(_c_t, 2) + {quadrant})",
            "_c_key": "shiftleft(_c_key, 2) | (_c_t & 3)" if level < order - 1 else "_c_key",
        })
    last = "shiftleft(_c_key, 2) | (_c_t & 3)" if order else "_c_key"
    return _sealed(staged(df, {out: last}), out)


def nest_to_curve(df: DataFrame, order: int, pix: str = "pix_nest", out: str = "curve_key") -> DataFrame:
    """Place of each cell on a curve through all cells on which consecutive places are adjacent cells."""
    return _curve(df, order, pix, out, (CURVE_STEPS, CURVE_FACE_SHAPE, CURVE_FACE_PLACE))


def curve_to_nest(df: DataFrame, order: int, key: str = "curve_key", out: str = "pix_nest") -> DataFrame:
    return _curve(df, order, key, out, _inverse_curve())


def cluster_by_curve(df: DataFrame, order: int, partitions: int, pix: str = "pix_nest") -> DataFrame:
    """Rows range-partitioned and sorted along the curve, so that files hold compact sky patches."""
    return (
        nest_to_curve(df, order, pix, "_curve")
        .repartitionByRange(partitions, "_curve")
        .sortWithinPartitions("_curve")
        .drop("_curve")
    )

"""Pixel formulas as SQL text for the checking engine, written per cell with list functions instead of bit tricks."""

from __future__ import annotations

import math


#: Middles of the twelve faces on the plane, eighths of a turn by 3/2 z.
FACE_MIDDLES = [(2 * k + (row != 1), 1 - row) for row in range(3) for k in range(4)]


def nest_sql(source: str, order: int, out: str = "pix_nest") -> str:
    """Adds the nested id to rows with z, sth, phi.

    Another route than the engine's: the projected point is compared with the middles of all faces, and belongs to the one that is
    nearest by |dx| + |dy|; both coordinates in the face are then linear in dx and dy.
    """
    n = 1 << order
    spread = lambda v, up: f"list_sum(list_transform(range(0, {max(order, 1)}), lambda i: ((({v}) >> i) & 1) << (2 * i + {up})))::bigint"
    middles = "[" + ", ".join(f"struct_pack(f := {face}, x := {x}::double, y := {y}::double)" for face, (x, y) in enumerate(FACE_MIDDLES)) + "]"
    across = "(((k_px - m.x + 4::double) % 8::double + 8::double) % 8::double - 4::double)"
    return f"""(SELECT * EXCLUDE (k_q, k_s, k_px, k_py, k_near, k_fx, k_fy, k_ix, k_iy) FROM (
      SELECT *, {spread('k_ix', 0)} + {spread('k_iy', 1)} + (k_near.f::bigint << {2 * order}) AS {out} FROM (
      SELECT *, least({n - 1}, greatest(0, floor(k_fx * {n})))::bigint AS k_ix, least({n - 1}, greatest(0, floor(k_fy * {n})))::bigint AS k_iy FROM (
      SELECT *, (1::double + k_near.dx + k_near.dy) / 2 AS k_fx, (1::double - k_near.dx + k_near.dy) / 2 AS k_fy FROM (
      SELECT *, list_sort(list_transform({middles}, lambda m: struct_pack(d := abs({across}) + abs(k_py - m.y), f := m.f, dx := {across}, dy := k_py - m.y)))[1] AS k_near FROM (
      SELECT *, CASE WHEN abs(z) <= 2/3::double THEN 2 * k_q ELSE 2 * floor(k_q) + 1 + (2 * (k_q - floor(k_q)) - 1) * k_s END AS k_px,
        CASE WHEN abs(z) <= 2/3::double THEN 1.5::double * z ELSE sign(z) * (2 - k_s) END AS k_py FROM (
      SELECT *, ((phi * {2 / math.pi!r}::double) % 4::double + 4::double) % 4::double AS k_q, sth * sqrt(3::double / (1 + abs(z))) AS k_s FROM {source} q0) q1) q2) q3) q4) q5) q6)"""


def ring_sql(source: str, order: int, out: str = "pix_ring") -> str:
    """Adds the ring id to rows with z, sth, phi."""
    n = 1 << order
    return f"""(SELECT * EXCLUDE (k_za, k_tt, k_tp, k_root, k_jp, k_jm, k_ir, k_ip) FROM (
      SELECT *, CASE WHEN k_za <= 2/3::double THEN {2 * n * (n - 1)} + (k_ir - 1) * {4 * n} + k_ip
            WHEN z > 0 THEN 2 * k_ir * (k_ir - 1) + k_ip ELSE {12 * n * n} - 2 * k_ir * (k_ir + 1) + k_ip END::bigint AS {out} FROM (
      SELECT *, CASE WHEN k_za <= 2/3::double THEN ((((k_jp + k_jm - {n} + 1 + 1 - (k_ir & 1)) >> 1) % {4 * n}) + {4 * n}) % {4 * n}
            ELSE floor(k_tt * k_ir)::bigint % (4 * k_ir) END AS k_ip FROM (
      SELECT *, CASE WHEN k_za <= 2/3::double THEN {n} + 1 + k_jp - k_jm ELSE least({n}, k_jp + k_jm + 1) END AS k_ir FROM (
      SELECT *,
        CASE WHEN k_za <= 2/3::double THEN floor({n}::double * (0.5::double + k_tt) - {0.75 * n!r}::double * z) ELSE floor({n}::double * k_tp * k_root) END::bigint AS k_jp,
        CASE WHEN k_za <= 2/3::double THEN floor({n}::double * (0.5::double + k_tt) + {0.75 * n!r}::double * z) ELSE floor({n}::double * (1::double - k_tp) * k_root) END::bigint AS k_jm FROM (
      SELECT *, k_tt - least(3::double, floor(k_tt)) AS k_tp,
        CASE WHEN k_za < 0.99::double THEN sqrt(3::double * (1::double - k_za)) ELSE sth / sqrt((1::double + k_za) / 3::double) END AS k_root FROM (
      SELECT *, abs(z) AS k_za, ((phi * {2 / math.pi!r}::double) % 4::double + 4::double) % 4::double AS k_tt FROM {source} q0) q1) q2) q3) q4) q5) q6)"""


def face_parts_sql(source: str, order: int, pix: str) -> str:
    """Adds k_face, k_ix, k_iy of a nested id."""
    # A cell of order 0 is its face, and has no bits of its own.
    gather = lambda down: f"list_sum(list_transform(range(0, {order}), lambda i: ((({pix}) >> (2 * i + {down})) & 1) << i))::bigint" if order else "0::bigint"
    return f"""(SELECT *, (({pix}) >> {2 * order})::bigint AS k_face, {gather(0)} AS k_ix, {gather(1)} AS k_iy FROM {source} f0)"""


def place_sql(source: str, fx: str, fy: str, prefix: str = "c") -> str:
    """Adds {prefix}z, {prefix}sth, {prefix}phi, {prefix}x, {prefix}y of the point (fx, fy) of face k_face.

    The point is put on the plane, and colatitude and longitude are read off there.
    """
    middle = lambda place: "list_extract([" + ", ".join(str(pair[place]) for pair in FACE_MIDDLES) + "], k_face + 1)"
    return f"""(SELECT * EXCLUDE (k_px, k_py, k_up), {prefix}sth * cos({prefix}phi) AS {prefix}x, {prefix}sth * sin({prefix}phi) AS {prefix}y FROM (
      SELECT *, sqrt(greatest(0, CASE WHEN k_up > 0 THEN k_up * (2 - k_up) ELSE (1 - {prefix}z) * (1 + {prefix}z) END)) AS {prefix}sth FROM (
      SELECT *, CASE WHEN k_up > 0 THEN sign(k_py) * (1 - k_up) WHEN abs(k_py) < 2 THEN k_py / 1.5::double ELSE sign(k_py) END::double AS {prefix}z,
        CASE WHEN abs(k_py) >= 2 THEN 0 ELSE {math.pi / 4!r}::double * (({middle(0)} + k_px / least(1, 2 - abs(k_py)) + 8) % 8) END::double AS {prefix}phi FROM (
      SELECT *, CASE WHEN abs(k_py) > 1 THEN (2 - abs(k_py)) * (2 - abs(k_py)) / 3 ELSE 0 END::double AS k_up FROM (
      SELECT *, (({fx}) - ({fy}))::double AS k_px, ({middle(1)} + ({fx}) + ({fy}) - 1)::double AS k_py FROM {source} p0) p1) p2) p3) p4)"""


def centre_sql(source: str, order: int, pix: str = "pix_nest", prefix: str = "c") -> str:
    n = float(1 << order)
    return place_sql(face_parts_sql(source, order, pix), f"(k_ix + 0.5::double) / {n!r}::double", f"(k_iy + 0.5::double) / {n!r}::double", prefix)


def ring_of_nest_sql(source: str, order: int, pix: str = "pix_nest", out: str = "pix_ring") -> str:
    """Ring id of a nested id through its centre (an independent route to the integer formula)."""
    return f"""(SELECT * FROM {ring_sql(f"(SELECT * EXCLUDE (k_face, k_ix, k_iy, cz, csth, cphi, cx, cy) RENAME (z AS o_z, sth AS o_sth, phi AS o_phi), cz AS z, csth AS sth, cphi AS phi FROM {centre_sql(source, order, pix)})", order, out)})"""

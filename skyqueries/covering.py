"""Coverage sets built from the line items: set algebra, unique cells, text."""

from __future__ import annotations

from pyspark.sql import functions as F

from skylattice.functions.cells import npix, with_nest
from skylattice.operators import coverage
from skylattice.sources.coverage_text import PIECE, format_coverage, join_pieces, parse_coverage, text_tasks
from skyqueries import duck
from skyqueries.fixtures import (
    COVER_ORDER, COVER_SQL, cover, cover_pixels_sql, cover_runs, islands_sql, r_sql, rounded, sky, sky_sql, table,
)
from skyqueries.registry import query

_SHIFT = 2 * (29 - COVER_ORDER)
_A, _B = cover_pixels_sql("status = 'O'"), cover_pixels_sql("status = 'F'")
_ALL = cover_pixels_sql()


def _sides(spark, sf_dir):
    return cover(spark, sf_dir, "O"), cover(spark, sf_dir, "F")


@query("u01_merge_ranges", f"SELECT set_id, lo, hi FROM {islands_sql(_ALL)}")
def merge_ranges(spark, sf_dir):
    return coverage.coalesce(cover(spark, sf_dir), COVER_ORDER)


@query("u01_merge_ranges_unknown_order", f"SELECT set_id, lo, hi FROM {islands_sql(_ALL)}")
def merge_ranges_unknown_order(spark, sf_dir):
    """Nothing said about the order of the ranges: block sizes for the full 62 bits."""
    return coverage.coalesce(cover(spark, sf_dir))


@query("u01_ranges_of_values", f"SELECT set_id, lo, hi FROM {islands_sql('(SELECT DISTINCT l_suppkey % 3 AS set_id, l_orderkey AS pix FROM lineitem)', 0)}")
def ranges_of_values(spark, sf_dir):
    values = table(spark, sf_dir, "lineitem").select(F.expr("l_suppkey % 3").alias("set_id"), F.col("l_orderkey").alias("value"))
    return coverage.from_values(values)


@query("u02_union", f"SELECT set_id, lo, hi FROM {islands_sql(f'(SELECT * FROM {_A} UNION SELECT * FROM {_B})')}")
def union(spark, sf_dir):
    return coverage.union(*_sides(spark, sf_dir), COVER_ORDER)


@query("u03_intersection", f"SELECT set_id, lo, hi FROM {islands_sql(f'(SELECT * FROM {_A} INTERSECT SELECT * FROM {_B})')}")
def intersection(spark, sf_dir):
    return coverage.intersection(*_sides(spark, sf_dir), COVER_ORDER)


@query("u04_difference", f"SELECT set_id, lo, hi FROM {islands_sql(f'(SELECT * FROM {_A} EXCEPT SELECT * FROM {_B})')}")
def difference(spark, sf_dir):
    return coverage.difference(*_sides(spark, sf_dir), COVER_ORDER)


@query("u04_symmetric_difference", f"SELECT set_id, lo, hi FROM {islands_sql(f'((SELECT * FROM {_A} EXCEPT SELECT * FROM {_B}) UNION ALL (SELECT * FROM {_B} EXCEPT SELECT * FROM {_A}))')}")
def symmetric_difference(spark, sf_dir):
    return coverage.symmetric_difference(*_sides(spark, sf_dir), COVER_ORDER)


# The gaps between the merged ranges, and the ends of the sky.
_COMPLEMENT = f"""SELECT set_id, lo, hi FROM (SELECT set_id, hi AS lo, coalesce(lead(lo) OVER (PARTITION BY set_id ORDER BY lo), {npix(29)}) AS hi FROM (
    SELECT set_id, lo, hi FROM {islands_sql(_ALL)} UNION ALL SELECT DISTINCT set_id, 0, 0 FROM {COVER_SQL})) WHERE lo < hi"""


@query("u05_complement", _COMPLEMENT)
def complement(spark, sf_dir):
    return coverage.complement(cover(spark, sf_dir), COVER_ORDER)


_SETS = f"(SELECT DISTINCT set_id FROM {COVER_SQL})"


@query("u06_contains_value", f"SELECT set_id, value << {_SHIFT} AS value FROM (SELECT DISTINCT set_id, lo AS value FROM {COVER_SQL} WHERE status = 'F') p WHERE EXISTS (SELECT 1 FROM {_A} a WHERE a.set_id = p.set_id AND a.pix = p.value)")
def contains_value(spark, sf_dir):
    a, b = _sides(spark, sf_dir)
    return coverage.contains_values(a, b.select("set_id", F.col("lo").alias("value")).distinct(), COVER_ORDER)


@query("u06_contains_range", f"""SELECT set_id, probe_id, coalesce(n, 0) = len AS contains, coalesce(n, 0) > 0 AS overlaps FROM (
    SELECT p.set_id, p.probe_id, any_value(p.hi - p.lo) AS len, count(a.pix) AS n FROM (
      SELECT set_id, lo * 100 + len AS probe_id, lo, lo + len AS hi, unnest(CASE WHEN len = 0 THEN [-1] ELSE range(lo, lo + len) END) AS pix FROM (
        SELECT DISTINCT set_id, lo, CASE WHEN lo % 7 = 0 THEN 0 WHEN lo % 2 = 0 THEN hi - lo ELSE 3 END AS len FROM {COVER_SQL} WHERE status = 'F')) p
    LEFT JOIN {_A} a ON a.set_id = p.set_id AND a.pix = p.pix GROUP BY p.set_id, p.probe_id)""")
def contains_range(spark, sf_dir):
    a, _ = _sides(spark, sf_dir)
    probes = cover_runs(spark, sf_dir).where("status = 'F'").withColumn("len", F.expr("CASE WHEN lo % 7 = 0 THEN 0 WHEN lo % 2 = 0 THEN hi - lo ELSE 3 END"))
    probes = probes.select("set_id", F.expr("lo * 100 + len").alias("probe_id"), F.shiftleft("lo", _SHIFT).alias("lo"),
                           F.shiftleft(F.col("lo") + F.col("len"), _SHIFT).alias("hi")).distinct()
    return coverage.contains_ranges(a, probes, COVER_ORDER)


_HALF = f"(SELECT set_id, pix FROM {_A} WHERE set_id % 2 = 0 UNION SELECT set_id, pix FROM {_B} WHERE set_id % 2 = 1)"


@query("u06_contains_set", f"SELECT set_id, set_id NOT IN (SELECT set_id FROM ((SELECT * FROM {_HALF}) EXCEPT (SELECT * FROM {_A}))) AS contains FROM {_SETS}")
def contains_set(spark, sf_dir):
    a, b = _sides(spark, sf_dir)
    mixed = a.where("set_id % 2 = 0").unionByName(b.where("set_id % 2 = 1"))
    return coverage.contains_set(a, mixed, COVER_ORDER)


@query("u07_overlaps_set", f"SELECT set_id, set_id IN (SELECT set_id FROM (SELECT * FROM {_A} INTERSECT SELECT * FROM {_B})) AS overlaps FROM {_SETS}")
def overlaps_set(spark, sf_dir):
    return coverage.overlaps_set(*_sides(spark, sf_dir), COVER_ORDER)


@query("u08_summary", f"SELECT set_id, count(*)::bigint AS n_ranges, sum(hi - lo)::bigint AS n_values, {r_sql(f'sum(hi - lo) / {npix(29)}::double', 9)} AS sky_fraction FROM {islands_sql(_ALL)} GROUP BY set_id")
def summary(spark, sf_dir):
    found = coverage.summary(cover(spark, sf_dir), COVER_ORDER)
    return found.select("set_id", "n_ranges", "n_values", rounded("sky_fraction", 9).alias("sky_fraction"))


@query("u08_is_empty", "SELECT s_suppkey AS set_id, s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49 AND l_discount > 0.09) AS empty FROM supplier")
def is_empty(spark, sf_dir):
    sets = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("set_id"))
    ranges = table(spark, sf_dir, "lineitem").where("l_quantity > 49 AND l_discount > 0.09D").select(
        F.col("l_suppkey").alias("set_id"), F.col("l_orderkey").alias("lo"), (F.col("l_orderkey") + 1).alias("hi"))
    return coverage.is_empty(sets, ranges)


@query("u08_equal_sets", f"SELECT set_id, set_id % 2 = 0 AS equal FROM {_SETS}")
def equal_sets(spark, sf_dir):
    """Ranges against the same ranges cut in two; odd sets lose their other half."""
    ranges = cover(spark, sf_dir)
    cut = ranges.withColumn("mid", F.col("lo") + F.shiftright(F.col("hi") - F.col("lo"), 1))
    halves = cut.select("set_id", F.inline(F.expr(
        "CASE WHEN set_id % 2 = 0 THEN array(struct(lo, mid AS hi), struct(mid AS lo, hi)) ELSE array(struct(lo, mid AS hi)) END")))
    return coverage.equal_sets(ranges, halves)


def _well_formed_sql(pixels: str, order: int) -> str:
    """Cells filled by the pixels whose parent is not filled."""
    levels = " UNION ALL ".join(
        f"SELECT set_id, {o} AS ord, pix >> {2 * (order - o)} AS cell FROM px GROUP BY 1, 2, 3 HAVING count(*) = {4 ** (order - o)}" for o in range(order + 1))
    return f"""(WITH px AS MATERIALIZED (SELECT * FROM {pixels}), filled AS MATERIALIZED ({levels})
        SELECT set_id, ord, cell FROM filled f WHERE NOT EXISTS (SELECT 1 FROM filled p WHERE p.set_id = f.set_id AND p.ord = f.ord - 1 AND p.cell = f.cell >> 2))"""


_CELLS = _well_formed_sql(_ALL, COVER_ORDER)


@query("u09_to_unique_cells", f"""SELECT set_id, ord::integer AS "order", cell AS pix, cell + (4::bigint << (2 * ord)) AS uniq FROM {_CELLS}""")
def to_unique_cells(spark, sf_dir):
    return coverage.to_uniq(coverage.coalesce(cover(spark, sf_dir), COVER_ORDER), COVER_ORDER)


# Mixed orders, overlapping: the run's first cell at orders 9, 8 and 7 by line number.
_MIXED = f"(SELECT set_id, lo >> (2 * (lo % 3)) AS cell, (9 - lo % 3)::integer AS ord FROM {COVER_SQL})"
_MIXED_PIXELS = f"(SELECT DISTINCT set_id, unnest(range(cell << (2 * (9 - ord)), (cell + 1) << (2 * (9 - ord)))) AS pix FROM {_MIXED})"


@query("u10_from_unique_cells", f"SELECT set_id, lo, hi FROM {islands_sql(_MIXED_PIXELS)}")
def from_unique_cells(spark, sf_dir):
    cells = cover_runs(spark, sf_dir).select("set_id", F.expr(
        "shiftright(lo, cast(2 * (lo % 3) AS int)) + shiftleft(4L, cast(2 * (9 - lo % 3) AS int))").alias("uniq"))
    return coverage.from_uniq(cells, COVER_ORDER)


@query("u10_from_cells", f"SELECT set_id, lo, hi FROM {islands_sql(_MIXED_PIXELS)}")
def from_cells(spark, sf_dir):
    cells = cover_runs(spark, sf_dir).select(
        "set_id", F.expr("cast(9 - lo % 3 AS int)").alias("order"), F.expr("shiftright(lo, cast(2 * (lo % 3) AS int))").alias("pix"))
    return coverage.from_cells(cells, COVER_ORDER)


@query("u11_degrade_keep", f"SELECT set_id, lo, hi FROM {islands_sql(f'(SELECT DISTINCT set_id, pix >> 4 AS pix FROM {_ALL})', _SHIFT + 4)}")
def degrade_keep(spark, sf_dir):
    return coverage.degrade(cover(spark, sf_dir), 7, True, COVER_ORDER)


@query("u11_degrade_drop", f"SELECT set_id, lo, hi FROM {islands_sql(f'(SELECT set_id, pix >> 2 AS pix FROM {_ALL} GROUP BY ALL HAVING count(*) = 4)', _SHIFT + 2)}")
def degrade_drop(spark, sf_dir):
    return coverage.degrade(cover(spark, sf_dir), 8, False, COVER_ORDER)


@query("u12_finest_order", f"""SELECT set_id, max(CASE WHEN lo % {4 ** 20 * 4} = 0 AND hi % {4 ** 20 * 4} = 0 THEN 8 ELSE 9 END)::integer AS max_order FROM {islands_sql(_ALL)} GROUP BY set_id""")
def finest_order(spark, sf_dir):
    return coverage.finest_order(cover(spark, sf_dir), COVER_ORDER)


@query("u13_expand_pixels", f"SELECT DISTINCT set_id, pix >> 2 AS pix FROM {_ALL}")
def expand_pixels(spark, sf_dir):
    return coverage.to_pixels(cover(spark, sf_dir), 8, COVER_ORDER)


@query("u13_expand_values", f"SELECT set_id, pix FROM {_ALL}")
def expand_values(spark, sf_dir):
    merged = coverage.coalesce(cover(spark, sf_dir), COVER_ORDER)
    return coverage.expand(merged.select("set_id", F.shiftright("lo", _SHIFT).alias("lo"), F.shiftright("hi", _SHIFT).alias("hi")), chunk=16)


_SKY_PIXELS = f"(SELECT pix_nest AS pix, sum(weight) AS value FROM {duck.nest_sql(sky_sql('orders'), COVER_ORDER)} GROUP BY pix_nest)"


@query("u14_weighted_sum", f"SELECT set_id, sum(value)::double AS total FROM {_ALL} JOIN {_SKY_PIXELS} USING (pix) GROUP BY set_id")
def weighted_sum(spark, sf_dir):
    cells = with_nest(sky(spark, sf_dir, "orders"), COVER_ORDER, "pix").groupBy("pix").agg(F.sum("weight").alias("value"))
    return coverage.weighted_sum(cover(spark, sf_dir), cells, COVER_ORDER, COVER_ORDER)


@query("u14_range_sums", f"""SELECT set_id, (lo << {2 * (29 - COVER_ORDER)})::bigint AS lo, (hi << {2 * (29 - COVER_ORDER)})::bigint AS hi, count(value)::bigint AS cells,
    coalesce(sum(value), 0)::double AS total FROM (SELECT DISTINCT set_id, lo, hi, unnest(range(lo, hi)) AS pix FROM {COVER_SQL}) LEFT JOIN {_SKY_PIXELS} USING (pix) GROUP BY set_id, lo, hi""")
def range_sums(spark, sf_dir):
    """Each run on its own, overlapping ones too."""
    cells = with_nest(sky(spark, sf_dir, "orders"), COVER_ORDER, "pix").groupBy("pix").agg(F.sum("weight").alias("value"))
    return coverage.range_sums(cover(spark, sf_dir), cells, COVER_ORDER)


@query("u15_from_pixel_ranges", f"SELECT set_id, lo, hi FROM {islands_sql(_ALL)}")
def from_pixel_ranges(spark, sf_dir):
    return coverage.from_pixel_ranges(cover_runs(spark, sf_dir), COVER_ORDER)


@query("j06_points_in_coverage", f"SELECT id, set_id FROM (SELECT id, pix_nest AS pix FROM {duck.nest_sql(sky_sql('orders'), COVER_ORDER)}) JOIN {_ALL} USING (pix)")
def points_in_coverage(spark, sf_dir):
    points = with_nest(sky(spark, sf_dir, "orders"), 29, "pix29").select("id", "pix29")
    return coverage.points_in_sets(points, cover(spark, sf_dir), order=COVER_ORDER).select("id", "set_id")


# --- text -------------------------------------------------------------------------------------------


def _texts(spark, sf_dir, json):
    """Untidy text maps: one per supplier, runs of order-9 cells and single order-8 cells, in no order."""
    runs = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("set_id"), F.col("l_linenumber").alias("line"), F.expr(f"(l_orderkey * 1009 + l_partkey * 31) % {npix(9) - 80}").alias("lo"))
    if json:
        fine = F.expr("CASE WHEN line < 4 THEN concat_ws(',', transform(sequence(lo, lo + line), v -> cast(v AS string))) END")
        coarse = F.expr("CASE WHEN line >= 4 THEN cast(lo div 4 AS string) END")
        text = "concat('{\"9\":[', concat_ws(',', collect_list(fine)), '], \"8\":[', concat_ws(',', collect_list(coarse)), ']}')"
    else:
        fine = F.expr("CASE WHEN line < 4 THEN concat(cast(lo AS string), '-', cast(lo + line AS string)) END")
        coarse = F.expr("CASE WHEN line >= 4 THEN cast(lo div 4 AS string) END")
        text = "concat('9/', concat_ws(',', collect_list(fine)), ' 8/', concat_ws(' ', collect_list(coarse)))"
    runs = runs.select("set_id", fine.alias("fine"), coarse.alias("coarse")).repartition(text_tasks(spark), "set_id")
    return runs.groupBy("set_id").agg(F.expr(text).alias("text"))


_TEXT_RUNS = f"(SELECT l_suppkey AS set_id, l_linenumber AS line, (l_orderkey * 1009 + l_partkey * 31) % {npix(9) - 80} AS lo FROM lineitem)"
_TEXT_PIXELS = f"""(SELECT DISTINCT set_id, unnest(CASE WHEN line < 4 THEN range(lo, lo + line + 1) ELSE range(lo // 4 * 4, lo // 4 * 4 + 4) END) AS pix FROM {_TEXT_RUNS})"""


@query("s09_read_coverage_ascii", f"SELECT set_id, lo, hi FROM {islands_sql(_TEXT_PIXELS)}")
def read_coverage_ascii(spark, sf_dir):
    return parse_coverage(_texts(spark, sf_dir, False), COVER_ORDER)


@query("s09_read_coverage_json", f"SELECT set_id, lo, hi FROM {islands_sql(_TEXT_PIXELS)}")
def read_coverage_json(spark, sf_dir):
    return parse_coverage(_texts(spark, sf_dir, True), COVER_ORDER)


_RUNS_OF_CELLS = f"(SELECT set_id, ord, min(cell) AS first, max(cell) AS last FROM (SELECT *, cell - row_number() OVER (PARTITION BY set_id, ord ORDER BY cell) AS island FROM {_CELLS}) GROUP BY set_id, ord, island)"


@query("s10_write_coverage_ascii", f"""SELECT set_id, ord AS "order", first // {PIECE} AS part, ord || '/' || string_agg(
    CASE WHEN first = last THEN first::varchar ELSE first || '-' || last END, ',' ORDER BY first) AS text FROM {_RUNS_OF_CELLS} GROUP BY set_id, ord, first // {PIECE}""")
def write_coverage_ascii(spark, sf_dir):
    return format_coverage(cover(spark, sf_dir), order=COVER_ORDER)


@query("s10_write_coverage_json", f"""SELECT set_id, ord AS "order", cell // {PIECE} AS part, '{{"' || ord || '":[' || string_agg(
    cell::varchar, ',' ORDER BY cell) || ']}}' AS text FROM {_CELLS} GROUP BY set_id, ord, cell // {PIECE}""")
def write_coverage_json(spark, sf_dir):
    return format_coverage(cover(spark, sf_dir), json=True, order=COVER_ORDER)


@query("s10_joined_text", f"""SELECT set_id, string_agg(section, ' ' ORDER BY ord) AS text FROM (SELECT set_id, ord, ord || '/' || string_agg(
    CASE WHEN first = last THEN first::varchar ELSE first || '-' || last END, ',' ORDER BY first) AS section FROM {_RUNS_OF_CELLS} GROUP BY set_id, ord) GROUP BY set_id""")
def joined_text(spark, sf_dir):
    return join_pieces(format_coverage(cover(spark, sf_dir), order=COVER_ORDER))


@query("s10_text_round_trip", f"SELECT set_id, lo, hi FROM {islands_sql(_ALL)}")
def text_round_trip(spark, sf_dir):
    return parse_coverage(format_coverage(cover(spark, sf_dir), order=COVER_ORDER), COVER_ORDER)

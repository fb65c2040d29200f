import math

import pytest
from pyspark.sql import functions as F

from skylattice.functions.cells import npix, with_nest, with_ring
from skylattice.operators import maps, masks
from skylattice.operators.ranking import contiguous_regions, tile_shape, tiled_regions
from skylattice.plans import workloads
from skylattice.sources import catalogs, randoms, results
from skylattice.sources import masks as mask_files


def lines(spark, *texts):
    return spark.createDataFrame([(text,) for text in texts], "value string")


def test_malformed_lines_are_dropped_and_counted(spark):
    text = lines(spark, "ra,dec,w,id", "10,20,2,7", "10", "", "10,abc,1,1", "10,95,1,1", " 11 , -20 ,3,8", "NaN,1,1,1", "1,2,,3", "360,90,1,9", "1,-90,1,10,extra")
    rows = catalogs.parse_catalog(text, weight=2, id=3)
    assert sorted((row.id, row.ra, row.dec, row.weight) for row in rows.collect()) == [
        (7, 10.0, 20.0, 2.0), (8, 11.0, -20.0, 3.0), (9, 360.0, 90.0, 1.0), (10, 1.0, -90.0, 1.0)]
    counts = catalogs.rejected(text, weight=2, id=3).first()
    assert (counts.n_lines, counts.n_rejected) == (11, 7)
    plain = catalogs.parse_catalog(text).collect()
    assert {(row.id, row.weight) for row in plain} == {(-1, 1.0)} and len(plain) == 5


def test_mirrored_longitude(spark):
    row = catalogs.parse_catalog(lines(spark, "90,0")).first()
    assert (round(row.x, 12), round(row.y, 12)) == (0.0, -1.0)
    row = catalogs.parse_catalog(lines(spark, "90,0"), mirror=False).first()
    assert (round(row.x, 12), round(row.y, 12)) == (0.0, 1.0)


def test_mask_orders(spark):
    text = lines(spark, "pix,ra", "0,1", "5,9", "17", "x")
    pixels = lambda df: sorted(row.pix_nest for row in df.collect())
    assert pixels(mask_files.parse_mask(text, 3, 2)) == [0, 1, 4]
    assert pixels(mask_files.parse_mask(text, 3, 3)) == [0, 5, 17]
    assert pixels(mask_files.parse_mask(text, 3, 4)) == [0, 1, 2, 3, 20, 21, 22, 23, 68, 69, 70, 71]


def test_empty_mask(spark):
    points = catalogs.parse_catalog(lines(spark, "1,2", "3,4"))
    mask = spark.createDataFrame([], "pix_nest long")
    assert masks.filter_points(points, mask, 5).count() == 0
    assert masks.filter_points(points, mask, 5, exclude=True).count() == 2
    assert masks.mask_summary(mask, 5).first().mask_factor is None


def test_regions_share_the_mask_evenly(spark):
    order = 3
    mask = spark.range(100, 500).withColumnRenamed("id", "pix_nest")
    tiles = tiled_regions(mask, order, 16).collect()
    assert tile_shape(16) == (4, 4) and tile_shape(2) == (2, 1) and tile_shape(64) == (8, 8) and tile_shape(5) == (5, 1)
    sizes = {}
    for row in tiles:
        sizes[row.region] = sizes.get(row.region, 0) + 1
    assert sorted(sizes) == list(range(16)) and max(sizes.values()) - min(sizes.values()) <= 1
    runs = contiguous_regions(mask, order, 7).collect()
    assert len(runs) == 400
    lengths = [sum(row.region == region for row in runs) for region in range(7)]
    assert sum(lengths) == 400 and max(lengths) - min(lengths) == 1
    assert [row.region for row in sorted(runs, key=lambda row: row.pix_nest)] == sorted(row.region for row in runs)


def test_random_rows_do_not_depend_on_partitions(spark):
    ids = spark.range(2000)
    as_rows = lambda df: sorted(tuple(row) for row in df.select("id", "ra", "dec").collect())
    for make in (randoms.random_sphere, randoms.random_box):
        assert as_rows(make(ids, seed=3)) == as_rows(make(ids.repartition(7), seed=3)) == as_rows(make(spark, 2000, seed=3))
        assert as_rows(make(ids, seed=3)) != as_rows(make(ids, seed=4))


def test_random_counts(spark):
    counts = randoms.random_cells(spark, 4, 3072 * 20.0, seed=1)
    again = randoms.random_cells(spark, 4, 3072 * 20.0, seed=1)
    rows = lambda df: sorted(tuple(row) for row in df.collect())
    assert rows(counts) == rows(again)
    total = counts.agg(F.sum("weight")).first()[0]
    assert abs(total - 3072 * 20) < 6 * math.sqrt(3072 * 20)
    thin = randoms.random_cells(spark, 4, 100.0, seed=1)
    assert thin.where("weight = 0").count() == 0 and thin.count() < 200
    mask = spark.range(50).withColumnRenamed("id", "pix_nest")
    inside = randoms.random_cells(spark, 4, 5000.0, seed=2, mask=mask, mask_cells=50)
    assert inside.where("pix >= 50").count() == 0
    assert abs(inside.agg(F.sum("weight")).first()[0] - 5000) < 6 * math.sqrt(5000)


def test_map_round_trips(spark):
    order = 3
    rows = spark.range(npix(order)).select(F.lit(1).alias("map_id"), F.col("id").alias("pix"), (F.col("id") % 7).cast("double").alias("value"))
    as_set = lambda df: {tuple(row) for row in df.select("map_id", "pix", "value").collect()}
    assert as_set(maps.degrade(maps.upgrade(rows, 3, 5), 5, 3)) == as_set(rows)
    assert as_set(maps.to_nest(maps.to_ring(rows, 3), 3)) == as_set(rows)
    assert as_set(maps.regrid(maps.regrid(rows, 3, 4, "nest", "ring"), 4, 3, "ring", "nest")) == as_set(rows)
    holes = rows.where("pix % 4 <> 1")
    assert maps.degrade(holes, 3, 2, pessimistic=True).where("value IS NOT NULL").count() == 0
    assert maps.degrade(holes, 3, 2).where("value IS NULL").count() == 0
    undone = maps.set_pixels(rows, spark.createDataFrame([(1, 5, None)], "map_id int, pix long, value double"))
    assert undone.where("pix = 5").first().value is None
    assert maps.full(holes, 3).count() == npix(3)


def test_crossmatch_files(spark, tmp_path):
    (tmp_path / "x.csv").write_text("id,ra,dec\n1,10.0,20.0\n2,10.001,20.0\n3,200.0,-89.9999999\nbad\n")
    (tmp_path / "y.csv").write_text("7,10.0001,20.0\n8,10.00005,20.0\n9,20.0,-89.9999999\n10,50,50\n")
    for prefilter in (None, 11):
        workloads.run_crossmatch(spark, str(tmp_path / "x.csv"), str(tmp_path / "y.csv"), str(tmp_path / "out"), prefilter_order=prefilter)
        found = results.read_matches(spark, str(tmp_path / "out")).collect()
        assert {(row.x_id, row.y_id) for row in found} == {(1, 8), (3, 9)}


def test_createmask_file(spark, tmp_path):
    good = randoms.random_sphere(spark, 40000, seed=2)
    rows = good.select(F.concat_ws(",", F.col("ra"), F.col("dec"), F.expr("CASE WHEN z > 0 THEN 0.05 ELSE 0.5 END"), F.lit(26)).alias("value"))
    rows.write.text(str(tmp_path / "in"))
    workloads.run_createmask(spark, str(tmp_path / "in"), 2, str(tmp_path / "mask"))
    found = [row.value.split(",") for row in spark.read.text(str(tmp_path / "mask")).collect()]
    assert all(float(row[2]) > -15 and int(row[5]) > 15 for row in found)
    labels = [int(row[6]) for row in sorted(found, key=lambda row: int(row[0]))]
    size = len(labels)
    assert labels == [i // (size // 32) for i in range(size)]


@pytest.mark.parametrize("use_cells", [True, False])
def test_correlate_files(spark, tmp_path, use_cells):
    data, random = randoms.random_sphere(spark, 600, seed=5), randoms.random_sphere(spark, 2500, seed=6)
    for name, df in (("data", data), ("rand", random)):
        df.select(F.concat_ws(",", "ra", "dec")).write.text(str(tmp_path / name))
    mask = spark.range(npix(3)).where("id < 600 AND id % 9 <> 0")
    mask.select(F.col("id").cast("string")).write.text(str(tmp_path / "mask"))
    settings = workloads.CorrelationSettings(
        bins=4, min_radius=5.0, max_radius=40.0, order=4, mask_order=3, mask_coarse_order=0, mask_confidence=0.5, use_cells=use_cells)
    tables = workloads.run_correlate(
        spark, settings, str(tmp_path / "data"), str(tmp_path / "rand"), str(tmp_path / "mask"), str(tmp_path / "out"), str(tmp_path / "regions"))
    estimate = {row.bin: row for row in tables["estimate"].collect()}
    assert len(estimate) == 4
    # Two unclustered catalogues: nothing to see beyond the noise.
    assert all(abs(row.xi_full) < 0.25 and abs(row.xi_jk_mean) < 0.25 for row in estimate.values())
    regions = {row.region for row in tables["realisations"].collect()} - {None}
    written = spark.read.csv(str(tmp_path / "regions")).count()
    assert regions == set(range(len(regions))) and 8 <= len(regions) <= 10 and written > 2000
    folder = results.result_name(str(tmp_path / "out"), 4, 0, 0.5, len(regions))
    assert spark.read.csv(f"{folder}/covariance", header=True).count() == 16


def test_correlate_without_files_or_mask(spark):
    settings = workloads.CorrelationSettings(bins=3, min_radius=10.0, max_radius=40.0, order=3, data_size=200, rand_factor=3.0)
    tables = workloads.run_correlate(spark, settings)
    assert tables["estimate"].where("xi_full IS NULL").count() == 0
    assert "covariance" not in tables
    summary = tables["summary"].first()
    assert (summary.dsize, summary.rsize) == (200.0, 600.0)


def test_density_sums_do_not_depend_on_the_scheme(spark):
    points = randoms.random_sphere(spark, 5000, seed=9)
    both = with_ring(with_nest(points, 3), 3)
    assert both.groupBy("pix_nest").agg(F.countDistinct("pix_ring").alias("n")).where("n > 1").count() == 0


def _chi_squared(counts, cells, size):
    mean = size / len(cells)
    return sum((counts.get(cell, 0.0) - mean) ** 2 / mean for cell in cells)


@pytest.mark.parametrize("size", [0, 1, 50_000, 10**15])
def test_random_counts_of_a_total(spark, size):
    found = {row.pix: row.weight for row in randoms.random_counts_of_total(spark, 3, size, 4).collect()}
    assert sum(map(int, found.values())) == size and set(found) <= set(range(768))
    if size > 1000:
        # 767 degrees of freedom: six standard deviations around the mean.
        assert abs(_chi_squared(found, range(768), size) - 767) < 6 * (2 * 767) ** 0.5


def test_random_counts_of_a_total_in_kept_cells(spark):
    cells = [cell for cell in range(768) if cell % 7 == 3 or 100 <= cell < 164]
    table = spark.createDataFrame([(cell,) for cell in cells + cells[:9]] + [(None,)], "pix_nest long")
    runs = [
        {row.pix: row.weight for row in randoms.random_counts_of_total(spark, 3, 200_000, 5, table.repartition(parts)).collect()} for parts in (1, 6)
    ]
    assert runs[0] == runs[1] and set(runs[0]) == set(cells) and sum(runs[0].values()) == 200_000
    assert abs(_chi_squared(runs[0], cells, 200_000) - len(cells) + 1) < 6 * (2 * len(cells)) ** 0.5
    other = {row.pix: row.weight for row in randoms.random_counts_of_total(spark, 3, 200_000, 6, table).collect()}
    assert other != runs[0] and sum(other.values()) == 200_000
    assert randoms.random_counts_of_total(spark, 3, 10, 5, table.where("false")).count() == 0
    # Neighbouring cells are not tied: the spread of a parent's children is binomial too.
    pairs = [(runs[0][cell], runs[0][cell + 1]) for cell in range(100, 164, 2)]
    assert abs(sum((a - b) ** 2 / (a + b) for a, b in pairs) - len(pairs)) < 6 * (2 * len(pairs)) ** 0.5
    with pytest.raises(ValueError):
        randoms.random_counts_of_total(spark, 3, -1)


def test_short_texts_are_read_by_many_tasks(spark, monkeypatch):
    """A partition of texts may say far more than it holds: texts are dealt anew before they are read."""
    from skylattice.sources import coverage_text

    texts = spark.createDataFrame([(i % 3, f"5/{7 * i},{7 * i + 2}-{7 * i + 4}") for i in range(200)] + [(None, "3/1"), (1, None)], "set_id long, text string").coalesce(1)
    seen, plain = [], coverage_text.coalesce
    monkeypatch.setattr(coverage_text, "coalesce", lambda ranges, order: seen.append(ranges) or plain(ranges, order))
    coverage_text.parse_coverage(texts, 5)
    assert seen[0].rdd.getNumPartitions() == coverage_text.text_tasks(spark) > 1
    assert seen[0].where("set_id IS NULL").count() == 1 and seen[0].count() == 401

"""Sky tables derived from the driver tables, each as a DataFrame and as SQL text for the checking engine.

Positions come from keys by plain arithmetic, so both engines see the same sky.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# name: (table, key, turn per key in degrees, weight expression)
SKIES = {
    "customer": ("customer", "c_custkey", 137.50776405003785, "c_nationkey % 3 + 1"),
    "part": ("part", "p_partkey", 222.49223594996215, "p_size % 3 + 1"),
    "orders": ("orders", "o_orderkey", 137.50776405003785, "o_orderkey % 5 + 1"),
    "supplier": ("supplier", "s_suppkey", 99.50077637, "s_nationkey % 3 + 1"),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sky(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """(`id`, `weight`, `z`, `phi`, `x`, `y`, `theta`, `ra`, `dec`)."""
    source, key, turn, weight = SKIES[name]
    rows = table(spark, sf_dir, source)
    total = rows.agg(F.count("*").cast("double")).scalar()
    rows = rows.select(F.col(key).alias("id"), F.expr(f"cast({weight} AS double)").alias("weight"))
    rows = rows.withColumns({"z": 2.0 * (F.col("id") + 0.5) / total - 1.0, "phi": F.expr(f"radians((id * {turn!r}D) % 360D)")})
    return rows.withColumns({
        "x": F.expr("sqrt(1 - z*z) * cos(phi)"), "y": F.expr("sqrt(1 - z*z) * sin(phi)"), "theta": F.acos("z"),
        "ra": F.expr("360D - degrees(phi)"), "dec": F.expr("degrees(asin(z))"),
    })


def sky_sql(name: str, suffix: str = "") -> str:
    """The same rows as a parenthesised SELECT."""
    source, key, turn, weight = SKIES[name]
    return f"""(SELECT *, sqrt(1 - z*z) * cos(phi) AS x, sqrt(1 - z*z) * sin(phi) AS y, acos(z) AS theta, sqrt(1 - z*z) AS sth,
        360::double - degrees(phi) AS ra, degrees(asin(z)) AS "dec" FROM (
        SELECT {key} AS id, ({weight})::double AS weight,
          2::double * ({key} + 0.5::double) / (SELECT count(*) FROM {source})::double - 1::double AS z,
          radians(({key} * {turn!r}::double) % 360::double) AS phi FROM {source}))"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(`id`, `label`, `x`, `y`, `z`): first three embedding components at length one."""
    rows = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), "label", *[F.get("embedding", i).cast("double").alias(f"e{i}") for i in range(3)])
    rows = rows.withColumn("size", F.expr("sqrt(e0*e0 + e1*e1 + e2*e2)"))
    return rows.select("id", "label", *[F.expr(f"e{i} / size").alias(c) for i, c in enumerate("xyz")])


VECTORS_SQL = """(SELECT id, label, e0 / size AS x, e1 / size AS y, e2 / size AS z FROM (
    SELECT *, sqrt(e0*e0 + e1*e1 + e2*e2) AS size FROM (
    SELECT vec_id AS id, label, embedding[1]::double AS e0, embedding[2]::double AS e1, embedding[3]::double AS e2 FROM embeddings)))"""

# Coverage sets: one per supplier-derived id, runs of cells at this order from the line items.
COVER_ORDER = 9
_COVER_CELLS = 12 << (2 * COVER_ORDER)
_COVER_START = f"(l_orderkey * 1009 + l_partkey * 31) % {_COVER_CELLS - 80}"


def cover_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(`set_id`, `status`, `lo`, `hi`): unmerged, overlapping runs of order-9 cells."""
    return table(spark, sf_dir, "lineitem").select(
        F.expr("l_suppkey % 7").alias("set_id"), F.col("l_linestatus").alias("status"),
        F.expr(_COVER_START).alias("lo"), F.expr(f"{_COVER_START} + l_linenumber * 10").alias("hi"))


def cover(spark: SparkSession, sf_dir: str, status: str | None = None) -> DataFrame:
    """The runs as ranges at order 29, all or those of one line status."""
    runs = cover_runs(spark, sf_dir)
    if status:
        runs = runs.where(F.col("status") == status)
    shift = 2 * (29 - COVER_ORDER)
    return runs.select("set_id", F.shiftleft("lo", shift).alias("lo"), F.shiftleft("hi", shift).alias("hi"))


COVER_SQL = f"""(SELECT l_suppkey % 7 AS set_id, l_linestatus AS status, {_COVER_START} AS lo,
    {_COVER_START} + l_linenumber * 10 AS hi FROM lineitem)"""


def cover_pixels_sql(where: str = "true") -> str:
    """Distinct (set_id, pix) of the runs, pix at order 9."""
    return f"(SELECT DISTINCT set_id, unnest(range(lo, hi)) AS pix FROM {COVER_SQL} WHERE {where})"


def islands_sql(pixels: str, shift: int = 2 * (29 - COVER_ORDER)) -> str:
    """Merged ranges of a pixel query, shifted to order 29."""
    return f"""(SELECT set_id, (min(pix) << {shift})::bigint AS lo, ((max(pix) + 1) << {shift})::bigint AS hi FROM (
        SELECT set_id, pix, pix - row_number() OVER (PARTITION BY set_id ORDER BY pix) AS island FROM {pixels}) GROUP BY set_id, island)"""


def rounded(name: str | Column, digits: int = 6) -> Column:
    """A double made comparable between engines; adding zero removes the sign of zero."""
    column = F.col(name) if isinstance(name, str) else name
    return F.round(column, digits) + F.lit(0.0)


def rounded_often(name: str, digits: int) -> Column:
    """`rounded` for very many rows: through whole numbers, and as decimal text only where the digit that decides is close to a tie."""
    column, ten = F.col(name), float(10**digits)
    scaled = column * ten
    # Below 2^40 the product is good to 2^-13.
    clear = (F.abs(scaled) < 2.0**40) & (F.abs(scaled - F.floor(scaled) - 0.5) > 1e-3)
    return F.when(clear, F.floor(scaled + 0.5) / ten).otherwise(F.round(column, digits)) + F.lit(0.0)


def r_sql(expression: str, digits: int = 6) -> str:
    return f"(round(({expression})::double, {digits}) + 0::double)"

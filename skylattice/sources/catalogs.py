"""Comma-separated catalogues: positional columns, rows that do not parse are dropped (and can be counted)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.functions.angles import phi_of_ra, theta_of_dec, with_vector


def _number(position: int, kind: str) -> Column:
    return F.get(F.split("value", ","), position).try_cast(kind)


def _finite(value: Column) -> Column:
    return F.when(F.isnan(value) | (F.abs(value) == F.lit(float("inf"))), F.lit(None)).otherwise(value)


def _fields(
    lines: DataFrame, ra: int, dec: int, weight: int, id: int, extra: dict[str, int] | None
) -> DataFrame:
    """Every line's wanted fields, and `usable`: all of them present and in range."""
    fields = {
        "id": F.lit(-1).cast("bigint") if id < 0 else _number(id, "bigint"),
        "ra": _finite(_number(ra, "double")),
        "dec": _finite(_number(dec, "double")),
        "weight": F.lit(1.0) if weight < 0 else _finite(_number(weight, "double")),
        **{name: _number(position, "double") for name, position in (extra or {}).items()},
    }
    rows = lines.select(*[value.alias(name) for name, value in fields.items()])
    present = " AND ".join(f"{name} IS NOT NULL" for name in fields)
    return rows.withColumn("usable", F.expr(f"coalesce({present} AND abs(dec) <= 90, false)"))


def parse_catalog(
    lines: DataFrame, ra: int = 0, dec: int = 1, weight: int = -1, id: int = -1, extra: dict[str, int] | None = None,
    mirror: bool = True,
) -> DataFrame:
    """Lines (`value`) to `id`, `ra`, `dec`, `weight`, extra doubles, angles and unit vector.

    A negative position means absent: weight 1.0, id -1.  A row is dropped when a wanted field is missing or not a
    number, or when |dec| > 90.  A header drops out the same way.
    """
    rows = _fields(lines, ra, dec, weight, id, extra).where("usable").drop("usable")
    rows = rows.withColumns({"theta": theta_of_dec(F.col("dec")), "phi": phi_of_ra(F.col("ra"), mirror)})
    return with_vector(rows)


def read_catalog(spark: SparkSession, path: str, **columns) -> DataFrame:
    return parse_catalog(spark.read.text(path), **columns)


def parse_match_catalog(lines: DataFrame, mirror: bool = True) -> DataFrame:
    """Lines `id,ra,dec,...`."""
    return parse_catalog(lines, ra=1, dec=2, id=0, mirror=mirror)


def read_match_catalog(spark: SparkSession, path: str, mirror: bool = True) -> DataFrame:
    return parse_match_catalog(spark.read.text(path), mirror)


def parse_calibration(lines: DataFrame, mirror: bool = True) -> DataFrame:
    """Lines `ra,dec,v1,v2,...`."""
    return parse_catalog(lines, extra={"v1": 2, "v2": 3}, mirror=mirror)


def read_calibration(spark: SparkSession, path: str, mirror: bool = True) -> DataFrame:
    return parse_calibration(spark.read.text(path), mirror)


def rejected(
    lines: DataFrame, ra: int = 0, dec: int = 1, weight: int = -1, id: int = -1, extra: dict[str, int] | None = None
) -> DataFrame:
    """One row: `n_lines`, `n_rejected` for the same arguments as `parse_catalog`."""
    return _fields(lines, ra, dec, weight, id, extra).agg(
        F.count("*").alias("n_lines"), F.count_if(~F.col("usable")).alias("n_rejected"))


def unit_points(df: DataFrame, ra: str = "ra", dec: str = "dec", mirror: bool = True) -> DataFrame:
    """Angles and unit vector for any table with positions in degrees; rows with |dec| > 90 or NULL are dropped."""
    rows = df.where(F.abs(F.col(dec)) <= 90.0)
    return with_vector(rows.withColumns({"theta": theta_of_dec(F.col(dec)), "phi": phi_of_ra(F.col(ra), mirror)}))

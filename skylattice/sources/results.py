"""Writers of match tables and correlation results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_matches(matches: DataFrame, path: str, format: str = "csv") -> None:
    """(`x_id`, `y_id`, `sep_rel`), replacing the folder."""
    matches.select("x_id", "y_id", "sep_rel").write.mode("overwrite").format(format).save(path)


def read_matches(spark, path: str, format: str = "csv") -> DataFrame:
    return spark.read.schema("x_id bigint, y_id bigint, sep_rel double").format(format).load(path)


def parse_match_export(lines: DataFrame, x: int = 0, y: int = 3, sep: int = 6) -> DataFrame:
    """Another tool's match table: x id, y id and separation by position; other lines are dropped."""
    field = F.split("value", ",")
    return lines.select(
        F.get(field, x).try_cast("bigint").alias("x_id"),
        F.get(field, y).try_cast("bigint").alias("y_id"),
        F.get(field, sep).try_cast("double").alias("sep"),
    ).where("x_id IS NOT NULL AND y_id IS NOT NULL AND sep IS NOT NULL")


def result_name(base: str, order: int, coarse_order: int, confidence: float, regions: int) -> str:
    """Folder name that carries the run's parameters."""
    return f"{base}_highlevel_{order}__masklowlevel_{coarse_order}_conf_{confidence}_jk_{regions}"


def write_correlation(tables: dict[str, DataFrame], folder: str, format: str = "csv") -> None:
    """One sub-folder per result table (bins, estimate, realisations, covariance, summary)."""
    for name, table in tables.items():
        table.write.mode("overwrite").format(format).option("header", "true").save(f"{folder}/{name}")

"""Sinks: CSV, JSON, one folder per sheet, and results kept by run id."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def flat(frame: DataFrame) -> DataFrame:
    """Nested columns as JSON text, for sinks that have none."""
    return frame.select(*(F.to_json(c).alias(c) if k.startswith(("array", "struct", "map")) else F.col(c) for c, k in frame.dtypes))


def write_csv(frame: DataFrame, path: str, columns: list[str] | None = None, mode: str = "overwrite") -> None:
    flat(frame.select(*columns) if columns else frame).write.mode(mode).option("header", mode != "append").option("escape", '"').csv(path)


def write_json(frame: DataFrame, path: str, mode: str = "overwrite") -> None:
    frame.write.mode(mode).json(path)


def write_sheets(sheets: Mapping[str, DataFrame], path: str) -> None:
    for name, frame in sheets.items():
        write_csv(frame, f"{path}/{name}")


def kept_or_computed(spark: SparkSession, path: str, compute: Callable[[], DataFrame], overwrite: bool = False) -> DataFrame:
    """The result stored at the path, computed and stored first if there is none or overwrite is set."""
    if not overwrite:
        try:
            return spark.read.parquet(path)
        except Exception as e:  # Spark has no other test that works for every store
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
    compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)

"""Writers with checks."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from panelyard.functions.capacity import forecast_invert


class ForecastError(AssertionError):
    """A forecast table must not be written."""


def forecast_table(predictions: DataFrame, ids: Sequence[str] = ("id",), log_pred: str = "pred") -> DataFrame:
    return predictions.select(*ids, forecast_invert(F.col(log_pred)).alias("value"))


def forecast_checks() -> list[Column]:
    """Aggregates over a forecast table: rows, missing values, negative values."""
    v = F.col("value")
    missing = v.isNull() | F.isnan(v)
    return [F.count("*").alias("rows"), F.count(F.when(missing, 1)).alias("missing"), F.count(F.when(v < 0, 1)).alias("negative")]


def write_forecast(predictions: DataFrame, expected_rows: int, path: str, ids: Sequence[str] = ("id",), fmt: str = "csv") -> None:
    """Linear, non-negative forecasts. The rows are counted and every value is checked while they are written beside
    ``path``; the result takes its place only if all is well, and what was there stays otherwise."""
    found = Observation()
    beside = f"{path.rstrip('/')}.part-{uuid.uuid4().hex}"
    try:
        write_table(forecast_table(predictions, ids).observe(found, *forecast_checks()), beside, fmt)
        facts = found.get
        if facts["rows"] != expected_rows or facts["missing"] or facts["negative"]:
            raise ForecastError(f"expected {expected_rows} clean rows, found {facts}")
        replace_folder(predictions.sparkSession, beside, path)
    finally:
        delete_folder(predictions.sparkSession, beside)


def folder_of(spark: SparkSession, path: str) -> tuple:
    """The folder and its file system, as Spark's own writers see them."""
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(context._jsc.hadoopConfiguration())


def delete_folder(spark: SparkSession, path: str) -> None:
    folder, system = folder_of(spark, path)
    system.delete(folder, True)


def replace_folder(spark: SparkSession, fresh: str, path: str) -> None:
    """Move ``fresh`` to ``path`` by renames; an older folder there is moved aside first and deleted last."""
    (new, system), (target, _) = folder_of(spark, fresh), folder_of(spark, path.rstrip("/"))
    aside = folder_of(spark, f"{path.rstrip('/')}.old-{uuid.uuid4().hex}")[0]
    there = system.exists(target)
    if there and not system.rename(target, aside):
        raise OSError(f"cannot move {path} aside")
    if not system.rename(new, target):
        if there:
            system.rename(aside, target)
        raise OSError(f"cannot move the new table to {path}")
    if there:
        system.delete(aside, True)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    """Replace the table at ``path``."""
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def write_tables(tables: Mapping[str, DataFrame], folder: str, fmt: str = "parquet") -> None:
    for name, df in tables.items():
        write_table(df, f"{folder.rstrip('/')}/{name}", fmt)

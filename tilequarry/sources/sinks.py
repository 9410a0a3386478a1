"""Writers: manifests by slide, failures of a run, and checks of a table's columns before it is appended to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_slide_manifests(rows: DataFrame, path: str) -> None:
    """One partition for each slide; only slides in rows are replaced. A slide is complete once its partition is there."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("image_id").parquet(path)


def complete_slides(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("image_id").distinct()


def check_columns(table: DataFrame, columns: list[str]) -> None:
    """Refuse to append to a table with other columns or another order of them."""
    if table.columns != columns:
        raise ValueError(f"the table has the columns {table.columns}, not {columns}")


def write_failures(results: DataFrame, path: str, run: str) -> None:
    """The failures of one run as CSV with a header, also if there are none; a run is never overwritten."""
    failed = results.where("status = 'failed'").select("image_id", F.coalesce("reason", F.lit("unknown")).alias("reason"))
    failed.coalesce(1).write.mode("errorifexists").option("header", True).csv(f"{path}/run={run}")


def write_in_batches(rows: DataFrame, path: str, size: int = 50) -> None:
    """Append rows in files of at most size rows."""
    rows.write.mode("append").option("maxRecordsPerFile", size).parquet(path)

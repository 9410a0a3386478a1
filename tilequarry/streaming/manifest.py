"""Incremental manifest appends: a file stream whose batches are appended idempotently."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StringType, StructField, StructType

from ..operators.manifests import classify


def append_stream(stream: DataFrame, path: str, checkpoint: str, run: str, keys: list[str], columns: list[str], order: list[str]) -> None:
    """Run all available input through; each micro-batch appends the rows whose key is new.

    A batch that is run again after a failure writes its own folder again, so it adds nothing twice.
    """
    schema = stream.select(*keys, *columns).schema

    def add(batch: DataFrame, number: int) -> None:
        own = f"{run}-{number}"
        held = read_manifest(batch.sparkSession, path, schema).where(f"batch <> '{own}'")
        fresh = classify(batch, held, keys, columns, order).where("status = 'appended'").select(*keys, *columns)
        fresh.write.mode("overwrite").parquet(f"{path}/batch={own}")

    query = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def read_manifest(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All appended rows with the name of their batch; an absent manifest is empty."""
    full = StructType([*schema.fields, StructField("batch", StringType())])
    try:
        return spark.read.schema(full).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], full)

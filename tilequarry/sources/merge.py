"""Merging shards of manifest rows into a manifest on disk: one classified write a run, and a commit that makes it count.

A run writes all its rows in one job, by what becomes of them: `part=data` holds the rows that are appended, `part=rejected`
those that are malformed or conflict, with the reason. Then it leaves a marker in `commits`; readers take the runs that
have one. A run that was lost before its marker is written again from the start, and one that has it is not repeated.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..operators.manifests import classify


def committed(spark: SparkSession, path: str) -> DataFrame:
    """(run) of every run that counts."""
    try:
        return spark.read.schema("run string").parquet(f"{path}/commits")
    except AnalysisException:
        return spark.createDataFrame([], "run string")


def read_part(spark: SparkSession, path: str, part: str, schema: StructType) -> DataFrame:
    """The rows of a part (data or rejected) of all runs that count, with `run`; rejected rows have a `reason`."""
    full = StructType([*schema.fields, StructField("reason", StringType()), StructField("run", StringType()), StructField("part", StringType())])
    try:
        rows = spark.read.schema(full).parquet(f"{path}/runs")
    except AnalysisException:
        rows = spark.createDataFrame([], full)
    rows = rows.where(F.col("part") == part).join(F.broadcast(committed(spark, path)), "run", "left_semi").drop("part")
    return rows.drop("reason") if part == "data" else rows


def merge_run(shards: DataFrame, path: str, run: str, keys: list[str], columns: list[str], order: list[str], malformed: str = "false", fallback: list[str] | None = None) -> bool:
    """Merge rows into the manifest at path; False if the run was merged before.

    malformed is a condition in SQL. Rows that are identical to one held are left out; nothing else is lost.
    """
    spark = shards.sparkSession
    if committed(spark, path).where(F.col("run") == run).limit(1).count():
        return False
    kept = [*dict.fromkeys([*keys, *columns, *(fallback or [])])]
    held = read_part(spark, path, "data", shards.select(*kept).schema)
    bad = F.coalesce(F.expr(malformed), F.lit(True))
    good = classify(shards.where(~bad), held, keys, columns, order, fallback).where("status <> 'identical'")
    rows = good.select(*kept, F.when(F.col("status") == "conflicting", "conflicts with the row that holds the key").alias("reason"))
    rows = rows.unionByName(shards.where(bad).select(*kept, F.lit("malformed").alias("reason")))
    rows = rows.withColumn("part", F.when(F.col("reason").isNull(), "data").otherwise("rejected"))
    rows.write.mode("overwrite").partitionBy("part").parquet(f"{path}/runs/run={run}")
    spark.createDataFrame([(run,)], "run string").coalesce(1).write.mode("append").parquet(f"{path}/commits")
    return True

"""Intermediate tables in the folder that driver and executors share, so that lineage ends there."""

from __future__ import annotations

import re
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []
_path_of: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in a local session without one."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tilequarry-"))
        folder = sc.getCheckpointDir()
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, kind: str = "tilequarry") -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it again, so that its lineage ends there."""
    spark = df.sparkSession
    path = fresh_path(spark)
    df.write.parquet(path)
    _written.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    _path_of[out] = path
    return out


def delete(spark: SparkSession, path: str) -> bool:
    """Delete a table of this process."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables that `materialize` gave and that nothing reads any more; what was made of them must have been stored."""
    for t in tables:
        path = _path_of.pop(t)
        _written.remove(path)
        delete(t.sparkSession, path)


def release(spark: SparkSession) -> int:
    """Delete what `materialize` wrote in this process; results that still read from it must have been stored. The number of tables."""
    n = 0
    while _written:
        n += delete(spark, _written.pop())
    return n

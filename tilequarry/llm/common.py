"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..operators.graphs import components as components
from ..sources.scratch import discard as discard
from ..sources.scratch import materialize as materialize
from ..sources.scratch import shared_dir as shared_dir

#: ASCII white space, the only separators between words. bytes.split() splits at exactly these.
SPACE = " \t\n\x0b\x0c\r"


#: Tasks among which `spread_join` deals the rows of a key.
SALTS = 32
#: Bytes of text that a batch of `map_frames` holds; a longer text is a batch of its own.
FRAME_BYTES = 2 << 20
#: Bytes of an Arrow batch on its way to a Python worker, which both sides hold; Spark's default is 64 MB.
ARROW_BYTES = 4 << 20


def cut_batch(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `most` bytes of strings; one row at least."""
    size = np.zeros(batch.num_rows, np.int64)
    for col in batch.columns:
        if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) or pa.types.is_binary(col.type):
            size += pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size)
    at = 0
    while at < batch.num_rows:
        done = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def small_batches(spark: SparkSession) -> None:
    """Limit the session's Arrow batches to ARROW_BYTES, unless it has a limit of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, f"{ARROW_BYTES}b")


def map_frames(
    df: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str | StructType, exact: tuple[str, ...] = ("doc_id",), most: int = FRAME_BYTES
) -> DataFrame:
    """mapInPandas with batches of about `most` bytes of strings, in which the columns `exact` stay Arrow arrays.

    A 64-bit id beside a null would otherwise pass through a float and lose its last digits.
    """
    small_batches(df.sparkSession)
    fields = to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)

    def frame(batch: pa.RecordBatch) -> pd.DataFrame:
        held = {n: pd.Series(pd.arrays.ArrowExtensionArray(pa.chunked_array([c]))) if n in exact else c.to_pandas() for n, c in zip(batch.schema.names, batch.columns, strict=True)}
        return pd.DataFrame(held)

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in run(frame(part) for batch in batches for part in cut_batch(batch, most)):
            yield from pa.Table.from_pandas(out, schema=fields, preserve_index=False).to_batches()

    return df.mapInArrow(frames, schema)


def spread_join(rows: DataFrame, facts: DataFrame, key: str, few: bool) -> DataFrame:
    """Left join of rows with one row of facts for each key: broadcast if those are few, else dealt so that no key is gathered in one task."""
    if few:
        return rows.join(F.broadcast(facts), key, "left")
    salted = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # The salt comes from the row's place, so a task that runs again deals its rows alike.
    return rows.withColumn("_salt", (F.monotonically_increasing_id() % SALTS).cast("int")).join(salted, [key, "_salt"], "left").drop("_salt")


def hash_parts(n_rows: int, per_part: int = 20_000) -> int:
    """Number of buckets so that one holds about per_part rows."""
    return max(1, -(-int(n_rows) // per_part))


def gapless_rank(df: DataFrame, keys: list[str], order: str, buckets: int, name: str) -> DataFrame:
    """Number the rows 0, 1, 2 ... within each value of keys without gathering a key in one task.

    Rows are dealt to hash buckets, numbered inside the bucket, and shifted by the rows of the
    buckets before it. The order is that of the buckets, then of `order`, and is the same each run.
    """
    from pyspark.sql import Window as W

    spread = df.withColumn("_b", F.pmod(F.xxhash64(order), F.lit(buckets)))
    counts = spread.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    ahead = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(*keys, "_b", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_s"))
    inside = spread.withColumn("_r", F.row_number().over(W.partitionBy(*keys, "_b").orderBy(order)) - 1)
    # One row of starts for each key and bucket; without a key they are as few as the buckets.
    return inside.join(starts if keys else F.broadcast(starts), [*keys, "_b"]).withColumn(name, (F.col("_r") + F.col("_s")).cast("long")).drop("_b", "_r", "_s")


def mix64(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of pairs of 64-bit values."""
    x = a * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x += b
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(29)
    return x

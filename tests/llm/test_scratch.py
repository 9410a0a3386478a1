"""Intermediate tables of the training operators."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tilequarry.llm import common, substrings
from tilequarry.sources import scratch


def test_repeats_keep_no_table_but_the_spans(spark):
    passage = "".join(f"word {i * 7919 % 1000} " for i in range(40))
    rows = [(1, "first " + passage), (2, passage + "second"), (3, "nothing of it"), (4, None)]
    before = list(scratch._written)
    out = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert len([p for p in scratch._written if p not in before]) == 1
    assert {r["doc_id"]: r["n_spans"] for r in out.collect()} == {1: 1, 2: 1, 3: 0, 4: 0}


class Batch:
    """A table of one Arrow batch whose maps run here and now."""

    def __init__(self, spark, batch):
        self.sparkSession, self.batch = spark, batch

    def mapInArrow(self, f, schema):
        return sum(b.num_rows for b in f(iter([self.batch])))

    def mapInPandas(self, f, schema):
        return sum(len(p) for p in f(iter([self.batch.to_pandas()])))


def test_blocks_hold_a_part_of_their_batch(spark):
    """A full Arrow batch of contexts must not take its bucket identifiers and their mixing all at once."""
    n, nw = 10_000, 137
    bits = np.random.default_rng(1).bytes(n + nw + substrings.WIDTH)
    columns = {"rk": range(n), "th": range(n), "lo": [0] * n, "nw": [nw] * n, "rel": [136] * n, "anchor": range(n), "weight": [1] * n}
    batch = pa.table(columns | {"bytes": [bits[i : i + nw + substrings.WIDTH - 1] for i in range(n)]}).combine_chunks().to_batches()[0]
    tracemalloc.start()
    rows = substrings.blocks(Batch(spark, batch))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == n * 12 and peak < 60 << 20


def test_arrow_batches_are_bounded_by_their_bytes(spark):
    """Ten thousand long texts do not make one batch on their way to Python; a session's own limit stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    df = spark.range(0, 6_000, 1, 1).select(F.repeat(F.lit("text "), 1_000).alias("text"))

    def largest():
        common.map_frames(df, lambda frames: frames, "text string", ())
        sizes = df.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long").collect()
        return max(r["n"] for r in sizes)

    spark.conf.unset(key)
    assert largest() <= 1.1 * common.ARROW_BYTES
    spark.conf.set(key, "1m")
    assert largest() <= 1.1 * (1 << 20)
    spark.conf.unset(key)

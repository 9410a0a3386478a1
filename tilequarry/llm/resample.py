"""Importance resampling towards a target distribution, with hashed n-grams counted in word tries.

The features of a text are its runs of 1 to 3 words; a feature's bucket is the CRC of its bytes. A batch of a
partition is held as a trie of words: a node is a run, its children add a word, and it holds how often the run
occurs and the state of its CRC, from which a child's follows without the run being spelt out. Each task adds
the counts of its nodes to bucket totals, and Spark adds those of all tasks. With the totals of corpus and
target every bucket has a gain, the floored log ratio of its smoothed shares; a second walk along the same trie
paths adds the gains of the nodes passed to each document's weight. Gumbel noise drawn from the doc_id turns the
weights into scores whose largest are a sample without replacement.

Ranks are exact without a global sort in one task: rows are range-partitioned by score, numbered within
a partition, and shifted by the rows of the partitions before it. The driver sees bucket totals only.

Words are the runs of letters, digits and characters beyond ASCII in the ASCII-lower-cased text. A null or empty text has no
features, weight 0 and is never drawn. A null doc_id draws its noise as an empty one and comes last among ties.
Repeated rows are documents of their own. Extra columns are ignored. An empty corpus gives an empty
table; an empty target leaves only smoothing, so that common features lose most.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import hash_parts, map_frames, materialize

BUCKETS, DEPTH, MIN_WORDS, PERCENT, SEED = 10_000, 3, 20, 5, 42
KEEP = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))
#: Words up to this length are appended to many CRC states at once, by tables for their length.
TABLE_BYTES = 64


@functools.cache
def shift_tables(n: int) -> np.ndarray:
    """How n more bytes move a CRC state: a table for each of its four bytes; the moves are linear."""
    zeros = bytes(n)
    none = zlib.crc32(zeros)
    return np.array([[zlib.crc32(zeros, b << 8 * k) ^ none for b in range(256)] for k in range(4)], np.uint32)


def append(states: np.ndarray, words: np.ndarray, tails: list[bytes], size: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """CRC states after tails[word] is appended to each; size and crc are those of the tails."""
    out = np.empty(len(states), np.uint32)
    length = size[words]
    order = np.argsort(length, kind="stable")
    cut = np.flatnonzero(np.diff(length[order], prepend=-1))
    for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(order)]):
        at = order[a:b]
        n = int(length[at[0]])
        if n > TABLE_BYTES:
            out[at] = [zlib.crc32(tails[w], s) for w, s in zip(words[at].tolist(), states[at].tolist())]
            continue
        table, s = shift_tables(n), states[at]
        moved = table[0][s & 255] ^ table[1][s >> 8 & 255] ^ table[2][s >> 16 & 255] ^ table[3][s >> 24]
        out[at] = moved ^ crc[words[at]]
    return out


def trie(texts: list[bytes]) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], np.ndarray]:
    """Levels of a batch's trie: CRC state and count of each node, and for each path its node and where it starts.

    Also where each text's words begin, one entry more than texts.
    """
    known: dict[bytes, int] = {}
    found = [[known.setdefault(w, len(known)) for w in t.lower().translate(KEEP).split()] for t in texts]
    begin = np.cumsum([0] + [len(f) for f in found])
    word = np.array([w for f in found for w in f], np.int64)
    tails = [b" " + w for w in known]
    size = np.array([len(t) for t in tails], np.int64)
    crc = np.array([zlib.crc32(t) for t in tails], np.uint32)
    end = np.repeat(begin[1:], np.diff(begin))
    at, node = np.arange(len(word)), word
    state = np.array([zlib.crc32(w) for w in known], np.uint32)
    levels = [(state, np.bincount(node, minlength=len(state)), node, at)]
    for depth in range(1, DEPTH):
        more = at + depth < end[at]
        at, node = at[more], node[more]
        child, node, count = np.unique(node * max(1, len(known)) + word[at + depth], return_inverse=True, return_counts=True)
        parent, last = child // max(1, len(known)), child % max(1, len(known))
        state = append(state[parent], last, tails, size, crc)
        levels.append((state, count, node, at))
    return levels, begin


def encoded(texts: pd.Series) -> list[bytes]:
    return [(t or "").encode() for t in texts]


def bucket_totals(docs: DataFrame) -> dict[int, int]:
    """How many features of all texts fall in each bucket."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(BUCKETS, np.int64)
        for f in frames:
            for state, count, _, _ in trie(encoded(f["text"]))[0]:
                total += np.bincount(state % BUCKETS, count, BUCKETS).astype(np.int64)
        some = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": some.astype(np.int32), "n": total[some]})

    counts = map_frames(docs.select("text"), run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    return {r["bucket"]: r["n"] for r in counts.collect()}  # BUCKETS rows at most


def gains(corpus: dict[int, int], target: dict[int, int]) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's smoothed shares in target and corpus, rounded down."""
    S, T = sum(corpus.values()), sum(target.values())
    ratio = lambda s, t: float((t + 1) * (S + BUCKETS)) / float((s + 1) * (T + BUCKETS))
    return np.array([math.floor(1000 * math.log(ratio(corpus.get(b, 0), target.get(b, 0)))) for b in range(BUCKETS)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """Per row: doc_id, n_words, n_features and weight."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            levels, begin = trie(encoded(f["text"]))
            passed, number = np.zeros(begin[-1] + 1, np.int64), np.zeros(begin[-1] + 1, np.int64)
            for state, _, node, at in levels:
                # A start has one path of each length at most.
                passed[at + 1] += gain[state % BUCKETS][node]
                number[at + 1] += 1
            passed, number = np.cumsum(passed), np.cumsum(number)
            over = lambda sums: sums[begin[1:]] - sums[begin[:-1]]
            yield pd.DataFrame({"doc_id": f["doc_id"], "n_words": np.diff(begin), "n_features": over(number), "weight": over(passed)})

    return map_frames(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n_words long, n_features long, weight long")


def rank_highest(rows: DataFrame, eligible: int, most: int) -> DataFrame:
    """rows with rank 1, 2, 3 ... of the `most` highest scores among those with enough words, the others null."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("_row")]
    able = rows.where(F.col("n_words") >= MIN_WORDS)
    # The row number makes every key unique, so no tie is gathered in one partition. The parts are fixed by writing them.
    parts = materialize(able.repartitionByRange(hash_parts(eligible, 100_000), *order).withColumn("_part", F.spark_partition_id()))
    counts = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    ahead = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = materialize(counts.select("_part", ahead.alias("_s")))  # one row a partition
    placed = parts.join(F.broadcast(starts), "_part")
    inside = F.row_number().over(W.partitionBy("_part").orderBy(*order)) + F.col("_s")
    ranked = placed.where(F.col("_s") < most).withColumn("rank", inside.cast("long"))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))
    none = F.lit(None).cast("long").alias("rank")
    others = placed.where(F.col("_s") >= most)
    short = rows.where(F.col("n_words") < MIN_WORDS)
    names = [c for c in rows.columns if c != "_row"]
    return ranked.select(*names, "rank").unionByName(others.select(*names, none)).unionByName(short.select(*names, none))


def resample(docs: DataFrame, target: DataFrame) -> DataFrame:
    """Per document: doc_id, n_features, weight, score and rank (null if not drawn)."""
    gain = gains(bucket_totals(docs), bucket_totals(target))
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    gumbel = F.floor(-1000 * F.log(-F.log((noise + 0.5) / 4294967296.0))).cast("long")
    rows = weigh(docs, gain).withColumn("score", F.col("weight") + gumbel)
    rows = materialize(rows.withColumn("_row", F.monotonically_increasing_id()))
    eligible = rows.where(F.col("n_words") >= MIN_WORDS).count()
    out = rank_highest(rows, eligible, PERCENT * eligible // 100)
    return out.select("doc_id", "n_features", "weight", "score", "rank")

"""Cross-entropy difference: which documents read like the target domain.

Two bigram models, one of the target documents and one of the background (all documents), share one
vocabulary: every word of the corpus. Both count every word and every pair of neighbouring words of
their documents. A document's score is the mean over its words of loss under the target model minus
loss under the background model: below 0 it reads like the target. The two are matched: both mix a
pair's share of what follows its first word with the share of its second word, by PAIR_WEIGHT, and
work with shares only, so that the models' different sizes cancel. The target's word shares are mixed
with those of the background by LEAN, so that no word of the corpus is unknown to it.

Documents are dealt to chunks of about CHUNK_BYTES by doc_id, the ids of the target documents with
them. Each chunk counts its own n-grams and sends them, packed, to buckets of n-grams; a bucket adds
the counts of all chunks and answers each chunk in the order asked; the chunk then scores its
documents. The number of chunks and of buckets grows with the text, so a task holds one chunk or the
n-grams of one bucket whatever the corpus, and nothing goes to the driver but the number of bytes.
N-grams are known by their bucket and 32 bits; with a bucket for each CHUNK_BYTES of text fewer
than one in a thousand shares its number with another.

Words are the non-space runs of the ASCII-lower-cased text. A null or empty text scores 0 with 0
words. Without any target document all scores are 0. Target ids may repeat. Rows without a doc_id are
never targets. Rows with equal doc_id, or with no doc_id and equal text, are scored in one task. Extra
columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64

#: Bytes of text in a chunk, and for which there is one bucket.
CHUNK_BYTES = 8_000_000
#: Weight of a pair's share against its second word's, and of the background's word shares in the target's.
PAIR_WEIGHT, LEAN = 0.6, 0.1
#: Bytes of text that are hashed together.
BATCH_BYTES = 2_000_000
ASKED = "chunk int, bucket int, grams binary, background binary, target binary"
ANSWERED = "chunk int, bucket int, background binary, target binary"
SCORED = "doc_id long, n_words long, target_loss double, background_loss double, score double"
#: Stands for all words together.
TOTAL = np.uint64(0xF1D5A3C7B9E80642)

POWER = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(POWER), -1, 1 << 64))
KIND = np.array([i in b" \t\n\x0b\x0c\r" for i in range(256)])
VALUE = mix64(np.arange(256, dtype=np.uint64) | (np.arange(256, dtype=np.uint64) << np.uint64(32)), np.full(256, 7, np.uint64))
VALUE[65:91] = VALUE[97:123]
LOW, HALF = np.uint64(0xFFFFFFFF), np.uint64(32)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in a row, and where each text's words begin (one entry more than texts)."""
    whole = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    space = KIND[whole]
    edge = np.diff(space.astype(np.int8))
    start, stop = np.flatnonzero(edge == -1) + 1, np.flatnonzero(edge == 1) + 1
    n = len(whole)
    up = np.full(n, POWER, np.uint64)
    up[0] = 1
    up = np.multiply.accumulate(up)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(VALUE[whole] * up)])
    down = np.full(n, INVERSE, np.uint64)
    down[0] = 1
    down = np.multiply.accumulate(down)
    h = (total[stop] - total[start]) * down[start]
    first = np.cumsum([1] + [len(t) + 1 for t in texts])
    return mix64(h, (stop - start).astype(np.uint64)), np.searchsorted(start, first)


def chunk_grams(texts: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a chunk: each word's gram, the grams of pairs, whether each word ends a pair, and where each text's words begin."""
    words, first = [], [0]
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= BATCH_BYTES):
            size += len(texts[j])
            j += 1
        h, begin = word_hashes(texts[i:j])
        words.append(h)
        first += (begin[1:] + first[-1]).tolist()
        i = j
    word, begin = np.concatenate([np.zeros(0, np.uint64), *words]), np.array(first)
    paired = np.ones(len(word), bool)
    paired[begin[:-1][begin[:-1] < begin[1:]]] = False
    ends = np.flatnonzero(paired)
    return gram(word, buckets), gram(mix64(word[ends - 1], word[ends]), buckets), paired, begin


def gram(h: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket in the upper half and the gram's number within it in the lower one."""
    return ((h >> HALF) % np.uint64(buckets) << HALF) | (h & LOW)


def pack(values: np.ndarray) -> bytes:
    """Numbers by planes of their bytes, most of which are zero."""
    return zlib.compress(np.ascontiguousarray(values.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpack(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(packed), np.uint8).reshape(8, -1).T).view("<i8").ravel()


def none(schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")]).empty_table()


def ask(key: tuple, docs: pa.Table, targets: pa.Table, buckets: int) -> pa.Table:
    """The chunk's grams with their counts, a row for each bucket."""
    if not docs.num_rows:
        return none(ASKED)
    word, pair, paired, begin = chunk_grams(docs["text"].to_pylist(), buckets)
    is_target = pc.is_in(docs["doc_id"], value_set=targets["doc_id"].combine_chunks()).to_numpy()
    chosen = np.repeat(is_target, np.diff(begin))
    grams, background = np.unique(np.concatenate([word, pair]), return_counts=True)
    some, times = np.unique(np.concatenate([word[chosen], pair[chosen[paired]]]), return_counts=True)
    target = np.zeros(len(grams), np.int64)
    target[np.searchsorted(grams, some)] = times
    every = gram(TOTAL, buckets)
    at = np.searchsorted(grams, every)
    grams, background, target = (np.insert(a, at, v) for a, v in ((grams, every), (background, len(word)), (target, chosen.sum())))
    bucket = (grams >> HALF).astype(np.int64)
    cut = np.flatnonzero(np.diff(bucket, prepend=-1))
    parts = list(zip(cut.tolist(), [*cut[1:].tolist(), len(grams)], strict=True))
    number = (grams & LOW).astype(np.int64)
    return pa.table(
        {
            "chunk": pa.array([key[0].as_py()] * len(parts), pa.int32()),
            "bucket": pa.array(bucket[cut], pa.int32()),
            "grams": pa.array([pack(np.diff(number[a:b], prepend=0)) for a, b in parts], pa.binary()),
            "background": pa.array([pack(background[a:b]) for a, b in parts], pa.binary()),
            "target": pa.array([pack(target[a:b]) for a, b in parts], pa.binary()),
        }
    )


def answer(key: tuple, asked: pa.Table) -> pa.Table:
    """Counts of all chunks together, for each chunk in the order of its grams."""
    numbers = [np.cumsum(unpack(x)) for x in asked["grams"].to_pylist()]
    which, place = np.unique(np.concatenate(numbers), return_inverse=True)
    ends = np.cumsum([len(x) for x in numbers]).tolist()
    out = {"chunk": asked["chunk"], "bucket": asked["bucket"]}
    for name in ("background", "target"):
        own = np.concatenate([unpack(x) for x in asked[name].to_pylist()])
        added = np.bincount(place, own, len(which)).astype(np.int64)[place]
        out[name] = pa.array([pack(added[e - len(x) : e]) for x, e in zip(numbers, ends, strict=True)], pa.binary())
    return pa.table(out)


def score(docs: pa.Table, answered: pa.Table, buckets: int) -> pa.Table:
    if not docs.num_rows:
        return none(SCORED)
    word, pair, paired, begin = chunk_grams(docs["text"].to_pylist(), buckets)
    grams, place = np.unique(np.concatenate([word, pair]), return_inverse=True)
    every = np.searchsorted(grams, gram(TOTAL, buckets))
    answered = answered.sort_by("bucket")
    count, words = {}, {}
    for name in ("background", "target"):
        got = np.concatenate([unpack(x) for x in answered[name].to_pylist()])
        words[name], count[name] = int(got[every]), np.delete(got, every)[place]
    n, ends = np.diff(begin), np.flatnonzero(paired)
    known = count["background"][: len(word)] / max(words["background"], 1)
    mean = {}
    for name, c in count.items():
        own = c[: len(word)]
        share = known if name == "background" else (1 - LEAN) * own / max(words[name], 1) + LEAN * known
        chance, lead = share.copy(), own[ends - 1]
        mixed = PAIR_WEIGHT * c[len(word) :] / np.maximum(lead, 1) + (1 - PAIR_WEIGHT) * share[ends]
        chance[ends] = np.where(lead > 0, mixed, share[ends])
        loss = -np.log(chance)
        running = np.concatenate([[0.0], np.cumsum(loss)])
        mean[name] = (running[begin[1:]] - running[begin[:-1]]) / np.maximum(n, 1)
    difference = mean["target"] - mean["background"] if words["target"] else np.zeros(len(n))
    columns = {"n_words": n.astype(np.int64), "target_loss": mean["target"], "background_loss": mean["background"], "score": difference}
    return pa.table({"doc_id": docs["doc_id"].cast(pa.int64()), **columns})


def score_documents(docs: DataFrame, target_ids: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, target_loss, background_loss and score (mean loss difference).

    target_ids: doc_id of the target documents, which are part of docs.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-int(size) // CHUNK_BYTES) or 1
    ids = target_ids.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    home = F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int").alias("chunk")
    home_of_all = F.pmod(F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id")), F.lit(n)).cast("int").alias("chunk")
    placed = docs.select(home_of_all, "doc_id", "text")
    by_chunk = placed.groupBy("chunk")
    asked = by_chunk.cogroup(ids.select(home, "doc_id").groupBy("chunk")).applyInArrow(lambda key, d, t: ask(key, d, t, n), ASKED)
    answered = asked.groupBy("bucket").applyInArrow(answer, ANSWERED)
    return by_chunk.cogroup(answered.groupBy("chunk")).applyInArrow(lambda d, a: score(d, a, n), SCORED)

"""Language identification by the nearest of several TF-IDF centroids per language.

A text becomes hashed counts of letter 1- to 3-grams (lower case, every run of non-letters one
space), dampened, weighted by inverse document frequency and normalised. Each language gets a few
centroids by spherical k-means; the language of the most similar centroid is predicted, and
`accepted` is false where the text is further from it than nearly all of its training members.

Training uses a bounded sample: at most SAMPLE_PER_LANG labelled documents of each language, drawn
by the hash of doc_id (whole texts). Everything else runs over all rows. A null text or one without
a letter gives `und` with score 0. Without any training row everything is `und`.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_frames

DIM_BITS = 14
DIM = 1 << DIM_BITS
SAMPLE_PER_LANG = 400
CENTROIDS = 4
ROUNDS = 12
#: Share of a centroid's training members that are further away than its rejection distance.
REJECT_SHARE = 0.005


@cache
def letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def ngram_counts(text: str | None) -> np.ndarray | None:
    """Hashed counts of the letter n-grams of a text; None if it has no letter."""
    if not text:
        return None
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[code]
    if not is_letter.any():
        return None
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    code = np.where(is_letter, code, 0)[keep]
    code = np.concatenate([[0], code, [0]]).astype(np.uint32)
    one = code * np.uint32(2654435761)
    two = (one[:-1] ^ (one[:-1] >> np.uint32(15))) * np.uint32(2246822519) + one[1:]
    three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * np.uint32(3266489917) + one[2:]
    shift = np.uint32(32 - DIM_BITS)
    grams = [((x ^ (x >> np.uint32(16))) * np.uint32(668265263) + np.uint32(k)) >> shift for k, x in enumerate((one[code > 0], two, three))]
    return np.bincount(np.concatenate(grams), minlength=DIM)


def sample_training(docs: DataFrame, usable: Column, per_lang: int) -> DataFrame:
    """At most about per_lang labelled rows of each language, drawn by the hash of doc_id."""
    rows = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return rows.limit(0)
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("sample")), F.lit(1_000_000))
    bound = F.coalesce(*[F.when(F.col("lang") == k, F.lit(int(1_000_000 * min(1.0, per_lang / n)) + 1)) for k, n in sizes.items()])
    return rows.where(draw < bound)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Unit centroids of the unit rows of x, and each row's centroid; seeds are far from each other."""
    seeds = [0]
    near = x @ x[0]
    while len(seeds) < min(k, len(x)):
        seeds.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[seeds[-1]])
    centre = x[seeds].copy()
    for _ in range(rounds):
        label = np.argmax(x @ centre.T, axis=1)
        for j in range(len(centre)):
            if (label == j).any():
                mean = x[label == j].mean(axis=0)
                centre[j] = mean / max(1e-9, float(np.linalg.norm(mean)))
    return centre, np.argmax(x @ centre.T, axis=1)


def train(docs: DataFrame, usable: Column, per_lang: int = SAMPLE_PER_LANG, centroids: int = CENTROIDS) -> dict:
    """The model: langs and limits (one for each centroid), matrix (unit centroids) and idf."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
                if (c := ngram_counts(text)) is not None:
                    at = np.flatnonzero(c)
                    out.append((lang, at.astype(np.int32).tobytes(), c[at].astype(np.int32).tobytes()))
            yield pd.DataFrame(out, columns=["lang", "at", "n"])

    got = map_frames(sample_training(docs, usable, per_lang).select("lang", "text"), run, "lang string, at binary, n binary").collect()
    got = sorted(got, key=lambda r: (r["lang"], bytes(r["at"]), bytes(r["n"])))
    seen = np.zeros(DIM)
    for r in got:
        seen[np.frombuffer(r["at"], np.int32)] += 1
    idf = (np.log((1 + len(got)) / (1 + seen)) + 1).astype(np.float32)
    langs, limits, rows = [], [], []
    for lang in sorted({r["lang"] for r in got}):
        own = [r for r in got if r["lang"] == lang]
        x = np.zeros((len(own), DIM), np.float32)
        for i, r in enumerate(own):
            x[i, np.frombuffer(r["at"], np.int32)] = np.log1p(np.frombuffer(r["n"], np.int32))
        x *= idf
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        centre, label = spherical_kmeans(x, centroids)
        near = (x * centre[label]).sum(axis=1)
        for j in range(len(centre)):
            member = near[label == j]
            langs.append(lang)
            limits.append(float(np.quantile(member, REJECT_SHARE)) if len(member) else 1.0)
            rows.append(centre[j])
    return {"langs": langs, "limits": limits, "matrix": np.array(rows, np.float32).reshape(-1, DIM), "idf": idf}


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """Per row: doc_id, lang_pred, score (cosine, 0 to 1) and accepted (not rejected by distance)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for pdf in batches:
            out = []
            for text in pdf["text"]:
                c = ngram_counts(text)
                if c is None or not m["langs"]:
                    out.append(("und", 0.0, False))
                    continue
                at = np.flatnonzero(c)
                v = np.log1p(c[at]).astype(np.float32) * m["idf"][at]
                near = (m["matrix"][:, at] @ v) / max(1e-9, float(np.linalg.norm(v)))
                j = int(np.argmax(near))
                out.append((m["langs"][j], min(1.0, max(0.0, float(near[j]))), bool(near[j] >= m["limits"][j])))
            res = pd.DataFrame(out, columns=["lang_pred", "score", "accepted"])
            res.insert(0, "doc_id", pdf["doc_id"].array)
            yield res

    return map_frames(docs.select("doc_id", "text"), run, "doc_id long, lang_pred string, score double, accepted boolean")


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of doc_id as text, modulo 4."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4


def identify_languages(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG, centroids: int = CENTROIDS) -> DataFrame:
    """Train on the labelled rows outside fold 2 and predict every row; held_out marks fold 2.

    per_lang bounds the training rows of a language, centroids is their number for each language.
    """
    docs = docs.select("doc_id", "text", "lang")
    model = train(docs, fold() != 2, per_lang, centroids)
    out = predict(docs, model)
    return out.select("doc_id", F.coalesce(fold() == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted")

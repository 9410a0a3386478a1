"""Quality rules whose cutoffs are certified on labelled documents.

Each rule rejects a document when one measured share passes a cutoff. The labelled documents of good
quality that pass the base rules are the holdout, a quarter and the rest by the hash of the text; equal
texts of a stratum (a language) count once. Per stratum, the quarter puts all (rule, cutoff) steps into a
ladder: those that lose fewest documents first, each rule from lenient to strict. The rest climbs it: after each step the exact binomial test asks whether the rules so far lose more than alpha
of the good documents. Every step loses at least what the steps before it lose, and the first one that
is not certified ends the climb, so the tests of a ladder need no correction among themselves
(fixed-sequence testing); over the strata Bonferroni's correction gives each the level delta / strata.
So with probability 1 - delta no stratum loses more than alpha of its good documents to the cutoffs.

Null text has no words and fails the base rules. A null language is a stratum of its own. A stratum
without labelled documents, or with too few, has no certified cutoff and keeps what passes the base rules.
Repeated label rows of a document count once, as good only if all of them say so. Rows that share a
doc_id share its label; rows without one have none. Texts are measured whole; repeated rows get equal
verdicts; an empty table gives no rows. Extra columns are ignored (`keep_good` passes them on).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import SPACE, map_frames, materialize, spread_join

#: rule -> (numerator, denominator, cutoffs from strict to lenient)
RULES: dict[str, tuple[str, str, tuple[float, ...]]] = {
    "symbols": ("n_symbols", "word_chars", (0.01, 0.02, 0.05, 0.1, 0.2, 0.3)),
    "dup_lines": ("n_dup_lines", "n_lines", (0.05, 0.1, 0.2, 0.3, 0.5, 0.7)),
    "repeats": ("n_repeat_words", "n_words", (0.02, 0.05, 0.1, 0.15, 0.2, 0.25)),
    "upper": ("n_upper", "word_chars", (0.1, 0.2, 0.3, 0.5, 0.7, 0.9)),
    "exclaim": ("n_exclaim", "n_words", (0.05, 0.1, 0.2, 0.4, 0.6, 0.8)),
    "word_length": ("word_chars", "n_words", (8.0, 10.0, 12.0, 16.0, 24.0, 40.0)),
}
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
#: Strata up to which the cutoffs are broadcast.
BROADCAST_STRATA = 10_000

#: A stratum's good documents that may be lost, and the chance that some stratum loses more.
ALPHA, DELTA = 0.02, 0.05

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
COUNTS = (*BASE, "n_lines", "n_upper", "n_exclaim")


def repeated_words(words: list, width: int = WINDOW) -> int:
    """Words inside windows of `width` words that occur at least twice; exact, by doubling ranks."""
    n = len(words)
    if n <= width:
        return 0
    seen: dict = {}
    rank = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    have = 1
    while have < width:
        step = min(have, width - have)
        key = rank[:-step] * (n + 1) + rank[step:]
        _, rank, count = np.unique(key, return_inverse=True, return_counts=True)
        if count.max() == 1:
            return 0
        have += step
    edge = np.zeros(n + 1, np.int32)
    start = np.flatnonzero(count[rank] > 1)
    edge[start] += 1
    edge[start + width] -= 1
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The COUNTS of one text."""
    if not text:
        return (0,) * len(COUNTS)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    letters = np.frombuffer(raw, np.uint8)
    return (
        len(words),
        len(text) - sum(map(text.count, SPACE)),
        sum(map(raw.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">"))),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        int(((letters >= 65) & (letters <= 90)).sum()),
        raw.count(b"!"),
    )


def measure_documents(docs: DataFrame, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(columns, stratum, COUNTS, _text: a hash of the text) of every document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = pd.DataFrame([measure(t) for t in pdf["text"]], columns=list(COUNTS), dtype="int64")
            yield pd.concat([pdf[[*columns, "stratum", "_text"]], rows], axis=1)

    text = [] if "text" in columns else ["text"]
    stratum = F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("stratum")
    source = docs.select(*columns, stratum, F.xxhash64("text").alias("_text"), *text)
    schema = StructType([f for f in source.schema if f.name != "text" or not text])
    for c in COUNTS:
        schema = schema.add(c, "long")
    return map_frames(source, run, schema, tuple(c for c in columns if c != "text"))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) of a binomial variable with n trials and probability p."""
    if k >= n:
        return 1.0
    log_term = n * math.log1p(-p)
    total = math.exp(log_term)
    for i in range(1, k + 1):
        log_term += math.log((n - i + 1) / i) + math.log(p) - math.log1p(-p)
        total += math.exp(log_term)
        if i > n * p and log_term < -745:
            break
    return min(1.0, total)


def share(rule: str) -> Column:
    top, bottom, _ = RULES[rule]
    return F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom)).otherwise(F.lit(0.0))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


STEPS = [(r, i) for r, (_, _, cuts) in RULES.items() for i in range(len(cuts))]


def ladder(losses: list[int]) -> list[int]:
    """The place of each of STEPS in the ladder, from what each loses in the first quarter."""
    worst: dict[tuple[str, int], tuple[int, int]] = {}
    for (rule, i), lost in zip(STEPS, losses, strict=True):
        # A rule's cutoffs run from strict to lenient, and a stricter one loses no less.
        worst[rule, i] = (lost, -i)
    order = sorted(STEPS, key=lambda s: (*worst[s], s[0]))
    return [order.index(s) for s in STEPS]


def certified_cutoffs(measured: DataFrame, labels: DataFrame, alpha: float, delta: float) -> tuple[DataFrame, int]:
    """One row (stratum, a cutoff or null for each rule) for each labelled stratum, and their number."""
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id")
    held = measured.where(~base_failed()).join(good, "doc_id", "left_semi").dropDuplicates(["stratum", "_text"])
    held = materialize(held.select("stratum", (F.pmod(F.xxhash64("_text", F.lit("ladder")), F.lit(4)) == 0).alias("first"), *[share(r).alias(r) for r in RULES]))
    over = lambda r, i: F.col(r) > RULES[r][2][i]
    lost = F.array(*[F.sum((F.col("first") & over(r, i)).cast("long")) for r, i in STEPS])
    ladders = materialize(held.groupBy("stratum").agg(lost.alias("lost")))
    strata = ladders.count()
    level = delta / max(1, strata)

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"stratum": pdf["stratum"], "place": [ladder(list(x)) for x in pdf["lost"]]})

    ladders = map_frames(ladders, build, "stratum string, place array<int>")
    others = spread_join(held.where("not first"), ladders, "stratum", strata <= BROADCAST_STRATA)
    end = F.lit(len(STEPS))
    # The step at which each other document is lost.
    at = F.least(end, *[F.when(over(r, i), F.col("place")[k]).otherwise(end) for k, (r, i) in enumerate(STEPS)])
    tally = others.groupBy("stratum", at.alias("at")).agg(F.count(F.lit(1)).alias("n"))
    tally = tally.groupBy("stratum").agg(F.collect_list(F.struct("at", "n")).alias("tally"))

    def climb(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for stratum, place, tally in zip(pdf["stratum"], pdf["place"], pdf["tally"], strict=True):
                lost = {t["at"]: t["n"] for t in tally}
                n, gone, cut = sum(lost.values()), 0, dict.fromkeys(RULES)
                for k, (rule, i) in sorted(zip(place, STEPS, strict=True)):
                    gone += lost.get(k, 0)
                    if binomial_tail(gone, n, alpha) > level:
                        break
                    cut[rule] = RULES[rule][2][i]
                rows.append((stratum, *cut.values()))
            yield pd.DataFrame(rows, columns=["stratum", *(f"cut_{r}" for r in RULES)]).astype({f"cut_{r}": "float64" for r in RULES})

    schema = "stratum string, " + ", ".join(f"cut_{r} double" for r in RULES)
    return materialize(map_frames(ladders.join(tally, "stratum"), climb, schema)), strata


def verdicts(measured: DataFrame, labels: DataFrame, alpha: float, delta: float) -> DataFrame:
    """measured with base_failed, failed (the certified rules a document breaks) and kept."""
    cuts, strata = certified_cutoffs(measured, labels.select("doc_id", "quality"), alpha, delta)
    failed = F.array_compact(F.array(*[F.when(share(r) > F.col(f"cut_{r}"), F.lit(r)) for r in RULES]))
    out = spread_join(measured, cuts, "stratum", strata <= BROADCAST_STRATA).withColumn("base_failed", base_failed()).withColumn("failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))


def quality_rules(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Per document: doc_id, the COUNTS, stratum, base_failed, kept and failed (the certified rules it breaks)."""
    out = verdicts(materialize(measure_documents(docs)), labels, alpha, delta)
    return out.select("doc_id", *COUNTS, "stratum", "base_failed", "kept", "failed")


def keep_good(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The rows of docs that the rules keep, with docs' columns; the verdict is that of quality_rules."""
    names = docs.columns
    measured = materialize(measure_documents(docs, tuple(names)))
    return verdicts(measured, labels, alpha, delta).where("kept").select(*names)

"""Exact removal of repeated 200-byte strings by bucket-pointer refinement over all suffixes.

Every position belongs to a bucket named by its q-gram; buckets of length 2q are named by the pair
of bucket identifiers at an offset and q later, and the identifiers of each length are reused for
the next (8 -> 16 -> 32 -> 64 -> WIDTH bytes). The name of a pair is a 64-bit hash, so executors agree
on it without sorting the corpus together; wherever a repeat is decided two names count (128 bits).
Only buckets with several members are refined further:

1. A window of WIDTH bytes is filed under the rightmost least 64-gram bucket inside it (its anchor),
   which depends on its bytes only; neighbouring windows share anchors and form runs. Anchors that
   occur once are done: none of their windows repeats.
2. Runs whose whole span falls in one bucket repeat in full. Runs that stand alone under a repeated
   anchor are open; they and one representative of each repeated kind go on.
3. Open runs are cut into blocks of BLOCK window starts, at fixed distances from the anchor. A block whose
   core (the bytes that all its windows share) is alone is done; one whose span repeats is covered.
4. What remains is refined window by window.

Spark groups, counts and joins; a large bucket is counted by partial aggregates and never gathered.
Bytes covered by any repeated window are removed. Matches never cross documents.

A null text counts as empty. Rows with equal doc_id and text are two places with the same string, so
they lose what they share; a null or repeated doc_id is passed on as it is. Removal can cut a character;
`text` leaves out the bytes of cut characters. Texts shorter than WIDTH keep all bytes, long ones are
worked on whole. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, map_frames, materialize, mix64

WIDTH = 200
GRAM = 64
BLOCK = 12
#: Windows over which the least bucket is looked for.
SPAN = WIDTH - GRAM + 1
#: Offsets of 64-grams that together name a window, a block's core and a block's span.
WINDOW_AT = (0, 64, 128, WIDTH - GRAM)
CORE_AT = (0, 64, WIDTH - BLOCK + 1 - GRAM)
HULL_AT = (0, 64, 128, WIDTH + BLOCK - 1 - GRAM)
#: Bytes of contexts that a batch holds; bucket identifiers and what they are mixed from take some 50 times that.
CONTEXT_BYTES = 256 << 10
#: Windows whose least buckets are looked for at a time.
LEAST_ROWS = 2_000


def buckets(raw: bytes) -> np.ndarray:
    """The bucket identifier of the 64-gram at each position, by doubling from 8-grams."""
    n = len(raw)
    if n < GRAM:
        return np.zeros(0, np.uint64)
    b = np.frombuffer(raw, np.uint8)
    x = np.lib.stride_tricks.sliding_window_view(b, 8).copy().view("<u8").ravel()
    size = 8
    while size < GRAM:
        x = mix64(x[:-size], x[size:])
        size *= 2
    return x


def names(x: np.ndarray, at: np.ndarray, offsets: tuple[int, ...]) -> np.ndarray:
    """One name for the buckets at several offsets from each position."""
    h = x[at + offsets[0]]
    for k in offsets[1:]:
        h = mix64(h, x[at + k])
    return h


def rightmost_least(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each window start the rightmost position of its least bucket."""
    out = np.empty(len(at), np.int64)
    back = np.arange(SPAN - 1, -1, -1)
    for i in range(0, len(at), LEAST_ROWS):
        part = at[i : i + LEAST_ROWS]
        out[i : i + LEAST_ROWS] = part + (SPAN - 1) - np.argmin(x[part[:, None] + back], axis=1)
    return out


def runs(raw: bytes) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: anchor bucket, name of the whole span, first start, windows, anchor - first."""
    n, x = len(raw), buckets(raw)
    if n < WIDTH:
        e = np.zeros(0, np.int64)
        return e, e, e, e, e
    m = n - WIDTH + 1
    padded = np.concatenate([x, np.full(-len(x) % SPAN, np.uint64(2**64 - 1))]).reshape(-1, SPAN)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:m], ahead[SPAN - 1 : SPAN - 1 + m])
    lo = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    size = np.diff(np.append(lo, m))
    anchor = rightmost_least(x, lo)
    last = rightmost_least(x, lo + size - 1)
    if (anchor != last).any():  # the least bucket occurs again inside the run: an anchor for each stretch
        odd = np.flatnonzero(anchor != last)
        every = np.concatenate([np.arange(lo[i], lo[i] + size[i]) for i in odd])
        place = rightmost_least(x, every)
        new = np.concatenate([[True], (place[1:] != place[:-1]) | (every[1:] != every[:-1] + 1)])
        first = np.flatnonzero(new)
        calm = anchor == last
        lo = np.concatenate([lo[calm], every[first]])
        size = np.concatenate([size[calm], np.diff(np.append(first, len(every)))])
        anchor = np.concatenate([anchor[calm], place[first]])
    rel, end = anchor - lo, lo + size + WIDTH - 1 - GRAM
    kind = mix64(rel.astype(np.uint64), size.astype(np.uint64))
    for k in range(-(-(SPAN + WIDTH) // GRAM)):  # the 64-grams that tile the span, the last ones flush with its end
        kind = mix64(kind, x[np.minimum(lo + GRAM * k, end)])
    return x[anchor].view(np.int64), kind.view(np.int64), lo, size, rel


RUN_SCHEMA = "rk long, th long, lo int, nw int, rel int, anchor long, kind long"


def keyed(docs: DataFrame) -> DataFrame:
    """docs with a key: rows with equal rk (doc_id) and th (hash of the text) are copies of each other."""
    rk = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    return docs.withColumn("rk", rk).withColumn("th", F.xxhash64("text"))


def all_runs(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), 500):
                part = pdf.iloc[i : i + 500]
                got = [runs((t or "").encode("utf-8", "surrogatepass")) for t in part["text"]]
                n = [len(g[0]) for g in got]
                anchor, kind, lo, size, rel = (np.concatenate([g[k] for g in got]) for k in range(5))
                rk, th = np.repeat(part["rk"].to_numpy(), n), np.repeat(part["th"].to_numpy(), n)
                yield pd.DataFrame({"rk": rk, "th": th, "lo": lo, "nw": size, "rel": rel, "anchor": anchor, "kind": kind})

    return map_frames(docs.select("rk", "th", "text"), run, RUN_SCHEMA, ())


def contexts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of each wanted run (rk, th, lo, nw, rel, anchor, weight)."""
    per_doc = wanted.groupBy("rk", "th").agg(F.collect_list(F.struct("lo", "nw", "rel", "anchor", "weight")).alias("wanted"))
    one = docs.select("rk", "th", "text").join(per_doc, ["rk", "th"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for rk, th, text, want in zip(pdf["rk"], pdf["th"], pdf["text"], pdf["wanted"], strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                out += [(rk, th, w["lo"], w["nw"], w["rel"], w["anchor"], w["weight"], raw[w["lo"] : w["lo"] + w["nw"] + WIDTH - 1]) for w in want]
            yield pd.DataFrame(out, columns=["rk", "th", "lo", "nw", "rel", "anchor", "weight", "bytes"])

    schema = "rk long, th long, lo int, nw int, rel int, anchor long, weight int, bytes binary"
    # Copies with equal rk and th would give the same context again; one of them is enough.
    return map_frames(one, run, schema, ()).dropDuplicates(["rk", "th", "lo"])


def joined_bytes(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Bucket identifiers over all contexts of a batch, and where each context begins."""
    base = np.cumsum([0] + [len(b) for b in pdf["bytes"]])[:-1]
    return buckets(b"".join(pdf["bytes"]) + bytes(WIDTH)), base


def blocks(ctx: DataFrame) -> DataFrame:
    """The blocks of every context with the names of core and span (a cut-off block's span is its own)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x, base = joined_bytes(pdf)
            lo, nw, rel = (pdf[c].to_numpy(np.int64) for c in ("lo", "nw", "rel"))
            first, last = (rel - nw + 1) // BLOCK, rel // BLOCK
            n = last - first + 1
            row = np.repeat(np.arange(len(pdf)), n)
            blk = np.repeat(first, n) + (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n))
            end = rel[row] - blk * BLOCK  # last start of the block, relative to the context
            begin = end - BLOCK + 1
            a, b = np.maximum(begin, 0), np.minimum(end, nw[row] - 1)
            core = names(x, base[row] + end, CORE_AT)
            whole = (a == begin) & (b == end)
            own = mix64(pdf["th"].to_numpy(np.int64).view(np.uint64)[row], (lo[row] + a).astype(np.uint64))
            hull = np.where(whole, names(x, base[row] + a, HULL_AT), own)
            out = pdf[["rk", "th", "lo", "anchor", "weight"]].iloc[row].reset_index(drop=True)
            yield out.assign(blk=blk, start=lo[row] + a, cnt=b - a + 1, core=core.view(np.int64), hull=hull.view(np.int64), whole=whole)

    schema = "rk long, th long, lo int, anchor long, weight int, blk int, start int, cnt int, core long, hull long, whole boolean"
    return map_frames(ctx, run, schema, (), CONTEXT_BYTES)


def windows(ctx: DataFrame, requests: DataFrame) -> DataFrame:
    """Every window start of the requested blocks (rk, th, lo, start, cnt, w) with its name."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x, base = joined_bytes(pdf)
            n = pdf["cnt"].to_numpy(np.int64)
            row = np.repeat(np.arange(len(pdf)), n)
            start = pdf["start"].to_numpy(np.int64)[row] + (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n))
            at = base[row] + start - pdf["lo"].to_numpy(np.int64)[row]
            out = pdf[["rk", "th", "w", "anchor"]].iloc[row].reset_index(drop=True)
            yield out.assign(start=start, name=names(x, at, WINDOW_AT).view(np.int64))

    both = ctx.select("rk", "th", "lo", "anchor", "bytes").join(requests, ["rk", "th", "lo"])
    return map_frames(both, run, "rk long, th long, w int, anchor long, start int, name long", (), CONTEXT_BYTES)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(rk, th, spans): byte ranges [from, to) of each document that repeated windows cover; a stored table.

    Tables are deleted as soon as what is made of them is stored, so that the disk holds one step's at a time.
    """
    # Counts are written before they are joined: a join of two shuffles can be split where an anchor is very frequent.
    every = materialize(all_runs(docs))
    again = materialize(every.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"))
    kept = materialize(every.join(again, "anchor"))
    discard(every, again)
    place = F.struct("rk", "th", "lo")
    kinds = kept.groupBy("anchor", "kind").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("at"), F.min("nw").alias("nw"), F.min("rel").alias("rel"))
    kinds = materialize(kinds)
    full = kept.join(kinds.where("n > 1").select("anchor", "kind"), ["anchor", "kind"])
    spans = full.select("rk", "th", F.col("lo").alias("from"), (F.col("lo") + F.col("nw") + WIDTH - 1).alias("to"))

    is_open = materialize(kinds.where("n = 1").select("anchor").distinct())
    wanted = kinds.join(is_open, "anchor")
    wanted = wanted.select("at.*", "nw", "rel", "anchor", F.least("n", F.lit(2)).cast("int").alias("weight"))
    ctx = materialize(contexts(docs, wanted))

    block = blocks(ctx)
    hulls = block.groupBy("anchor", "blk", "core", "hull", "whole").agg(
        F.sum("weight").alias("hw"), F.min(F.struct("rk", "th", "lo", "start")).alias("at"), F.min("cnt").alias("cnt"), F.min("weight").alias("lightest")
    )
    hulls = materialize(hulls)
    cores = hulls.groupBy("anchor", "blk", "core").agg(F.sum("hw").alias("cw"), F.min("hw").alias("least"))
    covered = hulls.where("whole and hw > 1 and lightest = 1").select("anchor", "blk", "core", "hull")
    block_spans = block.where("weight = 1 and whole").join(covered, ["anchor", "blk", "core", "hull"])
    block_spans = block_spans.select("rk", "th", F.col("start").alias("from"), (F.col("start") + F.col("cnt") + WIDTH - 1).alias("to"))

    requests = hulls.join(cores.where("cw > 1 and least = 1").select("anchor", "blk", "core"), ["anchor", "blk", "core"])
    requests = requests.select("at.*", "cnt", F.least("hw", F.lit(2)).cast("int").alias("w"))
    window = materialize(windows(ctx, requests))
    names_again = window.groupBy("anchor", "name").agg(F.sum("w").alias("n")).where("n > 1").select("anchor", "name")
    window_spans = window.where("w = 1").join(names_again, ["anchor", "name"])
    window_spans = window_spans.select("rk", "th", F.col("start").alias("from"), (F.col("start") + WIDTH).alias("to"))

    together = spans.unionByName(block_spans).unionByName(window_spans)
    # Equal rows share a key and bring the same spans; a set holds them once.
    out = materialize(together.groupBy("rk", "th").agg(F.collect_set(F.struct("from", "to")).alias("spans")))
    discard(kept, kinds, is_open, ctx, hulls, window)
    return out


def merged(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["from"], s["to"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, columns: tuple[str, ...] = ()) -> DataFrame:
    """Per document: doc_id, columns, text (what is left), n_bytes, n_removed, n_spans, kept_sha256."""
    docs = keyed(docs.select("doc_id", "text", *columns))
    spans = repeated_spans(docs).withColumnRenamed("rk", "_rk").withColumnRenamed("th", "_th")
    joined = docs.join(spans, (F.col("rk") == F.col("_rk")) & (F.col("th") == F.col("_th")), "left")
    joined = joined.select("doc_id", *columns, "text", "spans")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text, spans in zip(pdf["text"], pdf["spans"], strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                gone = merged(spans) if spans is not None else []
                cuts = [0, *(x for g in gone for x in g), len(raw)]
                left = b"".join(raw[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True)) if gone else raw
                rest = left.decode("utf-8", "ignore") if gone else text
                rows.append((rest, len(raw), sum(b - a for a, b in gone), len(gone), hashlib.sha256(left).hexdigest()))
            new = pd.DataFrame(rows, columns=["text", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
            yield pd.concat([pdf[["doc_id", *columns]].reset_index(drop=True), new], axis=1)

    extra = "".join(f", {f.name} {f.dataType.simpleString()}" for f in docs.schema if f.name in columns)
    return map_frames(joined, run, f"doc_id long{extra}, text string, n_bytes long, n_removed long, n_spans long, kept_sha256 string", ("doc_id", *columns))

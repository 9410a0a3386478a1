"""SimHash near-duplicate groups by exact tiled comparison.

Every text becomes a fingerprint: the majority, bit by bit, of the hashes of its word shingles
(a tie gives 0; a text without words the zero fingerprint, which links like any other). Two
fingerprints link if they differ in at most `radius` bits, and groups are the components of the
links.

Distinct fingerprints are sorted into classes by their number of set bits, and a class is cut into
chunks by hash. A tile pairs two chunks; pairs of classes whose bit counts differ beyond the radius
are skipped, as no link can lie there; small neighbouring classes share a chunk. Each remaining tile is compared in full with numpy
exclusive-or and bit counts, block by block, and hands on only a spanning forest of its links, at
most one edge for each row, so a large group of near copies never becomes all its pairs.

The chunk is a 24th of the rows (500 at least, CHUNK_ROWS at most), so a task holds two chunks; work grows
with the square of the number of distinct fingerprints, as in any exact comparison.

A null text counts as one without words. Rows that share a doc_id each keep their fingerprint and
fall into one group. Rows without a doc_id take part; a group of only such rows has a number above
2^62. Extra columns are ignored.

`similar_sets` is the stricter form for the corpus pipeline: fingerprints of the distinct shingles only
propose pairs, and a link counts once the shingle sets themselves have the wanted Jaccard similarity. There only
sets that share one of their first shingles are compared, which leaves no similar pair out, so its work does not grow with all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import components, map_frames, materialize, mix64

CHUNK_ROWS = 1_000_000
CHUNKS = 24
#: The Jaccard similarity that `similar_sets` demands, as a fraction.
SIMILAR = (4, 5)
#: Documents from which common shingles are learnt, how many of these there are at most, and shingles of a prefix that `similar_sets` tries first.
SAMPLE, COMMON, FIRST = 10_000, 200_000, 8
#: Sets in pairs up to which their keys are broadcast to find their texts; beyond it the texts are shuffled.
BROADCAST_KEYS = 500_000
#: Bytes of shingle sets that one side of a verifying task holds.
SET_BYTES = 24 << 20
#: Rows of one side that are compared with the other side at a time.
BLOCK_CELLS = 250_000

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingles(text: str | None, shingle: int) -> np.ndarray:
    """Hashes of the word shingles in order; fewer words than a shingle make one, no words none."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    whole = b" ".join(words)
    last = np.cumsum([len(w) + 1 for w in words]) - 1
    first = np.concatenate([[0], last[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    ends = last[shingle - 1 :] if len(words) >= shingle else last[-1:]
    return np.fromiter((xxhash.xxh64_intdigest(whole[a:b], 42) for a, b in zip(first[:n].tolist(), ends.tolist(), strict=True)), np.uint64, n)


def majority(h: np.ndarray, lanes: int) -> np.ndarray:
    """The fingerprint of shingle hashes as `lanes` 64-bit numbers; lane 0 comes from XXH64 itself, others from a mix of it."""
    n = len(h)
    if not n:
        return np.zeros(lanes, np.uint64)
    out = np.empty(lanes, np.uint64)
    for k in range(lanes):
        x = h if k == 0 else mix64(h, np.full(n, k, np.uint64))
        set_in = np.zeros(64, np.int64)
        for i in range(0, n, 4096):
            part = np.ascontiguousarray(x[i : i + 4096])
            set_in += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[k] = np.packbits(set_in * 2 > n, bitorder="little").view(np.uint64)[0]
    return out


def fingerprint(text: str | None, shingle: int, lanes: int) -> np.ndarray:
    return majority(shingles(text, shingle), lanes)


def fingerprints(docs: DataFrame, shingle: int, lanes: int) -> DataFrame:
    """(doc_id, f0 .. f{lanes-1} as signed longs) of every row."""
    names = [f"f{k}" for k in range(lanes)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            f = np.array([fingerprint(t, shingle, lanes) for t in pdf["text"]], np.uint64).reshape(-1, lanes).view(np.int64)
            out = pd.DataFrame(f, columns=names)
            out.insert(0, "doc_id", pdf["doc_id"].array)
            yield out

    return map_frames(docs.select("doc_id", "text"), run, "doc_id long, " + ", ".join(f"{n} long" for n in names))


def forest(fp: np.ndarray, left: np.ndarray, right: np.ndarray, radius: int) -> np.ndarray:
    """For each row of fp (lanes in columns) the first row of its component, by links from left to right rows."""
    label = np.arange(len(fp))
    step = max(1, BLOCK_CELLS // max(1, len(right)))
    cols = fp[right].T.copy()
    for i in range(0, len(left), step):
        rows = left[i : i + step]
        near = np.bitwise_count(fp[rows, 0][:, None] ^ cols[0][None, :])
        if len(cols) > 1:
            near += np.bitwise_count(fp[rows, 1][:, None] ^ cols[1][None, :])
        a, b = np.nonzero(near <= radius)
        if len(cols) > 2 and len(a):
            total = near[a, b].astype(np.int32)
            for k in range(2, len(cols)):
                total += np.bitwise_count(fp[rows[a], k] ^ cols[k][b])
            a, b = a[total <= radius], b[total <= radius]
        cut = np.searchsorted(a, np.arange(len(rows) + 1))
        for j in np.flatnonzero(np.diff(cut)):
            row, other = rows[j], right[b[cut[j] : cut[j + 1]]]
            old = np.unique(np.append(label[other], label[row]))
            if len(old) > 1:
                label[np.isin(label, old)] = old[0]
    return label


def prefix(hashes: np.ndarray, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first shingles of a sorted set, in the order of all shingles, of which two SIMILAR sets share one at least.

    The order is that of the hashes, with the `common` ones (sorted, with their rank) last. A set of n shares at least
    SIMILAR of its n with any set SIMILAR to it, so the first shingle that the two share is among its n - that + 1 first.
    """
    n = len(hashes)
    at = np.minimum(np.searchsorted(common, hashes), max(0, len(common) - 1))
    often = common[at] == hashes if len(common) else np.zeros(n, bool)
    last = hashes[often][np.argsort(rank[at[often]])] if often.any() else hashes[:0]
    return np.concatenate([hashes[~often], last])[: n - -(-n * SIMILAR[0] // SIMILAR[1]) + 1]


def common_shingles(docs: DataFrame, key: str, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many documents hold, sorted, and their rank from the rarest on.

    Any list gives the same links: it only says which shingles come last in `prefix`. So it is taken from some SAMPLE documents.
    """
    part = max(1, docs.count() // SAMPLE)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"h": np.concatenate([np.empty(0, np.uint64), *[np.unique(shingles(t, shingle)) for t in pdf["text"]]]).view(np.int64)})

    some = docs.where(F.pmod(F.xxhash64(key), F.lit(part)) == 0).select("text")
    counts = map_frames(some, run, "h long", ()).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 2")
    held = counts.orderBy(F.desc("n"), "h").limit(COMMON).toPandas()["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(held)
    return held[order], len(held) - order


def tiles(prints: DataFrame, lanes: int, radius: int, extra: tuple[str, ...] = (), chunks: int = CHUNKS) -> DataFrame | None:
    """Rows of every tile (t0, t1) with the chunk `own` they come from; None without rows."""
    names = [f"f{k}" for k in range(lanes)]
    bits = sum((F.bit_count(n) for n in names[1:]), F.bit_count(names[0]))
    names = [*names, *extra]
    rows = prints.select("id", *names, bits.cast("int").alias("bits"))
    size = {r["bits"]: r["n"] for r in rows.groupBy("bits").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(size.values())
    chunk = min(CHUNK_ROWS, max(500, -(-total // chunks)))
    # Chunks with the bit counts they hold: a large class is cut into several, small neighbours share one.
    first, pieces, spans = {}, {}, []
    held = chunk
    for p in sorted(size):
        if size[p] >= chunk or held + size[p] > chunk:
            first[p], pieces[p] = len(spans), -(-size[p] // chunk)
            spans += [[p, p] for _ in range(pieces[p])]
            held = size[p]
        else:
            first[p], pieces[p] = len(spans) - 1, 1
            spans[-1][1] = p
            held += size[p]
    partners = {p: [j for j, (lo, hi) in enumerate(spans) if lo - p <= radius and p - hi <= radius] for p in size}
    if not total:
        return None
    plan = prints.sparkSession.createDataFrame([(p, first[p], pieces[p], partners[p]) for p in size], "bits int, first int, chunks int, partners array<int>")
    rows = rows.join(F.broadcast(plan), "bits")  # one row for each bit count, 64 * lanes + 1 at most
    rows = rows.withColumn("own", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("chunks"))).cast("int"))
    rows = rows.select("id", *names, "own", F.explode("partners").alias("other"))
    return rows.select("id", *names, "own", F.least("own", "other").alias("t0"), F.greatest("own", "other").alias("t1"))


def links(prints: DataFrame, lanes: int, radius: int) -> DataFrame:
    """Edges (a, b) between the ids of distinct fingerprints that together connect every linked pair."""
    names = [f"f{k}" for k in range(lanes)]
    rows = tiles(prints, lanes, radius)
    if rows is None:
        return prints.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", ignore_index=True)
        fp = pdf[names].to_numpy(np.int64).view(np.uint64).reshape(len(pdf), lanes)
        own = pdf["own"].to_numpy()
        label = forest(fp, np.flatnonzero(own == key[0]), np.flatnonzero(own == key[1]), radius)
        at = np.flatnonzero(label != np.arange(len(label)))
        ids = pdf["id"].to_numpy()
        return pd.DataFrame({"a": ids[at], "b": ids[label[at]]})

    return rows.groupBy("t0", "t1").applyInPandas(run, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 4, lanes: int = 1, radius: int = 4) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits a lane) and component_id (smallest doc_id of the group)."""
    names = [f"f{k}" for k in range(lanes)]
    prints = materialize(fingerprints(docs, shingle, lanes))
    distinct = materialize(prints.groupBy(*names).agg(F.coalesce(F.min("doc_id"), F.shiftrightunsigned(F.xxhash64(*names), 2) + (1 << 62)).alias("id")))
    comp = components(links(distinct, lanes, radius))
    groups = distinct.join(comp, distinct["id"] == comp["node"], "left")
    groups = groups.select(*[F.col(n).alias(f"_{n}") for n in names], F.coalesce("component", "id").alias("component_id"))
    same = [F.col(n) == F.col(f"_{n}") for n in names]
    text = F.concat(*[F.lower(F.lpad(F.hex(n), 16, "0")) for n in names])
    return prints.join(groups, same).select("doc_id", text.alias("fingerprint"), "component_id")


def may_be_similar(a: str, b: str) -> str:
    """Whether sets of n shingles that first share those at places `at` of their order can reach SIMILAR."""
    x, y = SIMILAR
    return f"least({a}.n - {a}.at, {b}.n - {b}.at) * {x + y} >= {x} * ({a}.n + {b}.n)"


def neighbours(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets that share a shingle but no label: of each shingle the sets that stand beside each other by size, and each with the first. Their number grows with the rows."""
    order = W.partitionBy("h").orderBy("n", "id")
    me = F.struct("id", "n", "at", "label")
    beside = rows.withColumn("me", me).withColumn("other", F.array(F.lag(me).over(order), F.first(me).over(order)))
    found = beside.select("me", F.explode("other").alias("you")).where("me.label <> you.label").where(may_be_similar("me", "you"))
    return found.select(F.least("me.id", "you.id").alias("a"), F.greatest("me.id", "you.id").alias("b")).distinct()


def all_pairs(rows: DataFrame) -> DataFrame:
    """All pairs (a, b) of sets that share a shingle but no label and can be SIMILAR."""
    of = W.partitionBy("h")
    rows = rows.withColumn("low", F.min("label").over(of)).withColumn("high", F.max("label").over(of)).where("low < high").drop("low", "high")
    rows = materialize(rows)  # shingles whose sets are joined already are gone
    a, b = rows.alias("x"), rows.alias("y")
    found = a.join(b, F.expr(f"x.h = y.h AND x.id < y.id AND x.label <> y.label AND {may_be_similar('x', 'y')}"))
    return found.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def within(pairs: DataFrame, sets: DataFrame, lanes: int, radius: int) -> DataFrame:
    """The pairs whose fingerprints differ in at most `radius` bits."""
    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("id").alias(side), *[F.col(f"f{k}").alias(f"{side}{k}") for k in range(lanes)]), side)
    apart = sum((F.bit_count(F.col(f"a{k}").bitwiseXOR(F.col(f"b{k}"))) for k in range(lanes)), F.lit(0))
    return pairs.where(apart <= radius).select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, key: str, shingle: int) -> DataFrame:
    """The pairs (a, b) whose shingle sets have a Jaccard similarity of SIMILAR or more.

    Pairs are dealt to cells (bucket of a, bucket of b), and a set goes to the cells where it has a pair, so
    it travels once for each cell rather than once for each pair.
    """
    pairs = materialize(pairs)
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    n_pairs = pairs.count()
    if not n_pairs:
        return pairs
    # Any row of an equal set serves as its text.
    asked = materialize(ids.join(sets.select("id", "n", key), "id"))
    n_sets, held = asked.agg(F.count(F.lit(1)), F.sum("n")).first()
    held = held or 0
    keys = asked.select("id", key)
    texts = docs.select(key, "text").join(F.broadcast(keys) if n_sets <= BROADCAST_KEYS else keys, key).select("id", "text")
    buckets = max(1, -(-held * 8 // SET_BYTES), min(16, int((n_pairs / 5000) ** 0.5)))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "members": [np.unique(shingles(t, shingle)).tobytes() for t in pdf["text"]]})

    def check(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        members = {i: np.frombuffer(m, np.uint64) for i, m in zip(right["id"], right["members"], strict=True)}
        ok = np.zeros(len(left), bool)
        for j, (a, b) in enumerate(zip(left["a"], left["b"], strict=True)):
            x, y = members[a], members[b]
            both = len(np.intersect1d(x, y, assume_unique=True))
            ok[j] = both * SIMILAR[1] >= (len(x) + len(y) - both) * SIMILAR[0]
        return left.loc[ok, ["a", "b"]]

    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(buckets)).cast("int")
    cells = pairs.withColumn("c0", bucket("a")).withColumn("c1", bucket("b"))
    packed = materialize(map_frames(texts.dropDuplicates(["id"]), pack, "id long, members binary", ("id",)))
    need = cells.select(F.col("a").alias("id"), F.col("c0").alias("d0"), F.col("c1").alias("d1")).union(cells.select("b", "c0", "c1")).distinct()
    return materialize(cells.groupBy("c0", "c1").cogroup(materialize(need).join(packed, "id").groupBy("d0", "d1")).applyInPandas(check, "a long, b long"))


def similar_sets(docs: DataFrame, key: str, shingle: int, lanes: int, radius: int) -> DataFrame:
    """(key, component): components of the rows whose sets of distinct shingles are SIMILAR.

    Equal sets are one node, numbered by a 64-bit hash. Two SIMILAR sets share a shingle of their `prefix`, so only sets that
    meet at one are looked at, never all pairs. Of these, fingerprints within the radius propose a link, which counts once the
    sets themselves are compared. Neighbours at a shingle are tried first, so that a large group of near copies is joined by few
    links; every pair that still lies in two components comes last.
    """
    names = [f"f{k}" for k in range(lanes)]
    common, rank = common_shingles(docs, key, shingle)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [np.unique(shingles(t, shingle)) for t in pdf["text"]]
            f = np.array([majority(h, lanes) for h in rows], np.uint64).reshape(-1, lanes).view(np.int64)
            out = pd.DataFrame(f, columns=names)
            out.insert(0, "first", [prefix(h, common, rank).view(np.int64) for h in rows])
            out.insert(0, "n", np.array([len(h) for h in rows], np.int64))
            out.insert(0, "id", np.array([xxhash.xxh64_intdigest(h.tobytes(), 7) for h in rows], np.uint64).view(np.int64))
            out.insert(0, key, pdf[key].array)
            yield out

    kind = docs.schema[key].dataType.simpleString()
    prints = materialize(map_frames(docs.select(key, "text"), run, f"{key} {kind}, id long, n long, first array<long>, " + ", ".join(f"{x} long" for x in names), (key,)))
    sets = materialize(prints.groupBy("id", "n", *names).agg(F.min(key).alias(key)))
    met = prints.select("id", "n", "first").dropDuplicates(["id"]).select("id", "n", F.posexplode("first").alias("at", "h"))
    met = materialize(met.withColumn("sets", F.count(F.lit(1)).over(W.partitionBy("h"))).where("sets > 1").drop("sets"))
    found = verified(within(neighbours(met.where(f"at < {FIRST}").withColumn("label", F.col("id"))), sets, lanes, radius), sets, docs, key, shingle)
    for pairs in (neighbours, all_pairs):
        label = components(found).withColumnRenamed("node", "id").withColumnRenamed("component", "label")
        rows = materialize(met.join(label, "id", "left").withColumn("label", F.coalesce("label", "id")))
        found = found.unionByName(verified(within(pairs(rows), sets, lanes, radius), sets, docs, key, shingle))
    comp = components(found)
    groups = prints.select(key, "id").join(comp, F.col("id") == F.col("node"), "left")
    return groups.select(key, F.coalesce("component", "id").alias("component"))

"""Balanced label propagation: documents into shards of equal counts, equal texts together.

Documents are linked if their texts are equal. The state is one row for each (group of equal texts, shard)
with the number of its documents there, a cell. Documents start dealt evenly; then come rounds of joins and
aggregates. In each a group votes for the shard with most of its members among those with room for all of it,
else among those with some room; its other cells ask to move there, and every shard grants what fits, the largest
groups first. Cells that have moved are added up, loads and votes are taken anew from that, and so on until no
cell asks, or none can be granted.

During the rounds a shard may hold SLACK of its quota more, since without such play full shards could never
exchange anything. What is beyond the quota in the end leaves in order of groups, so at most one group a shard is cut
by it, and fills shards with room likewise. Groups of more than a 1,000th of the rows (and than LIGHT_ROWS), under 1,000 in number,
are placed before, one by one, each in the shard with most of its members that takes all of it, or in as few
shards as the room allows. Documents without a link fill the shards to the quotas, which differ by one
row at most (law `rows`).

A null text is a text of its own kind (size 1). Repeated rows are documents of their own. Extra columns
are ignored. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import gapless_rank, hash_parts, materialize

#: Bins by which moves into a shard are granted, at first and at most.
BINS, MOST_BINS = 512, 8192
#: Share of its quota that a shard may hold beyond it while groups move.
SLACK = 1 / 16
#: Rounds after which propagation ends in any case.
MOST_ROUNDS = 40
#: Rows of a group up to which it takes part in propagation however few rows there are in all.
LIGHT_ROWS = 1_000


def place(votes: dict[str, dict[int, int]], room: list[int]) -> list[tuple[str, int, int]]:
    """Rows (key, shard, n) of groups placed one by one, the largest first; room is reduced."""
    out = []
    for key, mine in sorted(votes.items(), key=lambda kv: (-sum(kv[1].values()), kv[0])):
        left = sum(mine.values())
        while left:
            fit = [s for s in range(len(room)) if room[s] >= left]
            # The most members among shards that take all of it; else as much as the emptiest shard takes.
            s = max(fit, key=lambda s: (mine.get(s, 0), room[s], -s)) if fit else max(range(len(room)), key=lambda s: (room[s], mine.get(s, 0), -s))
            n = min(left, room[s])
            out.append((key, s, n))
            room[s] -= n
            left -= n
    return out


def by_bounds(place: Column, sizes: list[int]) -> Column:
    """The interval (0, 1, 2 ...) of the given sizes, laid end to end, in which a place lies."""
    bounds = [sum(sizes[: i + 1]) for i in range(len(sizes))]
    return F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= place)).cast("int")


def loads(state: DataFrame, shards: int) -> list[int]:
    held = {r["shard"]: r["n"] for r in state.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    return [held.get(s, 0) for s in range(shards)]


def propagate(cells: DataFrame, quota: list[int]) -> DataFrame:
    """Rounds of votes, grants and moves of cells (key, shard, n) within the quotas and their slack."""
    spark, shards, bins = cells.sparkSession, len(quota), BINS
    most = [int(q * (1 + SLACK)) + 1 for q in quota]
    for turn in range(MOST_ROUNDS):
        room = [m - n for m, n in zip(most, loads(cells, shards), strict=True)]
        open_to = F.array(*[F.lit(r) for r in room])
        # Ties lean by hash, so that equal groups don't all ask for the first shard.
        lean = lambda s: F.pmod(F.xxhash64("key", s), F.lit(1 << 20))
        held = F.collect_list(F.struct("n", lean(F.col("shard")).alias("lean"), "shard"))
        groups = cells.groupBy("key").agg(held.alias("held"), F.sum("n").cast("long").alias("size")).where(F.size("held") > 1)
        members = F.map_from_entries(F.transform("held", lambda h: F.struct(h["shard"], h["n"])))
        every = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.struct(F.coalesce(F.try_element_at(members, s), F.lit(0)).cast("long").alias("n"), lean(s).alias("lean"), s.alias("shard")))
        takes_all = F.array_max(F.filter(every, lambda h: F.col("size") - h["n"] <= F.get(open_to, h["shard"])))
        takes_some = F.array_max(F.filter("held", lambda h: F.get(open_to, h["shard"]) > 0))
        asking = groups.select("key", "size", "held", takes_all.alias("all"), takes_some.alias("some"))
        asking = asking.select("key", "size", F.col("all").isNotNull().alias("whole"), F.coalesce("all", "some").alias("best"), F.explode("held").alias("h")).where("best IS NOT NULL")
        # A group that a shard takes whole moves at once. Of another, a larger cell in a full shard stays, and the others come
        # as they fit; every granted move gathers a group further, so the rounds end.
        asking = asking.where((F.col("h.shard") != F.col("best.shard")) & (F.col("whole") | (F.col("h") < F.col("best"))))
        strength = F.least(F.lit(31), F.floor(F.log2("size"))).cast("int")
        rank = F.pmod(F.xxhash64("key", F.when(F.col("whole"), -1).otherwise(F.col("h.shard")), F.lit(turn)), F.lit(bins // 32)).cast("int")
        asking = materialize(asking.select("key", F.col("best.shard").alias("to"), F.col("h.shard").alias("shard"), F.col("h.n").alias("n"), ((31 - strength) * (bins // 32) + rank).alias("bin")))
        wanted = asking.groupBy("to", "bin").agg(F.sum("n").alias("n")).collect()  # shards * bins rows at most
        grant = []
        for r in sorted(wanted, key=lambda r: (r["to"], r["bin"])):
            if r["n"] <= room[r["to"]]:
                room[r["to"]] -= r["n"]
                grant.append((r["to"], r["bin"]))
        if not wanted or (not grant and bins >= MOST_BINS):
            break
        if not grant:
            bins *= 4
            continue
        admitted = F.broadcast(spark.createDataFrame(grant, "to int, bin int"))
        moves = asking.join(admitted, ["to", "bin"]).select("key", "shard", F.col("to"))
        moved = cells.join(moves, ["key", "shard"], "left").select("key", F.coalesce("to", "shard").alias("shard"), "n")
        cells = materialize(moved.groupBy("key", "shard").agg(F.sum("n").cast("long").alias("n")))
    return cells


def links_cut(cells: DataFrame) -> int:
    """Pairs of equal texts that lie in different shards, of cells (key, shard, n)."""
    n = F.col("n").cast("double")
    group = cells.groupBy("key").agg(((F.sum(n) * F.sum(n) - F.sum(n * n)) / 2).alias("cut"))
    return int(group.agg(F.sum("cut")).first()[0] or 0)


def deal(rows: DataFrame, cells: DataFrame, by: DataFrame | None = None) -> DataFrame:
    """Documents to the cells of their group: all to one shard, or by their rank in the group. by: the groups to broadcast, else none."""
    ends = F.sum("n").over(W.partitionBy("key").orderBy("shard"))
    cut = cells.withColumn("end", ends).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("end", "shard"))).alias("cells"))
    hint = (lambda df: F.broadcast(df.join(by, "key", "left_semi"))) if by is not None else (lambda df: df)
    whole = rows.join(hint(cut.where(F.size("cells") == 1).select("key", F.col("cells")[0]["shard"].alias("shard"))), "key")
    split = gapless_rank(rows.join(hint(cut.where(F.size("cells") > 1)), "key"), ["key"], "_row", 64, "rank")
    split = split.withColumn("shard", F.filter("cells", lambda p: p["end"] > F.col("rank"))[0]["shard"]).drop("cells", "rank")
    return whole.unionByName(split.select(*whole.columns))


def trim(rows: DataFrame, quota: list[int], parts: int) -> DataFrame:
    """Move what lies in a shard beyond its quota to shards with room, in order of groups."""
    held = loads(rows.withColumn("n", F.lit(1)), len(quota))
    over = [max(0, n - q) for n, q in zip(held, quota, strict=True)]
    if not sum(over):
        return rows
    ranked = materialize(gapless_rank(rows, ["shard"], "key", parts, "rank"))
    limit = F.get(F.array(*[F.lit(q) for q in quota]), F.col("shard"))
    # The place of a moved document among all that move: its shard's, then its own beyond the limit.
    before = F.get(F.array(*[F.lit(sum(over[:s])) for s in range(len(quota))]), F.col("shard"))
    room = [max(0, q - n) for n, q in zip(held, quota, strict=True)]
    to = by_bounds(before + F.col("rank") - limit, room)
    return ranked.withColumn("shard", F.when(F.col("rank") < limit, F.col("shard")).otherwise(to)).drop("rank")


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Per document: doc_id, size, text_crc32, law, shard, slot, grown_shard (always null under this law)."""
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    base = docs.select(
        "doc_id",
        (F.length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).cast("long").alias("text_crc32"),
        F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("null")).alias("key"),
    )
    # The number of a row is fixed by writing it.
    base = materialize(base.withColumn("_row", F.monotonically_increasing_id()))
    total = base.count()
    parts, many = hash_parts(total), max(LIGHT_ROWS, total // 1000)
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    groups = materialize(base.groupBy("key").agg(F.count(F.lit(1)).alias("copies")))
    # Groups beyond that number under 1,000; only they can be hot, and they are broadcast.
    heavy = F.broadcast(groups.where(F.col("copies") > many))
    light = groups.where((F.col("copies") > 1) & (F.col("copies") <= many))
    heavy_rows = base.join(heavy, "key")
    rest = base.join(heavy.select("key"), "key", "left_anti").join(light, "key", "left")

    start = F.pmod(F.xxhash64("_row"), F.lit(shards)).cast("int")
    begin = heavy_rows.groupBy("key", start.alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    votes: dict[str, dict[int, int]] = {}
    for r in begin.collect():  # heavy groups * shards rows at most
        votes.setdefault(r["key"], {})[r["shard"]] = r["n"]
    room = list(quota)
    heavy_cells = base.sparkSession.createDataFrame(place(votes, room), "key string, shard int, n long")

    linked = materialize(gapless_rank(rest.where("copies IS NOT NULL").drop("copies"), [], "_row", parts, "rank"))
    n_linked = linked.count()
    # Dealt evenly over the quotas that are left, so that no shard begins beyond its own.
    spread = F.expr(f"rank * {sum(room)} div {max(1, n_linked)}")
    cells = linked.groupBy("key", by_bounds(spread, room).alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    cells = propagate(materialize(cells), room)

    light_rows = materialize(deal(linked.drop("rank"), cells))
    light_rows = materialize(trim(light_rows, room, parts))
    placed = light_rows.unionByName(deal(heavy_rows.drop("copies"), heavy_cells, heavy.select("key")).select(*light_rows.columns))
    free = [q - n for q, n in zip(room, loads(light_rows.withColumn("n", F.lit(1)), shards), strict=True)]
    singles = gapless_rank(rest.where("copies IS NULL").drop("copies"), [], "_row", parts, "rank")
    singles = singles.withColumn("shard", by_bounds(F.col("rank"), free)).drop("rank")
    every = materialize(placed.unionByName(singles.select(*placed.columns)))
    out = gapless_rank(every, ["shard"], "_row", max(1, parts // shards), "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

A seed is the hash of the words that a mask keeps, taken at every word of a text; positions between
the kept ones may differ. Seeds of documents join seeds of benchmark items; each hit fixes an
alignment (item, shift), and the aligned words are then compared one by one. A document is
contaminated by an item if at some shift at least `overlap` of the item's words agree with it.

The two masks hit every pattern of up to 20 % substituted words in an item of 7 words or more
(checked over all patterns of lengths 7 to 20; longer items hold such a stretch). Shorter items add masks of
their own: items of 5 and 6 words, where one word may differ, and items of 1 to 4 words, which must agree in
all. Documents make the seeds only of masks that some item asks for. So with the default overlap nothing is
missed at any length. Null texts and items without words are not searched for.

Words are the runs of non-space characters of the lower-cased text. Every row is judged by its own text,
equal texts once, whatever its doc_id, which may be null or repeated. Texts are searched whole, and a hit carries only the words beside its item,
so a long or repetitive text grows with its hits, not with their number times its length. Extra columns
are ignored; an empty table on either side gives no contamination. Beyond BROADCAST_ROWS both sides are
shuffled by seed, where Spark splits the partition of a very frequent seed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Kept word offsets of each mask.
MASKS = ((0, 1, 2, 3), (0, 1, 2, 4))
#: Masks of items with fewer words than 7, by their number; all others take MASKS.
SHORT_MASKS = {
    1: ((0,),),
    2: ((0, 1),),
    3: ((0, 1, 2),),
    4: ((0, 1, 2, 3),),
    5: (*MASKS, (0, 2, 3, 4), (0, 1, 3, 4)),
    6: (*MASKS, (0, 1, 3, 4)),
}
OVERLAP = 0.8
#: Benchmark rows, seeds and hits up to which that side is broadcast; beyond it Spark shuffles both sides.
BROADCAST_ROWS = 500_000


def words(text: str = "text") -> Column:
    return F.array_remove(F.split(F.lower(F.col(text)), r"[\x20\x09-\x0D]+"), "")


def masks_of(n_words: int) -> tuple[tuple[int, ...], ...]:
    """The masks by which an item of so many words is found."""
    return SHORT_MASKS.get(n_words, MASKS)


def seeds(word_hashes: str, masks: list[tuple[int, ...]]) -> Column:
    """All seeds of an array of word hashes: element i * len(masks) + m is mask m at word i."""
    a = F.col(word_hashes)
    # The kept offsets tell masks apart, whatever masks are used besides.
    at_word = lambda _, i: F.array(*[F.xxhash64(F.lit(str(mask)), *[F.get(a, i + o) for o in mask]) for mask in masks])
    return F.flatten(F.transform(a, at_word))


def seed_rows(df: DataFrame, key: str, masks: list[tuple[int, ...]], by_length: bool = False) -> DataFrame:
    """(key, at, seed): seeds of every word of every row; a seed never reaches past the text's end.

    With by_length a row makes only the seeds of its own length's masks.
    """
    hashed = df.select(key, F.transform(words(), lambda w: F.xxhash64(w)).alias("_h"))
    flat = hashed.select(key, F.size("_h").alias("_n"), F.posexplode(seeds("_h", masks)).alias("_p", "seed"))
    mask = (F.col("_p") % len(masks)).cast("int")
    reach = F.element_at(F.array(*[F.lit(m[-1]) for m in masks]), mask + 1)
    at = F.floor(F.col("_p") / len(masks)).cast("int")
    flat = flat.where(at + reach < F.col("_n"))
    if by_length:
        usual = mask.isin([i for i, m in enumerate(masks) if m in MASKS])
        for n, own in SHORT_MASKS.items():
            usual = F.when(F.col("_n") == n, mask.isin([i for i, m in enumerate(masks) if m in own])).otherwise(usual)
        flat = flat.where(usual)
    return flat.select(key, at.alias("at"), "seed")


def small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def contamination(docs: DataFrame, benchmark: DataFrame, overlap: float = OVERLAP) -> DataFrame:
    """Per contaminated doc_id: n_items (items found in it), item_id and best (the largest overlap). Rows that share a doc_id are taken for one text."""
    docs = docs.select("doc_id", "text")
    items = benchmark.select("item_id", "text").where("text is not null").distinct()
    lengths = [r["n"] for r in items.select(F.least(F.size(words()), F.lit(7)).alias("n")).distinct().collect()]  # 8 rows at most
    masks = sorted({m for n in lengths if n for m in masks_of(n)}) or list(MASKS)
    item_seeds = materialize(seed_rows(items, "item_id", masks, by_length=True).select("item_id", F.col("at").alias("item_at"), "seed"))
    n_seeds = item_seeds.count()
    hits = seed_rows(docs, "doc_id", masks).join(small(item_seeds, n_seeds), "seed")
    hits = hits.select("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    hits = materialize(hits)
    n_hits = hits.count()
    item_words = items.select("item_id", words().alias("_item"))
    sized = hits.join(small(item_words.select("item_id", F.size("_item").alias("n")), n_seeds), "item_id")
    # An item_id with several texts has its alignments for each of their lengths.
    by_doc = sized.groupBy("doc_id").agg(F.collect_set(F.struct("item_id", "shift", "n")).alias("_hits"))
    found = docs.join(small(by_doc, n_hits), "doc_id").select("doc_id", "text", "_hits")
    # The words are bound once for a document; a hit takes along only those beside its item, not the text.
    first = lambda h: F.greatest(h["shift"], F.lit(0))
    beside = lambda d, h: F.slice(d, first(h).cast("int") + 1, F.greatest(F.lit(0), h["n"] + F.least(h["shift"], F.lit(0))).cast("int"))
    cut = F.transform(F.array(words()), lambda d: F.transform("_hits", lambda h: F.struct(h["item_id"].alias("item_id"), h["n"].alias("n"), F.least(h["shift"], F.lit(0)).alias("shift"), beside(d, h).alias("_doc"))))
    found = found.select("doc_id", F.explode(F.flatten(cut)).alias("_hit")).select("doc_id", "_hit.*").distinct()
    found = found.join(small(item_words, n_seeds), "item_id").where(F.size("_item") == F.col("n"))
    agree = F.size(F.filter(F.transform("_item", lambda w, i: w == F.get("_doc", (i + F.col("shift")).cast("int"))), lambda x: x))
    found = found.select("doc_id", "item_id", (agree / F.size("_item")).alias("share")).where(F.col("share") >= overlap)
    best = found.groupBy("doc_id", "item_id").agg(F.max("share").alias("share")).groupBy("doc_id")
    return best.agg(
        F.count(F.lit(1)).alias("n_items"),
        F.max(F.struct("share", -F.col("item_id"))).alias("_best"),
    ).select("doc_id", "n_items", (-F.col("_best.col2")).alias("item_id"), F.col("_best.share").alias("best"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, overlap: float = OVERLAP) -> DataFrame:
    """Per row: doc_id, contaminated, n_items, item_id (null if clean), best (0 if clean)."""
    keyed = docs.select("doc_id", "text", F.md5(F.col("text").cast("binary")).alias("_text"))
    texts = keyed.where("text IS NOT NULL").select(F.col("_text").alias("doc_id"), "text")
    bad = materialize(contamination(texts, benchmark, overlap)).withColumnRenamed("doc_id", "_text")
    out = keyed.select("doc_id", "_text").join(small(bad, bad.count()), "_text", "left")
    return out.select(
        "doc_id",
        F.col("n_items").isNotNull().alias("contaminated"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.col("item_id").cast("long").alias("item_id"),
        F.coalesce("best", F.lit(0.0)).alias("best"),
    )

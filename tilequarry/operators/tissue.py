"""Tissue masks of rasters of any size: saturation, Otsu's threshold, closing, and components of enough pixels.

After the threshold a row of pixels is words of WORD bits. Closing by the disk of radius 1 (a plus) works on
words with their left and right neighbours, in strips one word wide, so that a raster is spread over its strips.
Components are found on the runs of the rows: runs that touch in neighbouring rows are linked, by equality of
blocks of columns, and the links' components come from joins. No step gathers a raster in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import materialize
from .erosion import WORD, merged
from .graphs import components
from .rasters import otsu
from .tiles import bits

BINS = 256
#: A raster whose signal spans less has no tissue.
FLAT = 1e-6
#: Columns of a block by which runs of neighbouring rows are brought together.
LINK_BLOCK = 64


def saturation(r: Column, g: Column, b: Column) -> Column:
    """Saturation (HSV) of a colour of three channels; black has none."""
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    return F.when(high > 0, (high - low) / high).otherwise(F.lit(0.0))


def inverse_grey(v: Column) -> Column:
    return 1.0 - v / 255.0


def threshold(px: DataFrame, key: str, signal: str) -> DataFrame:
    """(key, limit) of each raster: the centre of Otsu's bin of BINS between its smallest and largest signal; flat rasters have none."""
    ends = px.groupBy(key).agg(F.min(signal).alias("low"), F.max(signal).alias("high")).where(F.col("high") - F.col("low") >= FLAT)
    ends = ends.withColumn("span", F.col("high") - F.col("low"))
    number = F.least(F.lit(BINS - 1), F.floor((F.col(signal) - F.col("low")) / F.col("span") * BINS)).cast("int")
    best = otsu(px.join(ends, key).withColumn("bin", number), key, "bin")
    return ends.join(best, key).select(key, (F.col("low") + (F.col("threshold") + 0.5) * F.col("span") / BINS).alias("limit"))


def mask_words(px: DataFrame, key: str, signal: str) -> DataFrame:
    """(key, y, word, c, there): set pixels and pixels there at all, for every word of every row of a raster that is not flat.

    A raster is the whole rectangle from (0, 0) to its last row and column; a pixel that px lacks is there, but not set.
    """
    limits, none = threshold(px, key, signal), F.lit(0).cast("long")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("x") % WORD).cast("int"))
    on = px.join(limits, key).where(F.col(signal) > F.col("limit")).select(key, F.col("y").cast("int").alias("y"), F.expr(f"x div {WORD}").alias("word"), bit.alias("c"), none.alias("there"))
    sides = px.groupBy(key).agg(F.max("y").cast("int").alias("bottom"), F.max("x").cast("long").alias("right")).join(limits.select(key), key)
    rows = sides.withColumn("y", F.explode(F.sequence(F.lit(0), "bottom"))).withColumn("word", F.explode(F.sequence(none, F.expr(f"right div {WORD}"))))
    there = bits(none, F.least(F.lit(WORD), F.col("right") + 1 - F.col("word") * WORD))
    every = on.unionByName(rows.select(key, "y", "word", none.alias("c"), there.alias("there")))
    return every.groupBy(key, "y", "word").agg(F.bit_or("c").alias("c"), F.bit_or("there").alias("there"))


def close_words(words: DataFrame, key: str) -> DataFrame:
    """Closing by a plus of five pixels; what lies outside neither sets nor clears a pixel."""
    top, full = WORD - 1, (1 << WORD) - 1
    row = W.partitionBy(key, "y").orderBy("word")
    none = F.lit(0).cast("long")
    s = words.withColumn("l", F.lag("c", 1, 0).over(row)).withColumn("r", F.lead("c", 1, 0).over(row))
    s = s.withColumn("tl", F.lag("there").over(row)).withColumn("tr", F.coalesce(F.lead("there").over(row), none))
    strip = W.partitionBy(key, "word").orderBy("y")
    for n in "clr":
        s = s.withColumn(f"{n}_beside", F.lag(n, 1, 0).over(strip).bitwiseOR(F.lead(n, 1, 0).over(strip)))
    s = s.withColumn("grown", F.expr(f"(c | shiftleft(c, 1) | shiftright(c, 1) | (shiftright(l, {top}) & 1) | shiftleft(r & 1, {top}) | c_beside) & there"))
    # The pixel left of the word and the one right of it, grown likewise; 1 where there is none.
    s = s.withColumn("on_left", F.expr(f"CASE WHEN tl IS NULL THEN 1 ELSE (shiftright(l, {top}) | shiftright(l, {top - 1}) | c | shiftright(l_beside, {top})) & 1 END"))
    s = s.withColumn("on_right", F.expr(f"CASE WHEN tr & 1 = 0 THEN 1 ELSE (r | shiftright(r, 1) | shiftright(c, {top}) | r_beside) & 1 END"))
    s = s.withColumn("above", F.coalesce(F.lag("grown").over(strip), F.lit(full))).withColumn("below", F.coalesce(F.lead("grown").over(strip), F.lit(full)))
    # Beyond the last pixel of a row lies nothing, which clears no pixel.
    ended = f"({full} & ~shiftright(there, 1))"
    kept = f"grown & (shiftleft(grown, 1) | on_left) & (shiftright(grown, 1) | shiftleft(on_right, {top}) | ({ended} & {full >> 1})) & above & below"
    return s.select(key, "y", "word", F.expr(kept).alias("bits"))


def runs(words: DataFrame, key: str) -> DataFrame:
    """Words of bits as the runs (key, y, a, b) of each row, half open."""
    on = lambda i: F.call_function("shiftright", F.col("bits"), i).bitwiseAND(F.lit(1).cast("long")) == 1
    at = F.sequence(F.lit(0), F.lit(WORD - 1))
    first = F.filter(at, lambda i: on(i) & ((i == 0) | ~on(F.greatest(F.lit(0), i - 1))))
    last = F.filter(at, lambda i: on(i) & ((i == WORD - 1) | ~on(F.least(F.lit(WORD - 1), i + 1))))
    cut = words.where("bits <> 0").select(key, "y", "word", F.explode(F.arrays_zip(first.alias("a"), last.alias("b"))).alias("s"))
    place = lambda c: F.col("word") * WORD + F.col(f"s.{c}")
    return merged(cut.select(key, "y", place("a").cast("long").alias("a"), (place("b") + 1).cast("long").alias("b")), key)


def label_runs(rows: DataFrame, key: str) -> DataFrame:
    """Adds component to runs (key, y, a, b): the (y, a) of the first run of its 4-connected component."""
    node = lambda y, a: F.struct(F.col(key).alias("key"), y.cast("long").alias("y"), a.cast("long").alias("a"))
    cut = rows.withColumn("block", F.explode(F.expr(f"sequence(a div {LINK_BLOCK}, (b - 1) div {LINK_BLOCK})")))
    below = cut.select(F.col(key), (F.col("y") - 1).alias("y"), F.col("a").alias("a2"), F.col("b").alias("b2"), "block")
    met = cut.join(below, [key, "y", "block"]).where("a < b2 AND a2 < b")
    edges = met.select(node(F.col("y"), F.col("a")).alias("a"), node(F.col("y") + 1, F.col("a2")).alias("b"))
    found = components(edges).select(F.col("node.key").alias(key), F.col("node.y").alias("y"), F.col("node.a").alias("a"), "component")
    alone = F.struct(F.col("y").cast("long").alias("y"), F.col("a").cast("long").alias("a"))
    out = rows.join(found, [key, "y", "a"], "left")
    own = F.when(F.col("component").isNotNull(), F.struct(F.col("component.y").alias("y"), F.col("component.a").alias("a"))).otherwise(alone)
    return out.withColumn("component", own)


def tissue_mask(px: DataFrame, key: str, signal: str, min_pixels: int = 16) -> DataFrame:
    """The mask as runs (key, y, a, b). px holds every pixel (key, y, x) of a raster with its signal."""
    rows = materialize(runs(close_words(mask_words(px, key, signal), key), key))
    if min_pixels <= 1:
        return rows
    labelled = label_runs(rows, key)
    size = labelled.groupBy(key, "component").agg(F.sum(F.col("b") - F.col("a")).alias("pixels"))
    return labelled.join(size.where(F.col("pixels") >= min_pixels), [key, "component"]).select(key, "y", "a", "b")

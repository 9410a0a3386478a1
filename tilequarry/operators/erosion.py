"""What is left of a class when it is shrunk: shapes as rows of spans, rows as words of bits.

Shapes are dealt once, as the rows of their spans, to cells of a slide, each with as much around it as the square
reaches, and everything about a cell is settled where it was dealt. The shapes of a class are merged to the runs of
each pixel row, which holds touching shapes together. A run shrinks along its row by arithmetic; the rows are then
words of WORD pixels, and a word survives with the bits that all rows of the square's height share, a window over the
rows around it. Who owns a pixel, the latest shape, comes from the same words. No row of data is a pixel, and what is
gathered is one cell, whatever the slide holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tiles import TileParams, between, bits, both_kinds, box_pixels, erode_radius, label_of, on_slide, scale, tasks_of, with_spans

#: Pixels in a word; powers of two up to this one are exact in a long without its sign.
WORD = 60


def merged(rows: DataFrame, *keys: str) -> DataFrame:
    """Overlapping and touching spans of a row as one."""
    w = W.partitionBy(*keys, "y").orderBy("a", "b")
    reach = F.max("b").over(w.rowsBetween(W.unboundedPreceding, -1))
    begun = rows.withColumn("_new", F.when(reach.isNull() | (F.col("a") > reach), 1).otherwise(0))
    runs = begun.withColumn("_run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "y", "_run").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("_run")


def side_of(p: TileParams) -> Column:
    """Side of the square that a class is shrunk by; null where it is not shrunk at all."""
    r = erode_radius(p)
    return F.when(r >= 1, F.greatest(F.lit(1.0), F.rint(2 * r))).cast("long")


#: A cell of a slide: its pixels, and those around it that a square on them reaches. How far a square reaches back and ahead.
CELL_KEYS = ["image_id", "cy", "cx"]
BACK, AHEAD = "side div 2", "(side - 1 - side div 2)"


def cell_rows(shapes: DataFrame, scaled: DataFrame, p: TileParams) -> DataFrame:
    """The pixels of each shape by cell and row, on slides that are shrunk: CELL_KEYS, cell, shape_id, folder, side, y, and a to b (half open).

    The square of an even side reaches one pixel further to the left and upwards than to the right and down. A cell is
    at least twice as wide as a square, so that few shapes lie in many of them.
    """
    keep = ["image_id", "shape_id", "folder", "side", "tw", "th", "spans"]
    line = F.transform(F.sequence("ay", "ey"), lambda y: F.struct(y.alias("y"), F.col("ax").alias("x_from"), (F.col("ex") + 1).alias("x_to")))
    shrunk = lambda s: on_slide(s, scaled, p).withColumn("side", side_of(p)).where("side IS NOT NULL")
    s = both_kinds(shapes, lambda s: box_pixels(shrunk(s)).withColumn("spans", line).select(*keep), lambda s: with_spans(shrunk(s)).select(*keep))
    s = s.withColumn("cell", F.expr(f"{WORD} * greatest(1, (2 * side + {WORD} - 1) div {WORD})"))
    reached = lambda low, high, size: F.explode(F.expr(f"sequence(greatest(0, ({low} - {AHEAD}) div cell), least(({high} + {BACK}) div cell, ({size} - 1) div cell))"))
    s = s.withColumn("ay", F.element_at("spans", 1)["y"]).withColumn("ey", F.element_at("spans", -1)["y"]).withColumn("cy", reached("ay", "ey", "th"))
    s = between(s, F.expr(f"cy * cell - {BACK}"), F.expr(f"(cy + 1) * cell + {AHEAD}")).withColumn("cx", reached("ax", "ex", "tw"))
    ends = [F.col(f"spans.{n}").cast("array<int>").alias(n) for n in ("y", "x_from", "x_to")]
    s = s.select(*CELL_KEYS, "cell", "shape_id", "folder", "side", *ends).repartition(tasks_of(shapes), *CELL_KEYS)
    s = s.select(*CELL_KEYS, "cell", "shape_id", "folder", "side", F.explode(F.arrays_zip("y", "x_from", "x_to")).alias("q"))
    a, b = F.greatest("q.x_from", F.expr(f"cx * cell - {BACK}")), F.least("q.x_to", F.expr(f"(cx + 1) * cell + {AHEAD}"))
    return s.withColumn("y", F.col("q.y").cast("long")).withColumn("a", a).withColumn("b", b).drop("q").where("a < b")


def shrunk_rows(rows: DataFrame) -> DataFrame:
    """Rows with what is left along the row of the run of their class that they are part of: adds left_a to left_b (half open, none if not below)."""
    row = W.partitionBy(*CELL_KEYS, "folder", "y").orderBy("a", "b")
    reach = F.max("b").over(row.rowsBetween(W.unboundedPreceding, -1))
    begun = rows.withColumn("_new", F.when(reach.isNull() | (F.col("a") > reach), 1).otherwise(0))
    run = W.partitionBy(*CELL_KEYS, "folder", "y", "_run")
    runs = begun.withColumn("_run", F.sum("_new").over(row.rowsBetween(W.unboundedPreceding, 0)))
    runs = runs.withColumn("left_a", F.min("a").over(run) + F.expr(BACK)).withColumn("left_b", F.max("b").over(run) - F.expr(AHEAD))
    return runs.drop("_new", "_run")


def words(rows: DataFrame) -> DataFrame:
    """Rows as the words of their cell: adds word, bits (a to b) and left (left_a to left_b), instead of these ends."""
    low, high = "greatest(a, cx * cell)", "least(b, (cx + 1) * cell)"
    cut = rows.where(f"{low} < {high}").withColumn("word", F.explode(F.expr(f"sequence({low} div {WORD}, ({high} - 1) div {WORD})")))
    within = lambda c: F.greatest(F.lit(0), F.least(F.lit(WORD), F.col(c) - F.col("word") * WORD))
    left = F.when(F.col("left_a") < F.col("left_b"), bits(within("left_a"), within("left_b"))).otherwise(F.lit(0).cast("long"))
    return cut.withColumn("bits", bits(within("a"), within("b"))).withColumn("left", left).drop("a", "b", "left_a", "left_b")


def with_kept(held: DataFrame) -> DataFrame:
    """Words with the bits `kept` that a square of `side` pixels leaves of their class; outside counts as not set."""
    # Rows in units of the side: a square's rows are those from half a side above to less than half a side below.
    held = held.withColumn("_at", F.col("y") / F.col("side"))
    row = W.partitionBy(*CELL_KEYS, "folder", "word", "_at").orderBy("shape_id")
    held = held.withColumn("_first", (F.row_number().over(row) == 1).cast("int"))
    held = held.withColumn("left", F.bit_or("left").over(row.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    square = f"OVER (PARTITION BY {', '.join(CELL_KEYS)}, folder, word ORDER BY _at RANGE BETWEEN 0.5000001D PRECEDING AND 0.4999999D FOLLOWING)"
    kept = F.when(F.expr(f"sum(_first) {square}") == F.col("side"), F.expr(f"bit_and(left) {square}")).otherwise(F.lit(0).cast("long"))
    return held.withColumn("kept", kept).drop("_at", "_first", "left")


def owned(held: DataFrame) -> DataFrame:
    """Words with the pixels of each shape that no later shape (by shape_id) has, those with any."""
    later = F.bit_or("bits").over(W.partitionBy(*CELL_KEYS, "y", "word").orderBy(F.desc("shape_id")).rowsBetween(W.unboundedPreceding, -1))
    left = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce(later, F.lit(0).cast("long"))))
    return held.withColumn("bits", left).where("bits <> 0")


def erosion_loss(shapes: DataFrame, slides: DataFrame, alias: DataFrame, p: TileParams) -> DataFrame:
    """Shapes of a class that own pixels of it before, but none after it is shrunk: image_id, shape_id, folder."""
    rows = cell_rows(label_of(shapes, alias, p), scale(slides, p), p)
    # Rows beside the cell only help to judge its own.
    own = owned(with_kept(words(shrunk_rows(rows))).where("y >= cy * cell AND y < (cy + 1) * cell")).where("folder IS NOT NULL")
    hit = F.col("bits").bitwiseAND(F.col("kept")) != 0
    return own.groupBy("image_id", "shape_id", "folder").agg(F.bool_or(hit).alias("hit")).where("NOT hit").drop("hit")

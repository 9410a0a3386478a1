"""Tile grids, coverage of tiles by annotation boxes and rings, label rules and sampling.

A tile's window is some 8 x 8 analysis pixels (4 to 12 a side, as scales round), wherever overlap and
scale put it. What a class covers of a window fits in three long masks of 4 rows x 12 pixels; larger
windows are cut into such blocks. Masks of one class are or-ed, which counts a pixel once however many
shapes cover it, and a tile never becomes its pixels. Shapes reach tiles by arithmetic on the slide's
scale, so no range join is made, and everything about a tile is gathered by one shuffle on its place.

A shape is a box (x, y, bw, bh) or, where it has a `ring` that is not null, the even-odd inside of that ring. A ring
becomes the spans of its rows, is dealt to panels with only the spans of their rows, and each span is then a box one pixel high.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .spans import span_lists

WINDOW = 8


@dataclass(frozen=True)
class TileParams:
    """How a slide is tiled; contradictory values are refused before any job runs."""

    mpp: float | None = 0.5
    downsample: float | None = None
    size: int = 32
    overlap: int = 0
    min_coverage: float = 0.5
    tissue_thresh: float = 0.5
    background: str | None = "benign"
    #: Distance that the background keeps from every shape: in analysis pixels, or in micrometres where margin_um is given.
    margin_px: int = 0
    margin_um: float | None = None
    exclusion: str = "exclusion roi"
    include_all: bool = False
    text_filter: tuple[str, ...] = field(default=())
    #: Micrometres by which a class is shrunk before a tile's centre may take it; None for half a tile, 0 for no such test.
    erode_um: float | None = 0.0

    def __post_init__(self) -> None:
        if (self.mpp is None) == (self.downsample is None):
            raise ValueError("give either mpp or downsample")
        if not 0 <= self.overlap < self.size:
            raise ValueError("overlap must be below the size")
        if not (0 <= self.min_coverage <= 1 and 0 <= self.tissue_thresh <= 1):
            raise ValueError("fractions lie between 0 and 1")


def scale(slides: DataFrame, p: TileParams) -> DataFrame:
    """Adds status, ds (level-0 pixels of an output pixel), tile0 and ads (analysis downsample)."""
    px = F.when(F.col("pixel_size") > 0, F.col("pixel_size"))
    ds = F.lit(p.downsample).cast("double") if p.downsample is not None else F.lit(p.mpp) / px
    status = F.when(ds.isNull(), "no_pixel_size").when(ds < 0.999, "upsampling").otherwise("ok")
    out = slides.withColumn("ds", ds).withColumn("status", status)
    return out.withColumn("tile0", F.rint(p.size * F.col("ds")).cast("long")).withColumn("ads", F.greatest(F.lit(1.0), F.rint(F.col("tile0") / WINDOW)).cast("long"))


def grid_ends(slides: DataFrame, p: TileParams) -> DataFrame:
    """Scaled slides that hold a tile, with their last row and column of tiles that fit in output pixels."""
    step = p.size - p.overlap
    s = scale(slides, p).where("status = 'ok'")
    s = s.withColumn("tw", F.expr("cast(width0 / ds AS long)")).withColumn("th", F.expr("cast(height0 / ds AS long)"))
    s = s.where((F.col("tw") >= p.size) & (F.col("th") >= p.size))
    return s.withColumn("last_row", F.floor((F.col("th") - p.size) / step).cast("int")).withColumn("last_col", F.floor((F.col("tw") - p.size) / step).cast("int"))


def placed(s: DataFrame, p: TileParams, *carry: str) -> DataFrame:
    """Places (col, row) of slides as the tiles that fit in level-0 pixels too; carry: further columns to keep."""
    step = p.size - p.overlap
    s = s.withColumn("xt", F.col("col") * step).withColumn("yt", F.col("row") * step)
    s = s.withColumn("x0", F.rint(F.col("xt") * F.col("ds")).cast("long")).withColumn("y0", F.rint(F.col("yt") * F.col("ds")).cast("long"))
    s = s.where("x0 + tile0 <= width0 AND y0 + tile0 <= height0")
    return s.select("image_id", "col", "row", "xt", "yt", "x0", "y0", F.col("tile0").alias("w0"), F.col("tile0").alias("h0"), "ds", "ads", *carry)


def grid(slides: DataFrame, p: TileParams, *carry: str) -> DataFrame:
    """One row for each tile that fits the slide in output and in level-0 pixels. Slides are few rows and are dealt first; carry: their columns to keep."""
    s = grid_ends(slides, p).repartition(shuffle_tasks(slides), "image_id")
    s = s.withColumn("row", F.explode(F.sequence(F.lit(0), "last_row")))
    return placed(s.withColumn("col", F.explode(F.sequence(F.lit(0), "last_col"))), p, *carry)


#: Tiles of a panel's side: a panel's tiles have a bit each in a long. What belongs to a tile is dealt by its panel.
PANEL = 8
PANEL_KEYS = ["image_id", "pcol", "prow"]
#: Shapes of a task, on average.
PER_TASK = 20_000


def shuffle_tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def tasks_of(shapes: DataFrame) -> int:
    """Tasks among which the panels of shapes and slides are dealt: their number grows with the shapes, so that a task does not."""
    return max(shuffle_tasks(shapes), shapes.count() // PER_TASK)


def panels(slides: DataFrame, p: TileParams, tasks: int) -> DataFrame:
    """Slides as their panels (pcol, prow), dealt among tasks."""
    s = grid_ends(slides, p)
    for n in ("row", "col"):
        s = s.withColumn(f"p{n}", F.explode(F.sequence(F.lit(0), F.expr(f"cast(last_{n} div {PANEL} AS int)"))))
    return s.repartition(tasks, *PANEL_KEYS)


def panel_tiles(s: DataFrame, p: TileParams, *carry: str) -> DataFrame:
    """The tiles of panels; carry: further columns to keep."""
    for n in ("row", "col"):
        s = s.withColumn(n, F.explode(F.sequence(F.col(f"p{n}") * PANEL, F.least(F.col(f"p{n}") * PANEL + PANEL - 1, F.col(f"last_{n}")))))
    return placed(s, p, *carry)


def tile_bit() -> Column:
    """A tile's number in its panel."""
    return (F.expr(f"(row - prow * {PANEL}) * {PANEL} + col - pcol * {PANEL}")).cast("int")


def marked(panels: DataFrame, places: DataFrame, name: str) -> DataFrame:
    """Panels with a long `name`, in which the bits of the tiles among places (dealt alike) are set."""
    held = places.groupBy(*PANEL_KEYS).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), tile_bit())).alias(name))
    return panels.join(held, PANEL_KEYS, "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))


def is_marked(name: str) -> Column:
    return F.call_function("shiftright", F.col(name), tile_bit()).bitwiseAND(F.lit(1).cast("long")) == 1


def select_level(levels: DataFrame, ds: Column, size: int) -> DataFrame:
    """The coarsest level reached while every level so far is at least as fine as ds, and its read size."""
    up_to = W.partitionBy("image_id").orderBy("idx").rowsBetween(W.unboundedPreceding, 0)
    own = F.col("width0") / F.col("width")
    usable = levels.withColumn("ds", ds).withColumn("own", own).withColumn("ok", F.bool_and(F.col("own") <= F.col("ds") + 1e-9).over(up_to))
    best = usable.where("ok").groupBy("image_id").agg(F.max(F.struct("idx", "own", "ds")).alias("b"))
    read = F.greatest(F.lit(1.0), F.rint(size * F.col("b.ds") / F.col("b.own"))).cast("long")
    return best.select("image_id", F.col("b.idx").alias("level"), F.col("b.own").alias("level_ds"), read.alias("read_size"))


def label_of(shapes: DataFrame, alias: DataFrame, p: TileParams) -> DataFrame:
    """Adds folder (the class a shape gives, null for none) and excluded. alias (alias, folder) is a small dimension."""
    key = F.lower(F.trim("text"))
    safe = F.coalesce(F.nullif(F.btrim(F.regexp_replace(F.trim("text"), "[^A-Za-z0-9._-]+", "_"), F.lit("._-")), F.lit("")), F.lit("unlabeled"))
    joined = shapes.join(F.broadcast(alias), key == F.col("alias"), "left")
    folder = F.col("folder")
    if p.include_all or p.text_filter:
        folder = F.coalesce(folder, F.when(F.length(key) > 0, safe))
    if p.text_filter and not p.include_all:
        wanted = [t.strip().lower() for t in p.text_filter]
        folder = F.when(F.lower(folder).isin(wanted) | key.isin(wanted), folder)
    excluded = F.coalesce(key == p.exclusion, F.lit(False))
    return joined.withColumn("excluded", excluded).withColumn("folder", F.when(~F.col("excluded"), folder)).drop("alias")


#: Pixels of a block's side; a mask holds PER_MASK of its rows.
BLOCK, PER_MASK = 12, 4
MASKS = ("m0", "m1", "m2")


def window_of(kind: str, p: TileParams) -> tuple[Column, Column]:
    """Shift of a window's origin against its tile's, in level-0 pixels, and the window's side in analysis pixels."""
    if kind == "tile":
        return F.lit(0.0), F.greatest(F.lit(1.0), F.rint(F.col("tile0") / F.col("ads"))).cast("long")
    r = erode_radius(p)
    return F.col("tile0") / 2 - r * F.col("ads"), F.greatest(F.lit(1.0), F.rint(2 * r)).cast("long")


def erode_radius(p: TileParams) -> Column:
    """Half-width of the centre box in analysis pixels: half a tile without a size in micrometres or without a pixel size."""
    half = F.col("tile0") / 2 / F.col("ads")
    if p.erode_um is None:
        return half
    return F.when(F.col("pixel_size") > 0, p.erode_um / (F.col("pixel_size") * F.col("ads"))).otherwise(half) if p.erode_um > 0 else F.lit(0.0)


def axis_ends(low: str, high: str, extent: str, step: int, reach: str) -> tuple[Column, Column]:
    """The first and the last window along an axis that may come within reach of [low, high]."""
    unit, ads, shift, side, near = F.col("ds") * step, F.col("ads"), F.col("shift"), F.col("side"), F.col(reach)
    first = F.greatest(F.lit(0.0), F.floor(((F.col(low) - near - side - 1) * ads - shift) / unit))
    last = F.least(F.floor(F.col(extent) / unit), F.ceil(((F.col(high) + near + 2) * ads - shift) / unit))
    return first.cast("int"), last.cast("int")


def window_at(number: Column, step: int) -> Column:
    """Origin of a window along an axis, in analysis pixels."""
    return F.rint((F.rint(number * F.col("ds") * step) + F.col("shift")) / F.col("ads")).cast("long")


def axis_panels(s: DataFrame, name: str, low: str, high: str, extent: str, step: int, reach: str) -> DataFrame:
    """One row for each panel along an axis with such windows."""
    first, last = axis_ends(low, high, extent, step, reach)
    return s.where(first <= last).withColumn(f"p{name}", F.explode(F.sequence((first / PANEL).cast("int"), (last / PANEL).cast("int"))))


def axis(s: DataFrame, name: str, low: str, high: str, extent: str, step: int, reach: str) -> DataFrame:
    """One row for each window of the row's panel along an axis that comes within reach of [low, high], with its origin `name`_at."""
    side, near = F.col("side"), F.col(reach)
    first, last = axis_ends(low, high, extent, step, reach)
    first, last = F.greatest(first, F.col(f"p{name}") * PANEL), F.least(last, F.col(f"p{name}") * PANEL + PANEL - 1)
    s = s.where(first <= last).withColumn(name, F.explode(F.sequence(first, last)))
    s = s.withColumn(f"{name}_at", window_at(F.col(name), step))
    return s.where((F.col(f"{name}_at") - near <= F.col(high)) & (F.col(f"{name}_at") + side + near > F.col(low)))


def on_slide(shapes: DataFrame, scaled: DataFrame, p: TileParams, kind: str = "tile", margin: Column | None = None) -> DataFrame:
    """Shapes with their slide's scale, its size in analysis pixels (tw, th), and what kind of window is asked for.

    Of kind "both" a shape that gives a class stands for the windows of tiles and for those of their centres, where centres are tested.
    """
    s = shapes.join(scaled.where("status = 'ok'").select("image_id", "ds", "ads", "tile0", "width0", "height0", "pixel_size"), "image_id")
    for n, size in (("tw", "width0"), ("th", "height0")):
        s = s.withColumn(n, F.greatest(F.lit(1.0), F.rint(F.col(size) / F.col("ads"))).cast("long"))
    shift, side = window_of("tile", p)
    if kind == "both":
        s = s.withColumn("tested", erode_radius(p) >= 1)
        s = s.withColumn("kind", F.explode(F.when(F.col("tested") & F.col("folder").isNotNull(), F.array(F.lit("tile"), F.lit("centre"))).otherwise(F.array(F.lit("tile")))))
        shift, side = (F.when(F.col("kind") == "tile", a).otherwise(b) for a, b in zip(window_of("tile", p), window_of("centre", p), strict=True))
    return s.withColumn("side", side).withColumn("shift", shift).withColumn("margin", F.lit(0) if margin is None else margin)


def margin_of(p: TileParams) -> Column:
    """Margin in analysis pixels; one in micrometres counts only where the pixel size is known."""
    if p.margin_um is None:
        return F.lit(p.margin_px)
    return F.when(F.col("pixel_size") > 0, F.ceil(p.margin_um / (F.col("pixel_size") * F.col("ads")))).otherwise(0).cast("int")


def with_area(s: DataFrame) -> DataFrame:
    """Adds the window's area as far as it lies on the slide."""
    wide, high = (F.least(F.col(f"{n}_at") + F.col("side"), F.col(e)) - F.greatest(F.col(f"{n}_at"), F.lit(0)) for n, e in (("col", "tw"), ("row", "th")))
    return s.withColumn("area", F.greatest(F.lit(1), wide * high))


def box_pixels(s: DataFrame) -> DataFrame:
    """Boxes with their first and last analysis pixels (ax, ex, ay, ey); those without one are left out."""
    s = s.withColumn("ax", F.expr("greatest(0, x div ads)")).withColumn("ex", F.expr("least(tw, x div ads + bw div ads) - 1"))
    s = s.withColumn("ay", F.expr("greatest(0, y div ads)")).withColumn("ey", F.expr("least(th, y div ads + bh div ads) - 1"))
    return s.where("ax <= ex AND ay <= ey")


def cut_boxes(shapes: DataFrame, scaled: DataFrame, p: TileParams, kind: str = "tile", margin: Column | None = None, tasks: int | None = None) -> DataFrame:
    """Boxes and the windows within margin of them: adds col, row, ax, ex, ay, ey (in analysis pixels), col_at, row_at, side, and area (clipped to the slide).

    Boxes are dealt by the panels (pcol, prow) of tiles that they reach, before they become windows.
    """
    s = box_pixels(on_slide(shapes, scaled, p, kind, margin))
    step = p.size - p.overlap
    ends = (("col", "ax", "ex", "width0", step, "margin"), ("row", "ay", "ey", "height0", step, "margin"))
    s = axis_panels(axis_panels(s, *ends[0]), *ends[1]).repartition(tasks or tasks_of(shapes), *PANEL_KEYS)
    return with_area(axis(axis(s, *ends[0]), *ends[1]))


def with_spans(s: DataFrame) -> DataFrame:
    """Rings as the spans (y, x_from, x_to) of their analysis pixels, clipped to the slide, in order of y; those without one are left out."""
    fields = [f for f in s.schema.fields if f.name != "ring"]
    schema = StructType([*fields, *StructType.fromDDL("spans array<struct<y:bigint,x_from:bigint,x_to:bigint>>").fields])
    wanted = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ring = batch.column("ring")
            points, size = ring.flatten(), pc.fill_null(pc.list_value_length(ring), 0).to_numpy(zero_copy_only=False)
            ads, tw, th = (batch.column(c).to_numpy() for c in ("ads", "tw", "th"))
            x, y = (points.field(n).to_numpy(zero_copy_only=False) / np.repeat(ads, size) for n in ("x", "y"))
            for i, j, spans in span_lists(x, y, size, tw, th):
                part = batch.slice(i, j - i)
                out = pa.RecordBatch.from_arrays([spans if n == "spans" else part.column(n) for n in wanted.names], schema=wanted)
                yield out.filter(pc.greater(pc.list_value_length(spans), 0))

    return s.mapInArrow(run, schema)


def between(s: DataFrame, low: Column, high: Column) -> DataFrame:
    """Rings with those of their spans that lie in rows low to high - 1, and the ends ax, ex of these along a row."""
    s = s.withColumn("spans", F.explode(F.array(F.filter("spans", lambda q: (q["y"] >= low) & (q["y"] < high))))).where(F.size("spans") > 0)
    return s.withColumn("ax", F.array_min(F.transform("spans", lambda q: q["x_from"]))).withColumn("ex", F.array_max(F.transform("spans", lambda q: q["x_to"])) - 1)


def cut_rings(shapes: DataFrame, scaled: DataFrame, p: TileParams, kind: str = "tile", margin: Column | None = None, tasks: int | None = None) -> DataFrame:
    """Rings as boxes one pixel high, and the windows within margin of these: the columns of cut_boxes.

    Rings are dealt by panels like boxes, with the spans of a panel's rows; there each span becomes such a box.
    """
    s = with_spans(on_slide(shapes, scaled, p, kind, margin))
    s = s.withColumn("ay", F.element_at("spans", 1)["y"]).withColumn("ey", F.element_at("spans", -1)["y"])
    step, near = p.size - p.overlap, F.col("margin")
    rows, cols = ("row", "ay", "ey", "height0", step, "margin"), ("col", "ax", "ex", "width0", step, "margin")
    s = axis_panels(s, *rows)
    s = between(s, window_at(F.col("prow") * PANEL, step) - near, window_at(F.col("prow") * PANEL + PANEL - 1, step) + F.col("side") + near)
    s = axis_panels(s, *cols).repartition(tasks or tasks_of(shapes), *PANEL_KEYS)
    s = s.withColumn("q", F.explode("spans")).withColumns({"ax": F.col("q.x_from"), "ex": F.col("q.x_to") - 1, "ay": F.col("q.y"), "ey": F.col("q.y")}).drop("q", "spans")
    return with_area(axis(axis(s, *cols), *rows))


def bits(a: Column, b: Column) -> Column:
    """A long whose bits a to b - 1 are set, for bounds up to 62."""
    power = lambda n: F.call_function("shiftleft", F.lit(1).cast("long"), n.cast("int"))
    return power(b) - power(a)


def masks_of(s: DataFrame) -> DataFrame:
    """Boxes with the windows that they meet, cut into blocks: adds block and the masks of the block's pixels."""
    s = s.withColumn("cx", F.expr("greatest(0, ax - col_at)")).withColumn("dx", F.expr("least(side - 1, ex - col_at)"))
    s = s.withColumn("cy", F.expr("greatest(0, ay - row_at)")).withColumn("dy", F.expr("least(side - 1, ey - row_at)"))
    for n, a, b in (("bx", "cx", "dx"), ("by", "cy", "dy")):
        s = s.withColumn(n, F.explode(F.expr(f"sequence(cast({a} div {BLOCK} AS int), cast({b} div {BLOCK} AS int))")))
        s = s.withColumn(a, F.greatest(F.lit(0), F.col(a) - F.col(n) * BLOCK)).withColumn(b, F.least(F.lit(BLOCK - 1), F.col(b) - F.col(n) * BLOCK))
    line = (F.pow(F.lit(2.0), F.col("dx") + 1) - F.pow(F.lit(2.0), F.col("cx"))).cast("long")

    def mask(first: int) -> Column:
        a, b = F.greatest(F.col("cy") - first, F.lit(0)), F.least(F.col("dy") - first, F.lit(PER_MASK - 1))
        rows = (F.pow(F.lit(2.0**BLOCK), b + 1) - F.pow(F.lit(2.0**BLOCK), a)).cast("long")
        return F.when(a <= b, line * F.floor(rows / (2**BLOCK - 1))).otherwise(F.lit(0)).cast("long")

    for k, n in enumerate(MASKS):
        s = s.withColumn(n, mask(k * PER_MASK))
    return s.withColumn("block", F.col("by") * 1024 + F.col("bx"))


def ring_masks(shapes: DataFrame, scaled: DataFrame, p: TileParams, kind: str = "tile", tasks: int | None = None) -> DataFrame:
    """Each ring cut into the windows it meets: adds col, row, block and the masks of the block's pixels, in several rows for a block."""
    return masks_of(cut_rings(shapes, scaled, p, kind, tasks=tasks))


def box_masks(shapes: DataFrame, scaled: DataFrame, p: TileParams, kind: str = "tile", tasks: int | None = None) -> DataFrame:
    """Each box cut into the windows it meets: adds col, row, block and the masks of the block's pixels."""
    return masks_of(cut_boxes(shapes, scaled, p, kind, tasks=tasks))


def both_kinds(shapes: DataFrame, boxes: Callable[[DataFrame], DataFrame], rings: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What `boxes` makes of the boxes among shapes together with what `rings` makes of the rings."""
    if "ring" not in shapes.columns:
        return boxes(shapes)
    return boxes(shapes.where("ring IS NULL").drop("ring")).unionByName(rings(shapes.where("ring IS NOT NULL")))


def shape_masks(shapes: DataFrame, scaled: DataFrame, p: TileParams, kind: str = "tile", tasks: int | None = None) -> DataFrame:
    """Each shape cut into the windows it meets: its columns but the geometry, with the window's place, block, masks and area."""
    tasks = tasks or tasks_of(shapes)
    keep = [c for c in shapes.columns if c not in ("ring", "x", "y", "bw", "bh")] + ["col", "row", "pcol", "prow", "block", *MASKS, "area"] + (["kind", "tested"] if kind == "both" else [])
    return both_kinds(shapes, lambda s: box_masks(s, scaled, p, kind, tasks).select(*keep), lambda s: ring_masks(s, scaled, p, kind, tasks).select(*keep))


def set_bits(of: dict[str, Column]) -> Column:
    return F.bit_count(of["m0"]) + F.bit_count(of["m1"]) + F.bit_count(of["m2"])


AT = ["image_id", "col", "row"]
#: A tile with its panel, by which it is dealt.
PLACE = [*AT, "pcol", "prow"]


def covered(masks: DataFrame, *keys: str) -> DataFrame:
    """Set pixels of the or-ed masks for each tile and key, and the window's area. Masks are dealt by panels, so tiles are gathered where they are."""
    blocks = masks.groupBy(*PLACE, *keys, "block").agg(*[F.bit_or(m).alias(m) for m in MASKS], F.max("area").alias("area"))
    return blocks.groupBy(*PLACE, *keys).agg(F.sum(set_bits({m: F.col(m) for m in MASKS})).cast("int").alias("px"), F.max("area").alias("area"))


def near_tiles(shapes: DataFrame, scaled: DataFrame, p: TileParams, tasks: int | None = None) -> DataFrame:
    """Tiles (with their panels) whose window has a pixel within the margin (a disk) of some shape, excluded ones included."""
    reach, tasks = margin_of(p), tasks or tasks_of(shapes)
    gap = lambda at, low, high: F.greatest(F.lit(0), low - (F.col(at) + F.col("side") - 1), F.col(at) - high)

    def close(low_x: Column, high_x: Column, low_y: Column, high_y: Column) -> Column:
        dx, dy = gap("col_at", low_x, high_x), gap("row_at", low_y, high_y)
        return dx * dx + dy * dy <= F.col("margin") * F.col("margin")

    def reached(cut: Callable[..., DataFrame]) -> Callable[[DataFrame], DataFrame]:
        return lambda s: cut(s, scaled, p, margin=reach, tasks=tasks).where(close(*[F.col(c) for c in ("ax", "ex", "ay", "ey")])).select(*PLACE)

    return both_kinds(shapes, reached(cut_boxes), reached(cut_rings))


FACT = "struct<place:int,folder:string,n:double,at_edge:boolean,excl:boolean,near:boolean,met:bigint>"


def tile_facts(shapes: DataFrame, scaled: DataFrame, alias: DataFrame, p: TileParams, tasks: int) -> DataFrame:
    """What shapes say of the tiles that they come near: PLACE, the best class (folder, n: its share, negative), at_edge, excl, near, met."""
    tested = p.erode_um is None or p.erode_um > 0
    extra = ["kind", "tested"] if tested else []
    named = label_of(shapes, alias, p)
    masks = shape_masks(named, scaled, p, "both" if tested else "tile", tasks).select(*PLACE, "folder", "excluded", "block", *MASKS, "area", *extra)
    by_class, central = covered(masks, "folder", "excluded", *extra), F.lit(True)
    if tested:
        own = F.col("kind") == "tile"
        by_class = by_class.groupBy(*PLACE, "folder", "excluded", "tested").agg(
            F.max(F.when(own, F.col("px"))).alias("px"), F.max(F.when(own, F.col("area"))).alias("area"), F.bool_or(~own & (F.col("px") == F.col("area"))).alias("central")
        ).where("px IS NOT NULL")
        central = F.col("central") | ~F.coalesce("tested", F.lit(False))
    enough = F.col("folder").isNotNull() & (F.col("px") >= p.min_coverage * F.col("area")) & (F.col("px") > 0)
    facts = by_class.groupBy(*PLACE).agg(
        F.min(F.when(enough & central, F.struct((-F.col("px") / F.col("area")).alias("n"), "folder"))).alias("best"),
        F.bool_or(enough & ~central).alias("at_edge"),
        F.bool_or(F.col("excluded") & (F.col("px") > 0)).alias("excl"),
        F.lit(True).alias("near"),
        F.count_if(F.col("folder").isNotNull()).alias("met"),
    )
    if p.margin_px or p.margin_um is not None:
        near = near_tiles(shapes, scaled, p, tasks).select(*PLACE, F.lit(None).cast("struct<n:double,folder:string>").alias("best"), F.lit(None).cast("boolean").alias("at_edge"), F.lit(None).cast("boolean").alias("excl"), F.lit(True).alias("near"), F.lit(0).cast("long").alias("met"))
        facts = facts.unionByName(near).groupBy(*PLACE).agg(*[F.max(c).alias(c) for c in ("best", "at_edge", "excl", "near", "met")])
    return facts.select(*PLACE, "best.folder", "best.n", "at_edge", "excl", "near", "met")


def slide_facts(slides: DataFrame, shapes: DataFrame, scaled: DataFrame, alias: DataFrame, p: TileParams) -> DataFrame:
    """Adds to slides has_shapes, and classes where their number matters."""
    t = slides.join(shapes.select("image_id").distinct().withColumn("has_shapes", F.lit(True)), "image_id", "left")
    if p.min_coverage == 0 and (p.erode_um is None or p.erode_um > 0):
        # A class that does not touch the tile has enough coverage too, and its centre test fails.
        named = shape_masks(label_of(shapes, alias, p), scaled, p).where("folder IS NOT NULL")
        classes = named.select("image_id", "folder").distinct().groupBy("image_id").agg(F.count(F.lit(1)).alias("classes"))
        return t.join(classes.join(scaled.where(erode_radius(p) >= 1).select("image_id"), "image_id", "left_semi"), "image_id", "left")
    return t.withColumn("classes", F.lit(0).cast("long"))


def with_outcome(t: DataFrame, p: TileParams, *carry: str) -> DataFrame:
    """The first rule that applies to each tile with its facts and tissue_px."""
    outcome = (
        F.when(F.col("has_shapes").isNull(), "unannotated")
        .when(F.coalesce("tissue_px", F.lit(0)) < p.tissue_thresh * 64, "dropped_no_tissue")
        .when(F.coalesce("excl", F.lit(False)), "dropped_excluded")
        .when(F.col("folder").isNotNull(), F.col("folder"))
        .when(F.coalesce("at_edge", F.lit(False)) | (F.coalesce("met", F.lit(0)) < F.coalesce("classes", F.lit(0))), "dropped_roi_edge")
    )
    if p.background:
        outcome = outcome.when(F.col("near").isNull(), p.background)
    t = t.withColumn("outcome", outcome.otherwise("dropped_unlabeled"))
    share = F.when(F.col("outcome") == F.col("folder"), -F.col("n")).otherwise(F.lit(0.0))
    return t.select(*AT, "x0", "y0", "w0", "h0", "outcome", F.coalesce(share, F.lit(0.0)).alias("coverage"), (F.coalesce("tissue_px", F.lit(0)) / 64).alias("tissue_frac"), *carry)


def label_tiles(tiles: DataFrame, shapes: DataFrame, slides: DataFrame, tissue: DataFrame | None, alias: DataFrame, p: TileParams) -> DataFrame:
    """Outcome of the given tiles, the first rule that applies; label and coverage where it is kept. `label_slides` labels whole grids without moving tiles.

    tissue: (image_id, col, row, tissue_px of 64); None where tiles have that column.
    """
    scaled = scale(slides, p)
    facts = tile_facts(shapes, scaled, alias, p, tasks_of(shapes)).drop("pcol", "prow")
    t = tiles if tissue is None else tiles.join(tissue, AT, "left")
    t = t.join(facts, AT, "left").join(slide_facts(slides.select("image_id"), shapes, scaled, alias, p), "image_id")
    return with_outcome(t, p)


def label_slides(slides: DataFrame, shapes: DataFrame, alias: DataFrame, p: TileParams, tissue_px: Column, *carry: str) -> DataFrame:
    """Outcome of every tile of the slides' grids. tissue_px reads columns of slides, col and row; carry: columns of slides to keep.

    Shapes and slides are dealt by panels of tiles; the tiles that shapes come near, PANEL x PANEL at most, meet their panel, which then gives all its tiles.
    """
    scaled, tasks = scale(slides, p), tasks_of(shapes)
    facts = tile_facts(shapes, scaled, alias, p, tasks)
    held = facts.groupBy(*PANEL_KEYS).agg(F.collect_list(F.struct(tile_bit().alias("place"), "folder", "n", "at_edge", "excl", "near", "met").cast(FACT)).alias("held"))
    s = panels(slide_facts(slides, shapes, scaled, alias, p), p, tasks).join(held, PANEL_KEYS, "left")
    one, no_facts = F.lit(1).cast("long"), [F.lit(None)] * 6
    s = s.withColumn("held", F.coalesce("held", F.array().cast(f"array<{FACT}>")))
    s = s.withColumn("taken", F.aggregate("held", F.lit(0).cast("long"), lambda m, h: m.bitwiseOR(F.call_function("shiftleft", one, h["place"]))))
    across, down = F.col("last_col") - F.col("pcol") * PANEL, F.col("last_row") - F.col("prow") * PANEL
    free = lambda i: (F.call_function("shiftright", F.col("taken"), i).bitwiseAND(one) == 0) & (i % PANEL <= across) & (i / PANEL < down + 1)
    bare = F.transform(F.filter(F.sequence(F.lit(0), F.lit(PANEL * PANEL - 1)), free), lambda i: F.struct(i, *no_facts).cast(FACT))
    s = s.withColumn("f", F.explode(F.concat("held", bare))).drop("held", "taken")
    s = s.select("*", "f.*").withColumn("row", F.expr(f"prow * {PANEL} + cast(place div {PANEL} AS int)")).withColumn("col", F.expr(f"pcol * {PANEL} + place % {PANEL}"))
    t = placed(s.where("row <= last_row AND col <= last_col"), p, "folder", "n", "at_edge", "excl", "near", "met", "has_shapes", "classes", *[c for c in slides.columns if c != "image_id"])
    return with_outcome(t.withColumn("tissue_px", tissue_px), p, *carry)


def dominant_shape(shapes: DataFrame, slides: DataFrame, p: TileParams) -> DataFrame:
    """The most frequent shape of a tile's pixels (the later shape owns a shared pixel; ties to the smaller id).

    A block's shapes are few; they are folded from the latest on, each with the pixels that no later one has.
    """
    m = shape_masks(shapes, scale(slides, p), p).groupBy(*PLACE, "block", "shape_id").agg(*[F.bit_or(k).alias(k) for k in MASKS])
    of = m.groupBy(*PLACE, "block").agg(F.sort_array(F.collect_list(F.struct("shape_id", *MASKS)), asc=False).alias("held"))
    none = F.struct(*[F.lit(0).cast("long").alias(x) for x in MASKS], F.array().cast("array<struct<shape_id:bigint,n:int>>").alias("own"))

    def fold(state: Column, x: Column) -> Column:
        free = {k: x[k].bitwiseAND(F.bitwise_not(state[k])) for k in MASKS}
        own = F.struct(x["shape_id"].cast("long").alias("shape_id"), set_bits(free).cast("int").alias("n"))
        return F.struct(*[state[k].bitwiseOR(x[k]).alias(k) for k in MASKS], F.concat(state["own"], F.array(own)).alias("own"))

    each = of.select(*PLACE, F.explode(F.aggregate("held", none, fold)["own"]).alias("o")).select(*PLACE, "o.*").where("n > 0")
    counts = each.groupBy(*PLACE, "shape_id").agg(F.sum("n").alias("n"))
    return counts.groupBy(*PLACE).agg(F.min(F.struct(-F.col("n"), "shape_id"))["shape_id"].alias("shape_id")).select(*AT, "shape_id")


def draw_key(seed: int, *columns: str) -> Column:
    """A sampling order that any engine can repeat."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]).cast("binary"))


def cap_flags(tiles: DataFrame, able: str, per_label: int | None, background: str, background_cap: int | None, per_slide: int | None, seed: int) -> DataFrame:
    """Adds kept: whether a tile that is able survives the seeded caps for each label, then for each slide.

    No cap where one is None; the background's is then that of a label.
    """
    key = draw_key(seed, "image_id", "col", "row")
    t = tiles.withColumn("able", F.expr(able))
    place = F.row_number().over(W.partitionBy("image_id", "outcome", "able").orderBy(key))
    cap = F.lit(per_label) if background_cap is None else F.when(F.col("outcome") == background, background_cap).otherwise(F.lit(per_label))
    t = t.withColumn("kept", F.col("able") & F.coalesce(place <= cap, F.lit(True)))
    again = F.row_number().over(W.partitionBy("image_id", "kept").orderBy(key))
    return t.withColumn("kept", F.col("kept") & F.coalesce(again <= F.lit(per_slide), F.lit(True))).drop("able")


def cap_labels(kept: DataFrame, per_label: int | None, background: str, background_cap: int | None, per_slide: int | None, seed: int) -> DataFrame:
    """The rows that survive the seeded caps. The larger cap stands alone first, so that Spark can leave rows out before it moves any."""
    most = None if per_label is None else max(per_label, background_cap or 0)
    if most is not None:
        place = F.row_number().over(W.partitionBy("image_id", "outcome").orderBy(draw_key(seed, "image_id", "col", "row")))
        kept = kept.withColumn("_place", place).where(F.col("_place") <= most).drop("_place")
    return cap_flags(kept, "true", per_label, background, background_cap, per_slide, seed).where("kept").drop("kept")


@cache
def state_of(seed: int) -> tuple:
    return random.Random(seed).getstate()


@lru_cache(100_000)
def draws(seed: int, sizes: tuple[tuple[int, int | None], ...], most: int | None) -> tuple[np.ndarray, np.ndarray | None]:
    """Places that a generator draws from groups of (size, cap) one after the other, counted through all groups, and which of the survivors it draws then if there are more than `most`."""
    rng = random.Random()
    rng.setstate(state_of(seed))
    taken, before = [np.empty(0, np.int64)], 0
    for n, cap in sizes:
        taken.append(before + np.array(rng.sample(range(n), cap) if cap is not None and n > cap else range(n), np.int64))
        before += n
    out = np.concatenate(taken)
    return out, np.array(rng.sample(range(len(out)), most), np.int64) if most is not None and len(out) > most else None


def cap_labels_exact(kept: DataFrame, per_label: int | None, background: str, background_cap: int | None, per_slide: int | None, seed: int) -> DataFrame:
    """The same caps with one Python generator a slide: labels in name order, survivors in row-major order. No cap where one is None; the background's is then that of a label.

    The generator's order makes a slide one group. What goes there are a bit for each tile: panels of PANEL x PANEL tiles of a label as
    longs. A place counts once for each label. What is drawn depends on the labels' counts alone, and slides are worked on together.
    """
    keys = kept.select("image_id", "col", "row", "outcome")
    at = {f"p{n}": F.floor(F.col(n) / PANEL).cast("int") for n in ("row", "col")}
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.expr(f"cast((row - prow * {PANEL}) * {PANEL} + col - pcol * {PANEL} AS int)"))
    held = keys.withColumns(at).groupBy("image_id", "outcome", "prow", "pcol").agg(F.bit_or(bit).alias("tiles"))
    slides = held.groupBy("image_id").agg(F.collect_list(F.struct("outcome", "prow", "pcol", "tiles")).alias("held"))
    fields = to_arrow_schema(keys.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("held")
            flat = lists.flatten()
            outcome, prow, pcol, tiles = (flat.field(n) for n in ("outcome", "prow", "pcol", "tiles"))
            code = pc.dictionary_encode(outcome)
            names = code.dictionary.to_pylist()
            by_name = sorted(range(len(names)), key=lambda i: names[i])
            place = np.empty(len(names), np.int64)
            place[by_name] = np.arange(len(names))
            label = place[code.indices.to_numpy(zero_copy_only=False)]
            cap = [background_cap if names[i] == background and background_cap is not None else per_label for i in by_name]
            # One entry for each tile, in order of slide, label and place.
            entry, tile = np.nonzero(np.unpackbits(tiles.to_numpy().view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            slide = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())[entry]
            row, col, label = prow.to_numpy()[entry] * PANEL + tile // PANEL, pcol.to_numpy()[entry] * PANEL + tile % PANEL, label[entry]
            order = np.lexsort((col, row, label, slide))
            slide, label, row, col = slide[order], label[order], row[order], col[order]
            starts = np.flatnonzero(np.concatenate([[True], (slide[1:] != slide[:-1]) | (label[1:] != label[:-1])]))
            sizes = np.diff(np.append(starts, len(slide))).tolist()
            of, which = slide[starts], label[starts].tolist()
            first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])).tolist()
            taken = [np.empty(0, np.int64)]
            for a, b in zip(first, [*first[1:], len(of)], strict=True):
                own, later = draws(seed, tuple((sizes[i], cap[which[i]]) for i in range(a, b)), per_slide)
                own = starts[a] + own
                taken.append(own if later is None else own[np.lexsort((col[own], row[own]))][later])
            got = np.concatenate(taken)
            out = {"image_id": batch.column("image_id").take(pa.array(slide[got])), "col": pa.array(col[got]), "row": pa.array(row[got]), "outcome": pa.array(names, fields.field("outcome").type).take(pa.array(np.array(by_name, np.int64)[label[got]]))}
            yield pa.RecordBatch.from_arrays([out[f.name].cast(f.type) for f in fields], schema=fields)

    drawn = slides.mapInArrow(run, keys.schema)
    return drawn if kept.columns == keys.columns else kept.join(drawn, ["image_id", "col", "row", "outcome"], "left_semi")

"""Rasters as a store of blocks, of which regions and whole smaller images are made.

A block is one row: its raster's key, its place (`by`, `bx`), its size, its bands, and its bytes by rows (each
pixel's bands side by side) or planar (one plane a band). A store may be of any size: a region meets its blocks
by equality of their places, and only the slices that it needs travel on. Blocks that a store lacks read as 0.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalog import reduced, region_origin

BLOCK = "{key} long, by int, bx int, h int, w int, bands int, planar boolean, data binary"


def to_blocks(px: DataFrame, extents: DataFrame, key: str, side: int, bands: list[str], planar: bool = False) -> DataFrame:
    """Pixels (key, y, x and a column of 0 to 255 a band) as blocks; extents: (key, height, width), one row a raster.

    Pixels outside their raster and rasters without extents are left out; a pixel that is missing is 0, a null band too.
    Of a pixel given twice the greatest value of each band stays.
    """
    held = px.join(extents.select(key, "height", "width"), key).where("y >= 0 AND x >= 0 AND y < height AND x < width")
    at = held.withColumn("by", F.expr(f"cast(y div {side} AS int)")).withColumn("bx", F.expr(f"cast(x div {side} AS int)"))
    at = at.repartition(key, "by", "bx").groupBy(key, "by", "bx", "height", "width", "y", "x").agg(*[F.coalesce(F.max(b), F.lit(0)).alias(f"_b{n}") for n, b in enumerate(bands)])

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        by, bx = int(first["by"]), int(first["bx"])
        h, w = min(side, int(first["height"]) - by * side), min(side, int(first["width"]) - bx * side)
        block = np.zeros((h, w, len(bands)), np.uint8)
        block[pdf["y"].to_numpy() - by * side, pdf["x"].to_numpy() - bx * side] = pdf[[f"_b{n}" for n in range(len(bands))]].to_numpy()
        data = (block.transpose(2, 0, 1) if planar else block).tobytes()
        return pd.DataFrame({key: [first[key]], "by": [by], "bx": [bx], "h": [h], "w": [w], "bands": [len(bands)], "planar": [planar], "data": [data]})

    return at.groupBy(key, "by", "bx").applyInPandas(pack, BLOCK.format(key=key))


def joined(parts: Column) -> Column:
    """An array of byte strings as one."""
    return F.unhex(F.array_join(F.transform(parts, F.hex), ""))


def interleaved(store: DataFrame) -> DataFrame:
    """The store with the bands of each pixel side by side."""
    plane = F.col("h") * F.col("w")
    pixel = lambda i: F.transform(F.sequence(F.lit(0), F.col("bands") - 1), lambda c: F.substring("data", c * plane + i + 1, F.lit(1)))
    turned = joined(F.flatten(F.transform(F.sequence(F.lit(0), plane - 1), pixel)))
    return store.withColumn("data", F.when(F.col("planar") & (F.col("bands") > 1), turned).otherwise(F.col("data"))).withColumn("planar", F.lit(False))


def is_rgb(bands: Column) -> Column:
    return F.coalesce(bands == 3, F.lit(False))


def clamped(windows: DataFrame, extents: DataFrame, key: str, size: int, downsample: Column) -> DataFrame:
    """Windows (x, y in full pixels) as places in their raster: rounded, moved inside, cut where the raster is smaller than size."""
    at = windows.join(extents.select(key, "height", "width"), key)
    for v, extent in (("x", "width"), ("y", "height")):
        at = at.withColumn(v, region_origin(F.col(v), downsample, F.col(extent), F.lit(size)))
    return at.withColumn("w", F.least(F.lit(size), F.col("width") - F.col("x"))).withColumn("h", F.least(F.lit(size), F.col("height") - F.col("y")))


def regions(windows: DataFrame, store: DataFrame, key: str, window: str, side: int, bands: int) -> DataFrame:
    """The bytes of each window (a unique name, key, and x, y, w, h inside its raster), its pixels' bands side by side.

    Two shuffles: slices of blocks to rows of windows, and these together. A window without area is left out.
    """
    w = windows.where("w > 0 AND h > 0").select(window, key, *[F.col(c).cast("int").alias(f"_{c}") for c in "xywh"])
    w = w.withColumn("by", F.explode(F.expr(f"sequence(_y div {side}, (_y + _h - 1) div {side})").cast("array<int>")))
    w = w.withColumn("bx", F.explode(F.expr(f"sequence(_x div {side}, (_x + _w - 1) div {side})").cast("array<int>")))
    met = w.join(interleaved(store).select(key, "by", "bx", F.col("w").alias("bw"), "data"), [key, "by", "bx"], "left")
    met = met.selectExpr("*", f"greatest(_x, bx * {side}) AS xa", f"least(_x + _w, (bx + 1) * {side}) AS xe", f"greatest(_y, by * {side}) AS ya", f"least(_y + _h, (by + 1) * {side}) AS ye")
    length = (F.col("xe") - F.col("xa")) * bands
    blank = F.unhex(F.repeat(F.lit("00"), length))
    cut = lambda y: F.substring("data", ((y - F.col("by") * side) * F.col("bw") + F.col("xa") - F.col("bx") * side) * bands + 1, length)
    rows = F.transform(F.sequence("ya", F.col("ye") - 1), lambda y: F.struct(y.alias("y"), F.col("bx").alias("bx"), F.when(F.col("data").isNotNull(), cut(y)).otherwise(blank).alias("part")))
    slices = met.select(window, key, *[f"_{c}" for c in "xywh"], rows.alias("rows"))
    held = slices.groupBy(window, key, "_x", "_y", "_w", "_h").agg(F.array_sort(F.flatten(F.collect_list("rows"))).alias("rows"))
    names = [F.col(f"_{c}").alias(c) for c in "xywh"]
    return held.select(window, key, *names, F.lit(bands).alias("bands"), joined(F.transform("rows", lambda r: r["part"])).alias("data"))


def box_sums(block: np.ndarray, y0: int, x0: int, height: int, width: int, out_h: int, out_w: int) -> tuple[int, int, np.ndarray]:
    """What a block at (y0, x0) of a raster adds to the boxes of a smaller (or larger) one: the first box's place, and sums.

    The box of output row i is the source rows from floor(i * height / out_h) to below ceil((i + 1) * height / out_h).
    """

    def ends(at: int, n: int, full: int, out: int) -> tuple[int, np.ndarray, np.ndarray]:
        first, last = at * out // full, min(out - 1, ((at + n) * out - 1) // full)
        i = np.arange(first, last + 1, dtype=np.int64)
        return first, np.maximum(i * full // out - at, 0), np.minimum(-(-(i + 1) * full // out) - at, n)

    oy, ya, ye = ends(y0, block.shape[0], height, out_h)
    ox, xa, xe = ends(x0, block.shape[1], width, out_w)
    s = np.zeros((block.shape[0] + 1, block.shape[1] + 1, block.shape[2]), np.int64)
    s[1:, 1:] = block.astype(np.int64).cumsum(0).cumsum(1)
    rows = s[ye] - s[ya]
    return oy, ox, rows[:, xe] - rows[:, xa]


def box_counts(full: int, out: int) -> np.ndarray:
    i = np.arange(out, dtype=np.int64)
    return -(-(i + 1) * full // out) - i * full // out


def means(sums: np.ndarray, ny: np.ndarray, nx: np.ndarray) -> bytes:
    """Means of boxes, a half upwards."""
    n = (ny[:, None] * nx[None, :])[:, :, None]
    return ((2 * sums + n) // (2 * n)).astype(np.uint8).tobytes()


def resized(read: DataFrame, key: str, window: str, size: int) -> DataFrame:
    """Regions as squares of a given size by means of boxes; a region of that size stays as it is. One region is held at a time."""

    def resize(pdf: pd.DataFrame) -> pd.DataFrame:
        def one(r: dict) -> bytes:
            block = np.frombuffer(r["data"], np.uint8).reshape(r["h"], r["w"], r["bands"])
            sums = box_sums(block, 0, 0, r["h"], r["w"], size, size)[2]
            return means(sums, box_counts(r["h"], size), box_counts(r["w"], size))

        return pd.DataFrame({window: pdf[window], key: pdf[key], "bands": pdf["bands"], "data": [one(r) for r in pdf.to_dict("records")]})

    return read.groupBy(window).applyInPandas(resize, f"{window} long, {key} long, bands int, data binary")


def whole_at(store: DataFrame, extents: DataFrame, key: str, side: int, factor: float, bands: int) -> DataFrame:
    """Each raster at 1 / factor, again as blocks of the same side.

    A block sends its boxes' sums to the blocks that hold them, so that what an output block gathers is bounded by
    its own size times the square of a box's overlap, and no raster is ever gathered.
    """
    sized = extents.select(key, "height", "width", reduced(F.col("height"), factor).alias("oh"), reduced(F.col("width"), factor).alias("ow"))
    held = interleaved(store).select(key, "by", "bx", "h", "w", "data").join(sized, key)

    def send(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in pdf.to_dict("records"):
            block = np.frombuffer(r["data"], np.uint8).reshape(r["h"], r["w"], bands)
            oy, ox, sums = box_sums(block, r["by"] * side, r["bx"] * side, r["height"], r["width"], r["oh"], r["ow"])
            for by in range(oy // side, (oy + sums.shape[0] - 1) // side + 1):
                for bx in range(ox // side, (ox + sums.shape[1] - 1) // side + 1):
                    ya, xa = max(oy, by * side), max(ox, bx * side)
                    part = sums[ya - oy : (by + 1) * side - oy, xa - ox : (bx + 1) * side - ox]
                    out.append((r[key], by, bx, r["height"], r["width"], r["oh"], r["ow"], ya, xa, *part.shape[:2], part.tobytes()))
        return pd.DataFrame(out, columns=[key, "by", "bx", "height", "width", "oh", "ow", "ya", "xa", "ph", "pw", "part"])

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        f = pdf.iloc[0]
        y0, x0 = int(f["by"]) * side, int(f["bx"]) * side
        h, w = min(side, int(f["oh"]) - y0), min(side, int(f["ow"]) - x0)
        sums = np.zeros((h, w, bands), np.int64)
        for r in pdf.to_dict("records"):
            ya, xa = r["ya"] - y0, r["xa"] - x0
            sums[ya : ya + r["ph"], xa : xa + r["pw"]] += np.frombuffer(r["part"], np.int64).reshape(r["ph"], r["pw"], bands)
        data = means(sums, box_counts(int(f["height"]), int(f["oh"]))[y0 : y0 + h], box_counts(int(f["width"]), int(f["ow"]))[x0 : x0 + w])
        return pd.DataFrame({key: [f[key]], "by": [f["by"]], "bx": [f["bx"]], "h": [h], "w": [w], "bands": [bands], "planar": [False], "data": [data]})

    sums = f"{key} long, by int, bx int, height long, width long, oh long, ow long, ya int, xa int, ph int, pw int, part binary"
    parts = held.groupBy(key, "by", "bx").applyInPandas(send, sums)
    every = sized.withColumn("by", F.explode(F.expr(f"sequence(0, cast((oh - 1) div {side} AS int))"))).withColumn("bx", F.explode(F.expr(f"sequence(0, cast((ow - 1) div {side} AS int))")))
    none = every.select("*", (F.col("by") * side).alias("ya"), (F.col("bx") * side).alias("xa"), F.lit(0).alias("ph"), F.lit(0).alias("pw"), F.unhex(F.lit("")).alias("part"))
    return parts.unionByName(none).groupBy(key, "by", "bx").applyInPandas(gather, BLOCK.format(key=key))


def plane_blocks(images: DataFrame, block_w: int, block_h: int, parts: int) -> DataFrame:
    """Every block of every plane of each image, numbered from 0 by z, channel, time, row and column, and dealt to runs of ceil(n / parts) blocks.

    images: zs, channels, times (arrays of indexes), width and height, and any other columns. Numbers are arithmetic on places, so nothing is sorted
    or shuffled. Edge blocks are cut at the image; an image without planes or area has no block.
    """
    across, down = f"((width + {block_w - 1}) div {block_w})", f"((height + {block_h - 1}) div {block_h})"
    out = images.where("width > 0 AND height > 0")
    for name, column in (("zs", "z"), ("channels", "c"), ("times", "t")):
        out = out.select("*", F.posexplode(name).alias(f"_{column}", column))
    out = out.withColumn("_y", F.explode(F.expr(f"sequence(0L, {down} - 1)"))).withColumn("_x", F.explode(F.expr(f"sequence(0L, {across} - 1)")))
    out = out.withColumn("number", F.expr(f"(((_z * size(channels) + _c) * size(times) + _t) * {down} + _y) * {across} + _x"))
    out = out.withColumn("part", F.expr(f"number div ((size(zs) * size(channels) * size(times) * {down} * {across} + {parts - 1}) div {parts})"))
    place = {"x": f"_x * {block_w}", "y": f"_y * {block_h}", "w": f"least({block_w}, width - _x * {block_w})", "h": f"least({block_h}, height - _y * {block_h})"}
    return out.withColumns({n: F.expr(e) for n, e in place.items()}).drop("_z", "_c", "_t", "_y", "_x", "zs", "channels", "times", "width", "height")

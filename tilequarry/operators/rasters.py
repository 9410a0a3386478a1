"""Raster operators on pixels in long form (image key, y, x, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def prefix_sums(px: DataFrame, key: str, value: Column) -> DataFrame:
    """Summed-area table: s is the sum of value over all pixels up to (y, x)."""
    rows = W.partitionBy(key, "y").orderBy("x").rowsBetween(W.unboundedPreceding, 0)
    cols = W.partitionBy(key, "x").orderBy("y").rowsBetween(W.unboundedPreceding, 0)
    return px.withColumn("_r", F.sum(value).over(rows)).withColumn("s", F.sum("_r").over(cols)).drop("_r")


def window_sum(sat: DataFrame, windows: DataFrame, key: str) -> DataFrame:
    """Sum inside each window (x0, y0, x1, y1 half open), from four corners of the table."""
    out = windows
    for n, (cx, cy) in enumerate((("x1", "y1"), ("x0", "y1"), ("x1", "y0"), ("x0", "y0"))):
        corner = sat.select(F.col(key), (F.col("x") + 1).alias(cx), (F.col("y") + 1).alias(cy), F.col("s").alias(f"_s{n}"))
        out = out.join(corner, [key, cx, cy], "left")
    s = [F.coalesce(f"_s{n}", F.lit(0)) for n in range(4)]
    return out.withColumn("total", s[0] - s[1] - s[2] + s[3]).drop(*[f"_s{n}" for n in range(4)])


def otsu(px: DataFrame, key: str, grey: str) -> DataFrame:
    """Otsu's threshold of each image from its histogram: the first grey level of greatest between-class variance."""
    hist = px.groupBy(key, grey).agg(F.count(F.lit(1)).alias("n"))
    upto = W.partitionBy(key).orderBy(grey).rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy(key)
    h = hist.select(key, grey, F.sum("n").over(upto).alias("w0"), F.sum(F.col("n") * F.col(grey)).over(upto).alias("m0"), F.sum("n").over(whole).alias("w"), F.sum(F.col("n") * F.col(grey)).over(whole).alias("m"))
    gap = (F.col("m0") * (F.col("w") - F.col("w0")) - (F.col("m") - F.col("m0")) * F.col("w0")).cast("double")
    between = h.where("w0 < w").select(key, grey, (gap * gap / (F.col("w0") * (F.col("w") - F.col("w0")))).alias("v"))
    return between.groupBy(key).agg(F.min(F.struct(-F.col("v"), grey))[grey].alias("threshold"))


def dilate(px: DataFrame, key: str, radius: int, size: int) -> DataFrame:
    """Set pixels grown by a disk, inside a square of the given size."""
    offsets = [(dy, dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1) if dx * dx + dy * dy <= radius * radius]
    near = F.explode(F.array(*[F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x")) for dy, dx in offsets])).alias("p")
    return px.select(key, near).select(key, "p.y", "p.x").where(f"y >= 0 AND x >= 0 AND y < {size} AND x < {size}").distinct()


def erode(px: DataFrame, key: str, side: int) -> DataFrame:
    """Pixels whose odd-sided square neighbourhood is set throughout; outside counts as not set."""
    half = side // 2
    span = range(-half, half + 1)
    near = F.explode(F.array(*[F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x")) for dy in span for dx in span])).alias("p")
    return px.select(key, near).select(key, "p.y", "p.x").groupBy(key, "y", "x").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == side * side).select(key, "y", "x")


def components(px: DataFrame, key: str, size: int) -> DataFrame:
    """4-connected components: the least pixel number of each pixel's component. A raster (size x size pixels at most) is searched in one group."""
    first = px.select(key, "y", "x", (F.col("y") * size + F.col("x")).cast("long").alias("c"))
    return first.groupBy(key).applyInPandas(_label, f"{key} long, y int, x int, c long")


def _label(pdf):
    at = {(y, x): c for y, x, c in zip(pdf["y"], pdf["x"], pdf["c"], strict=True)}
    out: dict = {}
    for start in sorted(at, key=at.get):
        if start in out:
            continue
        stack, out[start] = [start], at[start]
        while stack:
            y, x = stack.pop()
            for p in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                if p in at and p not in out:
                    out[p] = at[start]
                    stack.append(p)
    return pdf.assign(c=[out[p] for p in zip(pdf["y"], pdf["x"], strict=True)])

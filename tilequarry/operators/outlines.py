"""A server's shapes as labelled points of their outlines: boxes and ellipses pixel by pixel and thinned, polygons whole."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rings import parse_points
from .shapes import rectangle_perimeter, thin

POINTS = "array<struct<x:double,y:double>>"
#: Points that one batch of walked ellipses may hold before it is sent on.
BATCH_POINTS = 1_000_000


def ellipse_walk(cx: int, cy: int, rx: int, ry: int) -> np.ndarray:
    """The pixels (x, y) of an ellipse's border by integer error terms (Zingl's algorithm), from the ends of its horizontal axis.

    Each step gives its pixel in all four quarters (right below, left below, left above, right above, with y downwards), so a pixel
    on an axis comes twice; what a flat ellipse lacks at its tips follows in pairs. An ellipse without radii is one pixel.
    """
    if not rx and not ry:
        return np.array([[cx, cy]])
    across, down = rx * rx, ry * ry
    u, v, error = -rx, 0, (1 - 2 * rx) * down + across
    steps = []
    while u <= 0:
        steps.append((u, v))
        twice = 2 * error
        if twice >= (2 * u + 1) * down:
            u += 1
            error += (2 * u + 1) * down
        if twice <= (2 * v + 1) * across:
            v += 1
            error += (2 * v + 1) * across
    s = np.array(steps)
    quarters = np.stack([s * [-1, 1], s, s * [1, -1], -s], axis=1).reshape(-1, 2)
    tips = np.arange(v + 1, ry + 1).repeat(2) * np.tile([1, -1], max(0, ry - v))
    return np.concatenate([quarters, np.column_stack([np.zeros(len(tips), int), tips])]) + [cx, cy]


def walked(ellipses: DataFrame, stride: int) -> DataFrame:
    """(image_id, shape_id, label, points) of ellipses with centre, radii and the image's width and height; every stride-th pixel of those on the image."""

    columns = ["image_id", "shape_id", "label", "points"]

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for f in frames:
            for r in f.to_dict("records"):
                at = ellipse_walk(*(round(r[c]) for c in ("x", "y", "w", "h")))
                at = at[((at >= 0) & (at < [r["width"], r["height"]])).all(axis=1)][::stride]
                held.append((r["image_id"], r["shape_id"], r["label"], [{"x": float(x), "y": float(y)} for x, y in at.tolist()]))
                n += len(at)
                if n >= BATCH_POINTS:
                    yield pd.DataFrame(held, columns=columns)
                    held, n = [], 0
        if held:
            yield pd.DataFrame(held, columns=columns)

    return ellipses.select("image_id", "shape_id", "label", "x", "y", "w", "h", "width", "height").mapInPandas(walk, f"image_id long, shape_id long, label string, points {POINTS}")


def outlines(shapes: DataFrame, images: DataFrame, stride: int = 4, downsample: float = 1, include_all: bool = False, text_filter: tuple[str, ...] = ()) -> DataFrame:
    """(image_id, shape_id, label, points, warning) of every shape, or of those whose text, lower-cased, is in the filter.

    shapes: image_id, shape_id (never null), kind, text, x, y, w, h (an ellipse's centre and radii), points as text; images: image_id, width0, height0.
    Kinds that have no outline, and shapes whose numbers are missing, have null points and a warning. Shapes of unknown images are left out.
    """
    wanted = shapes if include_all else shapes.where(F.lower("text").isin(list(text_filter)))
    size = images.select("image_id", (F.col("width0") / downsample).alias("width"), (F.col("height0") / downsample).alias("height"))
    s = wanted.join(size, "image_id").withColumn("label", F.lower("text"))
    s = s.select("image_id", "shape_id", "kind", "label", *[(F.col(c) / downsample).cast("double").alias(c) for c in "xywh"], F.col("points").alias("given"), "width", "height")
    whole = F.col("x").isNotNull() & F.col("y").isNotNull() & (F.col("w") >= 0) & (F.col("h") >= 0)
    round_ = F.coalesce((F.col("kind") == "ellipse") & whole, F.lit(False))
    columns = ("image_id", "shape_id", "label", "points", "warning")
    walks = walked(s.where(round_), stride).withColumn("warning", F.lit(None).cast("string"))
    box = thin(rectangle_perimeter(*[F.col(c) for c in ("x", "y", "w", "h", "width", "height")]), stride)
    ring = F.transform(parse_points(F.col("given")), lambda p: F.struct((p["x"] / downsample).alias("x"), (p["y"] / downsample).alias("y")))
    points = F.when((F.col("kind") == "rectangle") & whole, box).when(F.col("kind") == "polygon", ring)
    known = F.col("kind").isin("rectangle", "ellipse", "polygon")
    warning = F.when(F.coalesce(known, F.lit(False)), F.lit("shape without numbers")).otherwise(F.concat(F.lit("unsupported kind: "), F.coalesce("kind", F.lit("none"))))
    others = s.where(~round_).withColumn("points", points).withColumn("warning", F.when(F.col("points").isNull(), warning))
    return walks.select(*columns).unionByName(others.select(*columns))

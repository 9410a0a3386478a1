"""Shapes as points and pixels: perimeters, usable rings, even-odd fill, and what a server's shape says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rings import ellipse


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def rectangle_perimeter(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """The pixels of a rectangle's border, clockwise from its first corner, each side from corner to corner; those off the image are left out."""
    c0, c1, r0, r1 = (F.rint(v).cast("int") for v in (x, x + w, y, y + h))
    line = lambda a, b, make: F.transform(F.sequence(a, b), make)
    every = F.concat(
        line(c0, c1, lambda c: point(c, r0)),
        line(r0, r1, lambda r: point(c1, r)),
        line(c1, c0, lambda c: point(c, r1)),
        line(r1, r0, lambda r: point(c0, r)),
    )
    return F.filter(every, lambda p: (p["x"] >= 0) & (p["y"] >= 0) & (p["x"] < width) & (p["y"] < height))


def thin(points: Column, stride: int) -> Column:
    return F.filter(points, lambda p, i: i % stride == 0)


def usable(kind: Column, points: Column) -> Column:
    """Whether a geometry has the points that its kind needs; other kinds are not supported."""
    return F.coalesce(F.size(points) >= F.when(kind == "polygon", 3).when(kind == "polyline", 2).when(kind == "point", 1), F.lit(False))


def ring_spans(ring: Column) -> Column:
    """Even-odd fill of a ring as (y, x_from, x_to), half open; a pixel is inside by its whole coordinates.

    A crossing at an edge's lower end counts and one at its upper end does not, so touching rings share no pixel. Holes
    that are bridged into the ring come out as holes.
    """
    held = F.array(F.struct(F.transform(ring, lambda p, i: F.struct(p.alias("a"), F.get(ring, F.when(i + 1 < F.size(ring), i + 1).otherwise(0)).alias("b"))).alias("edges")))

    def spans(h: Column) -> Column:
        edges = h["edges"]
        low = F.ceil(F.array_min(F.transform(edges, lambda e: e["a"]["y"])))
        high = F.ceil(F.array_max(F.transform(edges, lambda e: e["a"]["y"]))) - 1

        def crossings(y: Column) -> Column:
            met = F.filter(edges, lambda e: (F.least(e["a"]["y"], e["b"]["y"]) <= y) & (y < F.greatest(e["a"]["y"], e["b"]["y"])))
            return F.array_sort(F.transform(met, lambda e: e["a"]["x"] + (y - e["a"]["y"]) * (e["b"]["x"] - e["a"]["x"]) / (e["b"]["y"] - e["a"]["y"])))

        def pairs(r: Column) -> Column:
            ends = F.transform(r["c"], lambda c, i: F.struct(r["y"].alias("y"), F.ceil(c).alias("x_from"), F.ceil(F.get(r["c"], i + 1)).alias("x_to"), (i % 2 == 0).alias("k")))
            return F.filter(ends, lambda s: s["k"] & (s["x_from"] < s["x_to"]))

        rows = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))
        return F.flatten(F.transform(F.transform(rows, lambda y: F.struct(y.alias("y"), crossings(y).alias("c"))), pairs))

    return F.when(F.size(ring) >= 3, F.element_at(F.transform(held, spans), 1))


def filled(shapes: DataFrame, ring: str) -> DataFrame:
    """The rows whose ring has a pixel inside."""
    return shapes.withColumn("_n", F.size(ring_spans(F.col(ring)))).where("_n > 0").drop("_n")


def fill(shapes: DataFrame, ring: str, *keys: str) -> DataFrame:
    """(keys, y, x) for every pixel inside each row's ring."""
    spans = shapes.select(*keys, F.explode(ring_spans(F.col(ring))).alias("s"))
    return spans.select(*keys, F.col("s.y").alias("y"), F.explode(F.sequence("s.x_from", F.col("s.x_to") - 1)).alias("x"))


#: Pixels of a row that are settled together.
STRIP = 16


def row_owners(spans: DataFrame, value: str, tasks: int) -> DataFrame:
    """(image_id, y, x, value) for each pixel, the greatest whole number `value` among the spans (image_id, y, x_from, x_to, value) that have it; spans are half open.

    Spans are dealt by their rows, not by pixels; strips of STRIP pixels of a row are then settled where they are.
    """
    s = spans.where("x_from < x_to").repartition(tasks, "image_id", "y")
    s = s.withColumn("strip", F.explode(F.expr(f"sequence(cast(floor(x_from / {STRIP}) AS bigint), cast(floor((x_to - 1) / {STRIP}) AS bigint))")))
    at = [F.col("strip") * STRIP + i for i in range(STRIP)]
    held = s.groupBy("image_id", "y", "strip").agg(*[F.max(F.when((F.col("x_from") <= x) & (x < F.col("x_to")), F.col(value))).alias(f"p{i}") for i, x in enumerate(at)])
    pixels = held.select("image_id", "y", "strip", F.posexplode(F.array(*[F.col(f"p{i}") for i in range(STRIP)])).alias("i", value)).where(F.col(value).isNotNull())
    return pixels.select("image_id", "y", (F.col("strip") * STRIP + F.col("i")).alias("x"), value)


def last_writer(pixels: DataFrame, order: str, *values: str) -> DataFrame:
    """One row for each pixel of an image, with the values of the shape that comes last in order."""
    best = pixels.groupBy("image_id", "y", "x").agg(F.max(F.struct(order, *values)).alias("b"))
    return best.select("image_id", "y", "x", "b.*")


def first_given(values: Column) -> Column:
    """The first of an array's texts that is not blank."""
    return F.get(F.filter(values, lambda v: F.length(F.trim(F.coalesce(v, F.lit("")))) > 0), F.lit(0))


def shape_spec(kind: Column, x: Column, y: Column, w: Column, h: Column, points: Column) -> Column:
    """A server's shape as a kind and points: boxes and ellipses (x, y the centre, w, h the radii) become polygons, other kinds none."""
    box = F.array(point(x, y), point(x + w, y), point(x + w, y + h), point(x, y + h), point(x, y))
    known = F.when(kind == "rectangle", F.struct(F.lit("polygon").alias("kind"), box.alias("points")))
    known = known.when(kind == "point", F.struct(F.lit("point").alias("kind"), F.array(point(x, y)).alias("points")))
    known = known.when(kind == "ellipse", F.struct(F.lit("polygon").alias("kind"), ellipse(x, y, w, h).alias("points")))
    return known.when(kind.isin("polygon", "polyline"), F.struct(kind.alias("kind"), points.alias("points")))

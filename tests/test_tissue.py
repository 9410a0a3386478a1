"""The tissue chain against pixel-wise brute force, on rasters wider than a word."""

import random

from pyspark.sql import functions as F

from tilequarry.operators import tissue as TI
from tilequarry.sources import scratch


def closed(on, h, w):
    near = lambda y, x: [(y, x), (y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)]
    inside = lambda p: 0 <= p[0] < h and 0 <= p[1] < w
    grown = {q for p in on for q in near(*p) if inside(q)}
    return {p for p in grown if all(q in grown for q in near(*p) if inside(q))}


def large(on, least):
    left, out = set(on), set()
    while left:
        stack, part = [left.pop()], set()
        while stack:
            y, x = stack.pop()
            part.add((y, x))
            for q in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                if q in left:
                    left.remove(q)
                    stack.append(q)
        out |= part if len(part) >= least else set()
    return out


def pixels(runs):
    return {(r["image"], r["y"], x) for r in runs.collect() for x in range(r["a"], r["b"])}


def test_chain_on_rasters_wider_than_a_word(spark):
    rng, rows, want = random.Random(4), [], set()
    for image, (h, w) in enumerate([(30, 150), (7, 60), (9, 61), (20, 20)]):
        on = {(y, x) for y in range(h) for x in range(w) if rng.random() < 0.3}
        rows += [(image, y, x, 0.9 if (y, x) in on else 0.1) for y in range(h) for x in range(w)]
        want |= {(image, *p) for p in large(closed(on, h, w), 16)}
    rows += [(9, y, x, 0.5) for y in range(5) for x in range(5)]
    px = spark.createDataFrame(rows, "image long, y int, x int, s double")
    assert pixels(TI.tissue_mask(px, "image", "s")) == want and len(want) > 500


def test_stained_square_on_glass(spark):
    rows = [(1, y, x, *((180, 60, 160) if 10 <= y < 30 and 10 <= x < 30 else (250, 250, 250))) for y in range(40) for x in range(40)]
    px = spark.createDataFrame(rows, "image long, y int, x int, r int, g int, b int")
    assert pixels(TI.tissue_mask(px.withColumn("s", TI.saturation(*[F.col(c) for c in "rgb"])), "image", "s", 4)) == {(1, y, x) for y in range(10, 30) for x in range(10, 30)}
    grey = px.withColumn("s", TI.inverse_grey(F.when(F.col("r") == 180, 40).otherwise(250)))
    assert len(pixels(TI.tissue_mask(grey, "image", "s", 4))) == 400
    assert scratch.release(spark) > 0


def test_pixels_that_a_raster_lacks_are_there_unset(spark):
    rng, h, w = random.Random(5), 24, 130
    present = {(y, x) for y in range(h) for x in range(w) if y % 5 != 2 or x % 7 != 3}
    on = {p for p in sorted(present) if rng.random() < 0.4}
    px = spark.createDataFrame([(1, *p, 0.9 if p in on else 0.1) for p in sorted(present)], "image long, y int, x int, s double")
    want = {(1, *p) for p in large(closed(on, h, w), 16)}
    assert pixels(TI.tissue_mask(px, "image", "s")) == want and any((y, x) not in present for _, y, x in want)

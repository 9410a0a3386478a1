"""Shapes that vanish when their class shrinks, against pixel-wise brute force, on slides of several cells."""

import random

import pytest

from tilequarry.operators import erosion as E
from tilequarry.operators.tiles import TileParams

SHAPE = "image_id long, shape_id long, text string, x long, y long, bw long, bh long, ring array<struct<x:double,y:double>>"
SLIDE = "image_id long, image_name string, width0 long, height0 long, pixel_size double"


def lost(shapes, sides):
    """{(image_id, shape_id)}: shapes are (image_id, shape_id, folder, pixels)."""
    out = set()
    for image, side in sides.items():
        own, union = {}, {}
        for _, shape, folder, px in sorted((s for s in shapes if s[0] == image), key=lambda s: s[1]):
            own |= dict.fromkeys(px, (shape, folder))
            union.setdefault(folder, set()).update(px)
        back, ahead = side // 2, side - 1 - side // 2
        held = set()
        for shape, folder in set(own.values()):
            u = union[folder]
            mine = [q for q, o in own.items() if o == (shape, folder)]
            reach = range(-back, ahead + 1)
            if any(all((x + i, y + j) in u for i in reach for j in reach) for x, y in mine):
                held.add(shape)
        out |= {(image, s) for s, f in set(own.values()) if f and s not in held}
    return out


@pytest.fixture(scope="module")
def drawn(spark):
    """Boxes of three texts on three slides, some across the borders of cells, and rings that are the same boxes."""
    rng, rows, shapes = random.Random(8), [], []
    for k in range(150):
        image, text = k % 3, rng.choice(["g3", "atrophy", "weird"])
        near = rng.choice([60, 120, 180]) if k % 4 else rng.randrange(190)
        x, y = max(0, near - rng.randrange(20)), max(0, rng.choice([60, 120, 90]) - rng.randrange(20))
        w, h = (rng.randrange(1, 25), rng.randrange(1, 25)) if k % 9 else (130, 95)
        ring = [(float(a), float(b)) for a, b in ((x, y), (x + w, y), (x + w, y + h), (x, y + h))] if k % 2 else None
        rows.append((image, k, text, x, y, w, h, ring))
        px = {(a, b) for a in range(x, min(x + w, 200)) for b in range(y, min(y + h, 150))}
        shapes.append((image, k, {"g3": "G3", "atrophy": "Atrophy"}.get(text, ""), px))
    slides = [(0, "a", 200, 150, 1.0), (1, "b", 200, 150, 0.5), (2, "c", 200, 150, None)]
    alias = [("g3", "G3"), ("atrophy", "Atrophy")]
    return spark.createDataFrame(rows, SHAPE), spark.createDataFrame(slides, SLIDE), spark.createDataFrame(alias, "alias string, folder string"), shapes


@pytest.mark.parametrize(("um", "sides"), [(4.5, {0: 9, 1: 18, 2: 8}), (16.0, {0: 32, 1: 64, 2: 8}), (1.0, {0: 2, 1: 4, 2: 8})])
def test_lost_shapes_are_those_of_brute_force(drawn, um, sides):
    shapes, slides, alias, pixels = drawn
    got = E.erosion_loss(shapes, slides, alias, TileParams(mpp=None, downsample=1.0, size=8, erode_um=um))
    want = lost(pixels, sides)
    assert {(r["image_id"], r["shape_id"]) for r in got.collect()} == want and want


def test_shapes_are_moved_once(drawn):
    """Rows of pixels stay in the task that their cell was dealt to: besides slides, only shapes and verdicts are moved."""
    shapes, slides, alias, _ = drawn
    plan = E.erosion_loss(shapes, slides, alias, TileParams(mpp=None, downsample=1.0, size=8, erode_um=None))._jdf.queryExecution().executedPlan().toString()
    moved = [x for x in plan.split("\n") if "Exchange hashpartitioning" in x]
    assert not any("folder" in x and "shape_id" not in x or " y#" in x or "word" in x for x in moved)
    assert sum("cy#" in x for x in moved) == 1

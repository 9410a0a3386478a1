"""Outlines of shapes."""

import numpy as np
import pytest

from tilequarry.operators import outlines as O


@pytest.mark.parametrize(("rx", "ry"), [(0, 0), (1, 1), (5, 3), (3, 5), (12, 12), (40, 7), (7, 40), (100, 1), (1, 100), (0, 6), (6, 0)])
def test_ellipse_walk(rx, ry):
    at = O.ellipse_walk(10, -4, rx, ry) - [10, -4]
    held = {tuple(p) for p in at.tolist()}
    assert {(rx, 0), (-rx, 0), (0, ry), (0, -ry)} <= held
    assert held == {(sx * x, sy * y) for x, y in held for sx in (1, -1) for sy in (1, -1)}
    assert max(abs(x) for x, _ in held) <= max(1, rx) and max(abs(y) for _, y in held) <= max(1, ry)
    if min(rx, ry) > 1:
        fine = np.linspace(0, 2 * np.pi, 20_000)
        curve = np.column_stack([rx * np.cos(fine), ry * np.sin(fine)])
        assert all(np.hypot(*(curve - p).T).min() < 1 for p in held)
        assert all(min(np.abs(np.array(list(held)) - c).max(axis=1)) <= 1 for c in curve[::50])


def test_outlines(spark):
    kinds = [("rectangle", 2.0, 1.0, 4.0, 2.0, None), ("ellipse", 6.0, 5.0, 4.0, 2.0, None), ("polygon", None, None, None, None, "1,2 3,4 5,6"), ("label", 1.0, 1.0, 1.0, 1.0, None), (None, 1.0, 1.0, 1.0, 1.0, None), ("ellipse", None, 1.0, 1.0, 1.0, None), ("rectangle", 1.0, 1.0, -3.0, 1.0, None), ("polygon", 1.0, 1.0, 1.0, 1.0, None)]
    rows = [(1, n, k, "Tumor" if n % 2 == 0 else None, *r) for n, (k, *r) in enumerate(kinds)] + [(9, 50, *kinds[0][:1], "tumor", *kinds[0][1:])]
    shapes = spark.createDataFrame(rows, "image_id long, shape_id long, kind string, text string, x double, y double, w double, h double, points string")
    images = spark.createDataFrame([(1, 9, 8)], "image_id long, width0 long, height0 long")
    got = {r["shape_id"]: r for r in O.outlines(shapes, images, stride=3, downsample=1, include_all=True).collect()}
    assert sorted(got) == list(range(8))
    border = [(x, 1) for x in range(2, 7)] + [(6, y) for y in range(1, 4)] + [(x, 3) for x in range(6, 1, -1)] + [(2, y) for y in range(3, 0, -1)]
    assert [(p["x"], p["y"]) for p in got[0]["points"]] == border[::3]
    walk = [p for p in map(tuple, O.ellipse_walk(6, 5, 4, 2).tolist()) if p[0] < 9]
    assert [(p["x"], p["y"]) for p in got[1]["points"]] == walk[::3]
    assert [(p["x"], p["y"]) for p in got[2]["points"]] == [(1, 2), (3, 4), (5, 6)]
    assert [got[n]["warning"] for n in range(8)] == [None, None, None, "unsupported kind: label", "unsupported kind: none", "shape without numbers", "shape without numbers", "shape without numbers"]
    some = O.outlines(shapes, images, text_filter=("tumor",)).collect()
    assert sorted(r["shape_id"] for r in some) == [0, 2, 4, 6] and {r["label"] for r in some} == {"tumor"}
    assert O.outlines(shapes, images).count() == 0 and O.outlines(shapes.limit(0), images, include_all=True).count() == 0

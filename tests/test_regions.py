"""Block stores against numpy on whole rasters."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilequarry.operators import blocks as B

SIDE = 7
SHAPES = {1: (23, 30), 2: (5, 3), 3: (7, 14)}


@pytest.fixture(scope="module")
def rasters():
    rng = np.random.default_rng(3)
    return {k: rng.integers(0, 256, (*s, 2)).astype(np.uint8) for k, s in SHAPES.items()}


def tables(spark, rasters, planar):
    rows = [(k, y, x, *map(int, a[y, x])) for k, a in rasters.items() for y in range(a.shape[0]) for x in range(a.shape[1])]
    odd = [(1, -1, 0, 9, 9), (2, 5, 0, 9, 9), (99, 0, 0, 9, 9)]
    px = spark.createDataFrame(rows + odd + rows[:3], "id long, y int, x int, a int, b int")
    extents = spark.createDataFrame([(k, *s) for k, s in SHAPES.items()], "id long, height long, width long")
    return px, extents, B.to_blocks(px, extents, "id", SIDE, ["a", "b"], planar)


def averaged(a, oh, ow):
    h, w, c = a.shape
    out = np.zeros((oh, ow, c), np.uint8)
    for i in range(oh):
        for j in range(ow):
            box = a[i * h // oh : -(-(i + 1) * h // oh), j * w // ow : -(-(j + 1) * w // ow)].reshape(-1, c).astype(int)
            out[i, j] = (2 * box.sum(0) + len(box)) // (2 * len(box))
    return out


@pytest.mark.parametrize("planar", [False, True])
def test_regions(spark, rasters, planar):
    _, extents, store = tables(spark, rasters, planar)
    asked = [(n, k, x, y) for n, (k, x, y) in enumerate([(1, 0, 0), (1, 13, 11), (1, 500, 500), (1, -4, 9), (2, 1, 1), (3, 6, 3), (77, 0, 0)])]
    windows = B.clamped(spark.createDataFrame(asked, "n long, id long, x long, y long"), extents, "id", 9, F.lit(1.0))
    read = B.regions(windows, store, "id", "n", SIDE, 2)
    got = {r["n"]: r for r in read.collect()}
    assert sorted(got) == [0, 1, 2, 3, 4, 5]
    for n, k, x, y in asked[:6]:
        h, w = SHAPES[k]
        x0, y0 = min(max(x, 0), max(w - 9, 0)), min(max(y, 0), max(h - 9, 0))
        want = rasters[k][y0 : y0 + 9, x0 : x0 + 9]
        assert (got[n]["h"], got[n]["w"]) == want.shape[:2] and bytes(got[n]["data"]) == want.tobytes()
    for r in B.resized(read, "id", "n", 4).collect():
        g = got[r["n"]]
        whole = np.frombuffer(bytes(g["data"]), np.uint8).reshape(g["h"], g["w"], 2)
        assert bytes(r["data"]) == averaged(whole, 4, 4).tobytes()


@pytest.mark.parametrize("factor", [1, 2, 3.7, 50])
def test_whole_images(spark, rasters, factor):
    _, extents, store = tables(spark, rasters, True)
    made = {}
    for r in B.whole_at(store, extents, "id", SIDE, factor, 2).collect():
        made[r["id"], r["by"], r["bx"]] = np.frombuffer(bytes(r["data"]), np.uint8).reshape(r["h"], r["w"], 2)
    for k, a in rasters.items():
        oh, ow = (max(1, round(s / factor)) for s in a.shape[:2])
        want = averaged(a, oh, ow)
        blocks = {(k, i // SIDE, j // SIDE) for i in range(oh) for j in range(ow)}
        assert blocks == {b for b in made if b[0] == k}
        for _, by, bx in blocks:
            assert np.array_equal(made[k, by, bx], want[by * SIDE : (by + 1) * SIDE, bx * SIDE : (bx + 1) * SIDE])


def test_empty_and_missing_blocks(spark, rasters):
    px, extents, store = tables(spark, rasters, False)
    none = B.to_blocks(px.limit(0), extents, "id", SIDE, ["a", "b"])
    assert none.count() == 0
    windows = spark.createDataFrame([(1, 1, 3, 3, 9, 9), (2, 1, 0, 0, 0, 5)], "n long, id long, x int, y int, w int, h int")
    (row,) = B.regions(windows, store.where("bx > 0"), "id", "n", SIDE, 2).collect()
    want = rasters[1][3:12, 3:12].copy()
    want[:, :4] = 0
    assert bytes(row["data"]) == want.tobytes()
    assert bytes(B.regions(windows, none, "id", "n", SIDE, 2).first()["data"]) == bytes(9 * 9 * 2)
    dark = B.whole_at(none, extents, "id", SIDE, 2, 2)
    assert dark.count() > 0 and not any(any(bytes(r["data"])) for r in dark.collect())


def test_plane_blocks(spark):
    rows = [(1, [4, 9], [0, 2, 1], [0], 23, 11), (2, [0], [0], [0], 5, 5), (3, [], [0], [0], 5, 5), (4, [0], [0], [0], 0, 5), (5, None, [0], [0], 5, 5)]
    images = spark.createDataFrame(rows, "id long, zs array<int>, channels array<int>, times array<int>, width long, height long")
    got = {}
    for r in B.plane_blocks(images, 10, 10, 4).orderBy("id", "number").collect():
        got.setdefault(r["id"], []).append(r)
    want = [(z, c, 0, x, y, min(10, 23 - x), min(10, 11 - y)) for z in (4, 9) for c in (0, 2, 1) for y in (0, 10) for x in (0, 10, 20)]
    assert sorted(got) == [1, 2]
    assert [tuple(r[n] for n in ("z", "c", "t", "x", "y", "w", "h")) for r in got[1]] == want
    assert [r["part"] for r in got[1]] == [i // 9 for i in range(36)] and [r["part"] for r in got[2]] == [0]

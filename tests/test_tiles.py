"""Tile selection on a hand-made slide: population, rules and the pinned seeded sample."""

import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilequarry.operators import catalog as C
from tilequarry.operators import rings as R
from tilequarry.operators import shapes as S
from tilequarry.operators import spans as SP
from tilequarry.operators import tiles as T
from tilequarry.plans import derived as D
from tilequarry.plans import suite

PINNED = """benign 56 8 | G3 16 16 | G3 24 16 | G3 32 16 | benign 48 16 | G3 16 24 | G3 32 24 | G3 16 32
benign 64 32 | G5 40 48 | G5 48 48 | G5 56 48 | benign 16 56 | G5 40 56 | G5 48 56 | G5 56 56 | benign 8 64"""


@pytest.fixture(scope="module")
def slide(spark):
    slides = spark.createDataFrame([(1, 80, 80, 1.0)], "image_id long, width0 long, height0 long, pixel_size double")
    boxes = [(1, 70, 7, 16, 16, 24, 24, "g3"), (1, 80, 8, 40, 48, 24, 16, "g5"), (1, 90, 9, 24, 24, 6, 6, "exclusion roi")]
    shapes = spark.createDataFrame(boxes, "image_id long, roi_id long, shape_id long, x long, y long, bw long, bh long, text string")
    alias = spark.createDataFrame([("g3", "G3"), ("g5", "G5")], "alias string, folder string")
    params = T.TileParams(mpp=1.0, size=8, margin_px=2)
    tiles = T.grid(slides, params)
    inside = (F.col("x0") >= 8) & (F.col("x0") < 72) & (F.col("y0") >= 8) & (F.col("y0") < 72)
    tissue = tiles.select("image_id", "col", "row", F.when(inside, 64).otherwise(0).alias("tissue_px"))
    return T.label_tiles(tiles, shapes, slides, tissue, alias, params)


def test_population(slide):
    counts = {r["outcome"]: r["count"] for r in slide.groupBy("outcome").count().collect()}
    assert (counts["G3"], counts["G5"], counts["benign"]) == (8, 6, 21)
    assert counts["dropped_no_tissue"] == 36 and sum(counts.values()) == 100


def test_pinned_sample(slide):
    kept = slide.where("outcome NOT LIKE 'dropped%'")
    rows = T.cap_labels_exact(kept, 6, "benign", 5, None, 7).orderBy("row", "col").collect()
    want = [x.split() for x in PINNED.replace("\n", " | ").split(" | ")]
    assert [[r["outcome"], str(r["x0"]), str(r["y0"])] for r in rows] == want


def test_hash_caps(slide):
    kept = slide.where("outcome NOT LIKE 'dropped%'")
    rows = T.cap_labels(kept, 6, "benign", 5, 10, 7).collect()
    assert len(rows) == 10 and len({(r["col"], r["row"]) for r in rows}) == 10


def test_grid_counts(spark):
    s = spark.createDataFrame([(1, 1000, 1000, 1.0), (2, 1000, 250, 1.0), (3, 50, 50, None)], "image_id long, width0 long, height0 long, pixel_size double")
    n = {r["image_id"]: r["count"] for r in T.grid(s, T.TileParams(mpp=1.0, size=100)).groupBy("image_id").count().collect()}
    assert n == {1: 100, 2: 20}
    assert T.grid(s, T.TileParams(mpp=1.0, size=100, overlap=50)).where("image_id = 1").count() == 361


@pytest.mark.parametrize("bad", [{"mpp": None}, {"downsample": 2.0}, {"overlap": 32}, {"min_coverage": 1.5}])
def test_contradictory_parameters(bad):
    with pytest.raises(ValueError):
        T.TileParams(**bad)


SQUARE = [(0.0, 0.0), (20.0, 0.0), (20.0, 20.0), (0.0, 20.0), (0.0, 0.0)]


def square(x, y, side):
    return [(x, y), (x + side, y), (x + side, y + side), (x, y + side), (x, y)]


def points(ring):
    return [{"x": float(a), "y": float(b)} for a, b in ring]


def bridged(spark, outer, holes):
    kind = "array<struct<x:double,y:double>>"
    row = spark.createDataFrame([(points(outer), [points(h) for h in holes])], f"o {kind}, h array<{kind}>").select(R.bridge_all(F.col("o"), F.col("h")).alias("r")).first()
    return [(p["x"], p["y"]) for p in row["r"]]


def test_holes_come_back_from_one_ring(spark):
    # Each is nearest to a vertex of the outer ring; a hole that is joined to another hole stays part of that one.
    holes = [square(2.0, 2.0, 3.0), square(2.0, 15.0, 3.0), square(16.0, 3.0, 2.0)]
    parts = R.split_bridges(bridged(spark, SQUARE, holes))
    assert len(parts) == 4 and set(parts[0]) == set(SQUARE)
    assert {frozenset(p) for p in parts[1:]} == {frozenset(h) for h in holes} and all(p[0] == p[-1] for p in parts[1:])


def test_degenerate_holes_are_left_out(spark):
    assert bridged(spark, SQUARE, [[(5.0, 5.0), (6.0, 6.0)]]) == SQUARE[:-1]


def test_spurs_and_seams_are_no_holes():
    ring = [(0, 0), (10, 0), (10, 5), (11, 5), (12, 5), (11, 5), (10, 5), (10, 10), (0, 10)]
    assert R.split_bridges(ring) == [ring]
    assert R.split_bridges([(0, 0), (10, 0), (10, 10), (5, 10), (5, 10), (0, 10), (0, 0), (0, 0)])[1:] == []


def test_every_pair_of_visits_counts():
    # The vertex a is visited three times; only the second and third enclose a ring.
    a = (0, 0)
    ring = [a, (1, 9), (2, 8), a, (3, 3), (4, 3), (4, 4), (3, 3), a, (9, 9)]
    assert R.split_bridges(ring) == [[a, (1, 9), (2, 8), a, (9, 9)], [(3, 3), (4, 4), (4, 3), (3, 3)]]


def test_points_of_a_long_text(spark):
    text = " ".join(f"{i},{i * 2}.5" for i in range(4000))
    began = time.time()
    row = spark.createDataFrame([(text,), ("1,2 x 3",), ("",), (None,)], "t string").select(R.parse_points(F.col("t")).alias("p"), R.signed_area(R.parse_points(F.col("t"))).alias("a")).collect()
    assert [r["p"] if r["p"] is None else len(r["p"]) for r in row] == [4000, 1, 0, None] and row[0]["p"][3999] == (3999.0, 7998.5)
    assert time.time() - began < 5


def test_a_class_without_coverage_is_at_the_edge(spark):
    slides = spark.createDataFrame([(1, 32, 16, 1.0)], "image_id long, width0 long, height0 long, pixel_size double")
    shapes = spark.createDataFrame([(1, 7, 0, 0, 16, 16, "g3")], "image_id long, shape_id long, x long, y long, bw long, bh long, text string")
    alias = spark.createDataFrame([("g3", "G3")], "alias string, folder string")
    got = {}
    for low in (0.0, 0.5):
        p = T.TileParams(mpp=1.0, size=16, min_coverage=low, erode_um=None, tissue_thresh=0.0)
        t = T.label_tiles(T.grid(slides, p).withColumn("tissue_px", F.lit(64)), shapes, slides, None, alias, p)
        got[low] = {r["col"]: r["outcome"] for r in t.collect()}
    assert got == {0.0: {0: "G3", 1: "dropped_roi_edge"}, 0.5: {0: "G3", 1: "benign"}}


def test_background_takes_the_cap_of_labels(spark):
    kept = spark.range(10).selectExpr("1L AS image_id", "cast(id AS int) AS col", "0 AS row", "'benign' AS outcome")
    assert T.cap_labels_exact(kept, 3, "benign", None, None, 7).count() == T.cap_labels(kept, 3, "benign", None, None, 7).count() == 3
    assert T.cap_labels(kept, None, "benign", None, None, 7).count() == 10


@pytest.mark.parametrize("name", ["tile_labels_roi", "tile_labels_whole", "ring_labels", "labels_overlap_eroded", "manifest_rows", "concentric_scales", "scale_edge_drop", "background_margin_um", "grid_cells"])
def test_tiles_are_made_where_their_slide_was_dealt(spark, name):
    plan = suite.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and not re.search(r"Exchange hashpartitioning\([^)]*\bcol#", plan)


def test_whole_grids_and_given_tiles_get_the_same_labels(spark):
    sf, p = "/root/testdata/sf0.001", T.TileParams(mpp=0.73, size=36, overlap=12, erode_um=9.0, margin_um=20.0, tissue_thresh=0.0)
    slides, shapes = D.slides(spark, sf), D.ring_shapes(spark, sf)
    alias = spark.createDataFrame([("gleason 3", "G3"), ("hgpin", "HGPIN")], "alias string, folder string")
    whole = T.label_slides(slides, shapes, alias, p, F.lit(64)).select("image_id", "col", "row", "outcome", "coverage")
    given = T.label_tiles(T.grid(slides, p).withColumn("tissue_px", F.lit(64)), shapes, slides, None, alias, p).select(*whole.columns)
    a, b = ({tuple(r) for r in d.collect()} for d in (whole, given))
    assert a == b and {r[3] for r in a} >= {"G3", "benign", "dropped_unlabeled"}


def test_pixels_are_settled_by_rows(spark):
    rows = [(1, 3, -20, 5, 7), (1, 3, 2, 40, 9), (1, 3, 30, 30, 11), (1, 4, 0, 1, 2)]
    got = S.row_owners(spark.createDataFrame(rows, "image_id long, y long, x_from long, x_to long, v long"), "v", 3)
    want = {(1, 3, x): 7 for x in range(-20, 2)} | {(1, 3, x): 9 for x in range(2, 40)} | {(1, 4, 0): 2}
    assert {tuple(r)[:3]: r["v"] for r in got.collect()} == want
    for name in ("polygon_fill", "mask_rgb"):
        plan = suite.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"Exchange hashpartitioning\([^)]*\bx#", plan)


def test_no_step_makes_a_method_that_is_not_compiled(spark):
    key = "spark.sql.codegen.hugeMethodLimit"
    spark.conf.unset(key)
    plan = suite.QUERIES["manifest_rows"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert spark.conf.get(key) == "8000"
    # Names are made for slides, before they are dealt to panels.
    assert "regexp_extract" not in plan[: plan.index("Exchange")]
    spark.conf.set(key, "60000")
    suite.QUERIES["manifest_rows"](spark, "/root/testdata/sf0.001")
    assert spark.conf.get(key) == "60000"
    spark.conf.unset(key)


def test_shares_as_text(spark):
    shares = [None, 0.0, -0.0, 1 / 3, 2 / 3, 1.0, 1.5, 65.0, -0.5, 1e-7, 1e12, float("nan"), *[k / 64 for k in range(1, 64)], *[k / 144 for k in range(144)]]
    d = spark.createDataFrame([(s,) for s in shares], "s double")
    got = d.select(C.share_text(F.col("s")).alias("a"), F.coalesce(F.round("s", 6).cast("string"), F.lit("")).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in got if r["b"] != "-0.0") and {r["a"] for r in got} >= {"", "0.0", "0.015625", "0.333333", "65.0"}


@pytest.mark.parametrize("per_slide", [None, 9])
def test_exact_caps_draw_as_one_generator_a_slide(spark, per_slide):
    rng, rows = random.Random(3), []
    for image in [None, 2**60 + 1, 5, 6, 7, 8]:
        places = rng.sample([(c, r) for c in range(30) for r in range(21)], rng.randint(1, 80))
        rows += [(image, c, r, rng.choice(["benign", "G3", "é", "Z"])) for c, r in places]
    want = set()
    for image in {r[0] for r in rows}:
        own, draw, out = sorted((r for r in rows if r[0] == image), key=lambda r: (r[2], r[1])), random.Random(7), []
        for label in sorted({r[3] for r in own}):
            some = [r for r in own if r[3] == label]
            cap = 5 if label == "benign" else 6
            out += draw.sample(some, cap) if len(some) > cap else some
        out.sort(key=lambda r: (r[2], r[1]))
        want |= set(draw.sample(out, per_slide) if per_slide and len(out) > per_slide else out)
    kept = spark.createDataFrame(rows, "image_id long, col int, row int, outcome string")
    got = T.cap_labels_exact(kept, 6, "benign", 5, per_slide, 7)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    plan = got._jdf.queryExecution().executedPlan().toString()
    # A slide goes to its task as bits of panels, and no group of rows is handed to Python one by one.
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan


@pytest.mark.parametrize("crossings", [1, 50, 1_000_000])
def test_spans_of_many_rings_are_those_of_each(spark, monkeypatch, crossings):
    rng = random.Random(4)
    rings = [[(rng.choice([rng.uniform(-9, 40), float(rng.randint(-9, 40))]), rng.choice([rng.uniform(-9, 40), float(rng.randint(-9, 40))])) for _ in range(rng.randint(0, 9))] for _ in range(150)]
    d = spark.createDataFrame([(i, [{"x": x, "y": y} for x, y in r]) for i, r in enumerate(rings)], "i long, ring array<struct<x:double,y:double>>")
    clipped = {r["i"]: [(s["y"], max(0, s["x_from"]), min(25, s["x_to"])) for s in r["s"] or [] if 0 <= s["y"] < 30] for r in d.select("i", S.ring_spans(F.col("ring")).alias("s")).collect()}
    want = {i: [s for s in v if s[1] < s[2]] for i, v in clipped.items()}
    monkeypatch.setattr(SP, "CROSSINGS", crossings)
    x, y = (np.array([q[k] for r in rings for q in r]) for k in (0, 1))
    size = np.array([len(r) for r in rings])
    got = {}
    for i, j, lists in SP.span_lists(x, y, size, np.full(150, 25), np.full(150, 30)):
        got |= dict(zip(range(i, j), [[tuple(s.values()) for s in v] for v in lists.to_pylist()], strict=True))
    assert got == want and sum(map(len, want.values())) > 500


@pytest.mark.parametrize("name", ["ring_labels", "dominant_ring", "background_margin_um"])
def test_spans_are_not_searched_where_panels_were_dealt(spark, name):
    plan = suite.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    dealt = plan.index("REPARTITION_BY_NUM", plan.index("explode(spans"))
    assert "MapInArrow" in plan and "spans" not in re.sub(r"explode\(spans#\d+\)|\bspans#\d+", "", plan[:dealt])

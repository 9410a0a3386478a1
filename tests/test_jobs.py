"""Written parameters, segments and chosen files."""

import pytest
from pyspark.sql import functions as F

from tilequarry.operators import jobs as J
from tilequarry.sources import files

JOB = {"whole": False, "include_all": True, "texts": None, "no_background": None, "size": 256, "stride": None, "overlap": None, "min_coverage": 0.5, "tissue_thresh": 0.5, "scales": None, "erode": None, "background_label": None}
DDL = "whole boolean, include_all boolean, texts array<string>, no_background boolean, size int, stride int, overlap int, min_coverage double, tissue_thresh double, scales string, erode string, background_label string"


@pytest.mark.parametrize(
    ("change", "reason"),
    [
        ({}, None),
        ({"texts": ["g3"]}, "all annotations and a list of them"),
        ({"include_all": None, "texts": []}, "no annotations chosen"),
        ({"include_all": False, "texts": ["g3"], "stride": 256}, None),
        ({"whole": True}, "annotations are not read for whole slides"),
        ({"whole": True, "include_all": False, "erode": "auto"}, "whole slides have no background"),
        ({"whole": True, "include_all": False}, None),
        ({"no_background": True, "background_label": "x"}, "a background that is turned off"),
        ({"size": 0}, "size is not positive"),
        ({"size": None}, "size is not positive"),
        ({"stride": 0}, "stride is not within the size"),
        ({"stride": 257}, "stride is not within the size"),
        ({"overlap": 256}, "overlap is not below the size"),
        ({"overlap": -1}, "overlap is not below the size"),
        ({"min_coverage": 1.01}, "fraction is not within 0 and 1"),
        ({"tissue_thresh": None}, "fraction is not within 0 and 1"),
        ({"scales": "nan"}, "scale is no number"),
        ({"scales": "1f"}, "scale is no number"),
        ({"scales": ""}, "no scale"),
        ({"scales": "0"}, "scale is not positive"),
        ({"scales": "1,1.0"}, "scale is repeated"),
        ({"erode": ""}, "erosion is no number"),
        ({"erode": "-0.5"}, "erosion is below zero"),
    ],
)
def test_reasons(spark, change, reason):
    row = JOB | change
    assert J.settled(spark.createDataFrame([tuple(row.values())], DDL)).first()["reason"] == reason


def test_settled_values(spark):
    rows = [JOB | {"stride": 200, "scales": "2, .5,1e0", "erode": " 12.5 "}, JOB | {"whole": True, "include_all": False, "overlap": 3}, JOB | {"no_background": True, "scales": "4"}]
    got = J.settled(spark.createDataFrame([tuple(r.values()) for r in rows], DDL)).select("overlap_px", "mpp", "values", "erode_um", "background").collect()
    assert [tuple(r) for r in got] == [(56, 0.5, [0.5, 1.0, 2.0], 12.5, "benign"), (3, 0.5, None, 0.0, None), (0, 4.0, None, None, None)]


def test_segments(spark):
    t = spark.createDataFrame([(1, [("a", None), (None, "AUTOMATIC")]), (2, []), (3, None)], "template_id long, segments array<struct<label:string,algorithm:string>>")
    got = sorted((tuple(r) for r in J.segments(t).collect()), key=repr)
    assert got == [(1, 1, "a", "MANUAL"), (1, 2, "Segment 2", "AUTOMATIC"), (2, None, None, None), (3, None, None, None)]
    assert {r["label"] for r in J.segments(t, "b").where("template_id = 1").collect()} == {"b", "Segment 2"}


def test_chosen(spark):
    listed = spark.createDataFrame([(p,) for p in ("/d/b.json", "/d/a.json", "/d/z.geojson", "/d/e/f.geojson", "/d/n.txt", "/t/n.txt")], "path string")
    given = spark.createDataFrame(list(enumerate(["/d/", "/d/n.txt", "/x", "/t", "/d/e", "/d", None])), "pos int, given string")
    got = [(r["pos"], r["path"], r["reason"]) for r in files.chosen(given, listed).orderBy("pos", "place").collect()]
    inside = ["/d/z.geojson", "/d/a.json", "/d/b.json"]
    lost = "no such file or directory"
    assert got == [*[(0, p, None) for p in inside], (1, "/d/n.txt", None), (2, None, lost), (4, "/d/e/f.geojson", None), *[(5, p, None) for p in inside], (6, None, lost)]
    assert files.chosen(given, listed.limit(0)).where(F.col("reason").isNull()).count() == 0

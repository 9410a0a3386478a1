"""Files as users have them: cut off, quoted, commented, malformed."""

from pyspark.sql import functions as F

from tilequarry.operators import rings as R
from tilequarry.sources import files as S


def test_strict_manifest(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,label\n1,"two\nlines"\n2\n\n3,x\n4,cut')
    (tmp_path / "b.csv").write_text("id,la")
    (tmp_path / "c.csv").write_text("")
    (tmp_path / "d.csv").write_text('id,label\n5,"open\n')
    rows = S.strict_manifest(S.texts(spark, str(tmp_path))).orderBy("path", "line").collect()
    got = [(r["path"][-5:], r["line"], r["cells"], r["reason"]) for r in rows]
    assert got[:4] == [("a.csv", 2, ["1", "two\nlines"], None), ("a.csv", 4, ["2"], "fields"), ("a.csv", 6, ["3", "x"], None), ("a.csv", 7, ["4", "cut"], "unterminated")]
    assert [(g[0], g[1], g[3]) for g in got[4:]] == [("b.csv", 1, "header cut off"), ("d.csv", 2, "unterminated")]


def test_geojson_containers(spark):
    texts = ['{"type":"FeatureCollection","features":[{"a":1},{"b":2}]}', '{"type":"FeatureCollection"}', '{"type":"Feature"}', "[]", "{", '{"type":"Point"}', "", None]
    found, reason = S.geojson_features(F.col("text"))
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", found.alias("f"), reason.alias("r")).orderBy("i").collect()
    assert [r["f"] for r in rows[:4]] == [['{"a":1}', '{"b":2}'], [], ['{"type":"Feature"}'], []]
    assert [r["r"] for r in rows] == [None] * 4 + ["malformed", "not GeoJSON features", "malformed", "malformed"]


def test_image_map(spark):
    lines = ["path,image", "# note", "", "a.json, 7", "b.json", "c.json,x"]
    rows = S.image_map(spark.createDataFrame([(i + 1, t) for i, t in enumerate(lines)], "line int, text string")).orderBy("line").collect()
    assert [tuple(r) for r in rows] == [(4, "a.json", 7, None), (5, "b.json", None, "bad image id"), (6, "c.json", None, "bad image id")]


def spliced(outer, hole):
    """Both closed rings by plain Python: the hole wound the other way, joined at the nearest vertices."""
    area = lambda r: sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:]))
    outer, hole = outer[:-1], hole[:-1] if area(outer) * area(hole) < 0 else hole[:-1][::-1]
    _, i, j = min(((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2, i, j) for i, a in enumerate(outer) for j, b in enumerate(hole))
    return [*outer[: i + 1], *hole[j:], *hole[: j + 1], *outer[i:]]


def test_bridge_is_the_splice(spark):
    outer, hole = [(0.0, 0.0), (20.0, 0.0), (20.0, 20.0), (0.0, 20.0), (0.0, 0.0)], [(14.0, 15.0), (14.0, 6.0), (6.0, 6.0), (14.0, 15.0)]
    ring = "array<struct<x:double,y:double>>"
    for h in (hole, hole[::-1]):
        got = spark.createDataFrame([(outer, h)], f"o {ring}, h {ring}").select(R.bridge(F.col("o"), F.col("h")).alias("r")).first()["r"]
        assert [tuple(p) for p in got] == spliced(outer, h)

"""Catalogue selection, configuration files and writers."""

import pytest
from pyspark.sql import functions as F

from tilequarry.operators import catalog as C
from tilequarry.operators import manifests as M
from tilequarry.operators import rules as RU
from tilequarry.operators import samples as SA
from tilequarry.operators import shapes as S
from tilequarry.operators import volumes as V
from tilequarry.sources import config, merge, sinks


def test_exactly_one_target(spark):
    i = spark.createDataFrame([(1, 0), (2, 1)], "image_id long, group_id int")
    links = spark.createDataFrame([(1, 5, 9), (1, 6, 9), (2, 6, 8)], "image_id long, dataset_id long, project_id long")
    assert [r["image_id"] for r in C.select_images(i, links, project=9).collect()] == [1]
    assert C.select_images(i, links, dataset=6).count() == 2
    for bad in ({}, {"image": 1, "group": 0}):
        with pytest.raises(ValueError):
            C.select_images(i, links, **bad)
    with pytest.raises(ValueError):
        C.select_images(i, project=9)


def test_palette_files(spark):
    entries = config.parse('[{"hex": "#0a0B0c", "text": "x"}]', "p.json")
    assert config.palette(spark, entries).first()[1:] == ("x", 10, 11, 12)
    with pytest.raises(ValueError):
        config.palette(spark, [{"text": "no colour"}])
    with pytest.raises(ValueError):
        config.hex_rgb("12345")
    rules = config.directory_rules(spark, {"3": [{"regex": r"^N(?P<n>\d+)", "base_dir": "d"}]}).first()
    assert (rules["group_id"], rules["pattern"]) == (3, r"^N(?<n>\d+)")


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "image_id long, label string")
    sinks.write_slide_manifests(rows, f"{tmp_path}/m")
    sinks.write_slide_manifests(spark.createDataFrame([(2, "c")], rows.schema), f"{tmp_path}/m")
    got = {(r["image_id"], r["label"]) for r in spark.read.parquet(f"{tmp_path}/m").collect()}
    assert got == {(1, "a"), (2, "c")} and sinks.complete_slides(spark, f"{tmp_path}/m").count() == 2
    sinks.check_columns(rows, ["image_id", "label"])
    with pytest.raises(ValueError):
        sinks.check_columns(rows, ["label", "image_id"])
    none = spark.createDataFrame([], "image_id long, status string, reason string")
    sinks.write_failures(none, f"{tmp_path}/f", "r1")
    assert spark.read.option("header", True).csv(f"{tmp_path}/f").columns[:2] == ["image_id", "reason"]
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        sinks.write_failures(none, f"{tmp_path}/f", "r1")
    sinks.write_in_batches(spark.range(120).coalesce(1), f"{tmp_path}/b")
    assert len(list((tmp_path / "b").glob("*.parquet"))) == 3


def test_ring_edges_are_half_open(spark):
    """A square, and the same with a bridged hole."""
    outer = [(0.0, 0.0), (20.0, 0.0), (20.0, 20.0), (0.0, 20.0), (0.0, 0.0)]
    hole = [(6.0, 6.0), (6.0, 14.0), (14.0, 14.0), (14.0, 6.0), (6.0, 6.0)]
    rows = [(1, outer), (2, [*outer, *hole, outer[0]]), (3, outer[:2])]
    d = spark.createDataFrame([(i, [{"x": x, "y": y} for x, y in r]) for i, r in rows], "image_id long, ring array<struct<x:double,y:double>>")
    got = {}
    for r in S.fill(d, "ring", "image_id").collect():
        got.setdefault(r["image_id"], set()).add((r["x"], r["y"]))
    assert got[1] == {(x, y) for x in range(20) for y in range(20)} and 3 not in got
    assert (2, 2) in got[2] and (10, 10) not in got[2] and len(got[2]) == 400 - 64


def test_rebase(spark):
    r = spark.range(1).select(C.rebase(F.lit("t/a.png"), "/r/x", "/r").alias("a"), C.rebase(F.lit("a.png"), "/r", "/r").alias("b")).first()
    assert tuple(r) == ("x/t/a.png", "a.png")


def crop(pos, path, mpp, x=0, label="a"):
    return (pos, path, "1", str(x), "0", label, "32", mpp, "")


def crop_table(spark, rows):
    return spark.createDataFrame(rows, "pos int, tile_path string, image_id string, x string, y string, label string, size string, mpp string, roi_id string")


def test_samples_of_several_scales(spark):
    rows = crop_table(spark, [crop(1, "t_x0_y0_mpp1.0.png", "1.0"), crop(2, "t_x0_y0_mpp0.5.png", "0.5"), crop(3, "again_x0_y0_mpp0.5.png", "0.5"), crop(4, "t_x9_y0_mpp0.5.png", "0.5", 9), crop(5, "", "0.5")])
    with pytest.raises(ValueError, match="different scales"):
        SA.read_samples(rows, F.col("pos"))
    got = SA.read_samples(rows, F.col("pos"), [0.5, 1.0]).collect()
    assert [(r["image"], r["images"], r["scales"], r["roi_id"]) for r in got] == [("t_x0_y0_mpp0.5.png", ["t_x0_y0_mpp1.0.png"], [0.5, 1.0], -1)]
    report = SA.sample_report(rows, F.col("pos"), [0.5, 1.0]).first()
    assert (report["coords_only"], report["repeated"], report["incomplete"]) == (1, 1, 1)
    mixed = rows.unionByName(crop_table(spark, [crop(6, "plain.png", "0.5")]))
    with pytest.raises(ValueError, match="single crops"):
        SA.read_samples(mixed, F.col("pos"))
    assert SA.read_samples(mixed, F.col("pos"), [0.5]).count() == 3 and SA.read_samples(mixed, F.col("pos"), [0.5, 1.0]).count() == 1
    # A name that gives another place than the row is a plain one.
    assert SA.read_samples(crop_table(spark, [crop(1, "t_x5_y0_mpp0.5.png", "")]), F.col("pos")).first()["scales"] is None


def test_directories_by_rules(spark):
    rules = config.directory_rules(spark, {"3": [{"regex": r"(?P<case>\d+)-(?P<side>[lr])", "base_dir": "/b", "subject_glob": "case", "formatted_dir": "${side}/${case}"}, {"regex": ".", "base_dir": "/none"}]})
    images = spark.createDataFrame([(1, 3, "17-l.tif"), (2, 3, "18-r.tif"), (3, 3, "x17-l.tif"), (4, 5, "17-l.tif")], "image_id int, group_id int, image_name string")
    dirs = spark.createDataFrame([(d,) for d in ("/b", "/b/z17", "/b/c17", "/b/.a17", "/b/c17/d17")], "path string")
    got = {r["image_id"]: (r["dir"], r["status"]) for r in RU.resolve_directories(images, rules, dirs).collect()}
    assert got == {1: ("/b/c17/l/17", "found"), 2: (None, "no_base"), 3: (None, "no_base"), 4: (None, "no_rule")}
    with pytest.raises(Exception, match="no such base directory: /none"):
        RU.resolve_directories(images, rules, dirs, strict=True).collect()


def test_a_lost_run_is_merged_again(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "id int, v string")
    path = f"{tmp_path}/m"
    # What a lost run left does not count until its marker is there.
    rows.selectExpr("9 AS id", "v", "cast(NULL AS string) AS reason", "'data' AS part").write.partitionBy("part").parquet(f"{path}/runs/run=r1")
    assert merge.read_part(spark, path, "data", rows.schema).count() == 0
    assert merge.merge_run(rows, path, "r1", ["id"], ["v"], ["v"], "id = 2") and not merge.merge_run(rows, path, "r1", ["id"], ["v"], ["v"])
    assert {(r["id"], r["v"]) for r in merge.read_part(spark, path, "data", rows.schema).collect()} == {(1, "a")}
    bad = {(r["id"], r["v"], r["reason"]) for r in merge.read_part(spark, path, "rejected", rows.schema).collect()}
    assert bad == {(1, "b", "conflicts with the row that holds the key"), (2, "c", "malformed"), (None, "d", "malformed")}
    assert merge.merge_run(rows.where("id = 1"), path, "r2", ["id"], ["v"], ["v"]) and merge.read_part(spark, path, "data", rows.schema).count() == 1


def test_a_blank_key_is_appended_once(spark):
    rows = spark.createDataFrame([(None, "a", 1), ("", "a", 1), (None, "b", 2)], "path string, v string, n int")
    none = spark.createDataFrame([], rows.schema)
    held = M.append(rows, none, ["path"], ["v", "n"], ["n"], ["n"])
    assert held.count() == 2
    assert {r["status"] for r in M.classify(rows, held, ["path"], ["v", "n"], ["n"], ["n"]).collect()} == {"identical"}
    assert M.append(rows, M.append(rows, none, ["path"], ["v"], ["n"]), ["path"], ["v"], ["n"]).count() == 1


def test_turned_volumes_keep_places(spark):
    lps = [0.0, 2.0, 0.0, 10.0, -3.0, 0.0, 0.0, 20.0, 0.0, 0.0, 4.0, 30.0]
    plain = [float(i in (0, 5, 10)) for i in range(12)]
    d = spark.createDataFrame([(lps, plain, [5, 6, 7], [1, 2, 3])], "m array<double>, p array<double>, n array<int>, at array<int>")
    d = d.withColumn("r", V.to_ras(F.col("m"))).withColumn("f", V.flips(F.col("r"), F.col("p")))
    row = d.withColumn("new", V.flip(F.col("r"), F.col("f"), F.col("n"))).withColumn("to", V.flip_voxel(F.col("at"), F.col("f"), F.col("n"))).select("*", V.axis_codes(F.col("r")).alias("codes"), V.transposed(F.col("at")).alias("t")).first()
    place = lambda m, at: [sum(m[4 * i + j] * at[j] for j in range(3)) + m[4 * i + 3] for i in range(3)]
    assert row["codes"] == "ALS" and row["t"] == [3, 2, 1] and place(row["r"], row["at"]) == place(row["new"], row["to"])


def test_a_stem_that_many_files_and_images_share(spark):
    n = 60_000
    images = spark.range(n).select(F.col("id").alias("image_id"), F.when(F.col("id") == 7, "other_7").otherwise("slide").alias("istem"))
    files = spark.range(n).select(F.when(F.col("id") == 7, "other_7_roi").otherwise("slide").alias("stem"), F.format_string("f%d", "id").alias("path"))
    got = {tuple(r) for r in RU.match_names(files, images).groupBy("candidates", "image_id", "status").agg(F.count(F.lit(1))).collect()}
    assert got == {(n - 1, None, "problem", n - 1), (1, 7, "pair", 1)}

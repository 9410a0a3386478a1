"""Reports on manifests as samples, for several ways to ask."""

from tilequarry.operators import samples as SA

CROP = "tile_path string, image_id string, x string, y string, label string, size string, mpp string, roi_id string"
MODES = {"all": (None, None), "fine": ([0.5], None), "both": ([0.5, 1.0], ["a"])}


def crop(path, mpp, x="0", label="a"):
    return (path, "1", x, "0", label, "32", mpp, "")


def reports(spark, rows):
    return {r["mode"]: tuple(r)[1:] for r in SA.sample_reports(spark.createDataFrame(rows, CROP), MODES).collect()}


def test_reports_of_odd_rows(spark):
    rows = [crop("t_x0_y0_mpp0.5.png", "0.5"), crop("u_x0_y0_mpp0.5.png", "0.5"), crop("t_x0_y0_mpp1.0.png", "1.0"), crop("t_x9_y0_mpp0.5.png", "0.5", "9", "b")]
    rows += [crop("t_x7_y0_mpp2.0.png", "2.0", "7"), crop("plain.png", "0.5"), crop("plain2.png", "1.0", label=None), crop("", "0.5"), crop(None, "0.5", label="b")]
    # coords_only, other_classes, singles, places, repeated, incomplete, scale_sets, singles_left_out, conflict
    assert reports(spark, rows) == {
        "all": (2, 0, 2, 3, 1, 0, 3, 0, "single crops beside crops at several scales"),
        "fine": (2, 0, 1, 2, 1, 0, 1, 0, None),
        "both": (2, 1, 1, 1, 1, 0, 1, 1, None),
    }


def test_reports_of_no_rows(spark):
    assert reports(spark, []) == dict.fromkeys(MODES, (0,) * 8 + (None,))


def test_ways_to_ask_share_one_pass_and_files_are_not_moved(spark, tmp_path):
    path = f"{tmp_path}/crops"
    spark.createDataFrame([crop("t_x0_y0_mpp0.5.png", "0.5")], CROP).write.parquet(path)
    plan = SA.sample_reports(spark.read.parquet(path), MODES)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    assert not any("tile_path" in x for x in plan.split("\n") if "Aggregate" in x)

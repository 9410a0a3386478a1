"""Manifest rows as training samples: crops of one place at several scales, and what forbids reading them together.

A row's file name says whether it is one crop of several (`_x<x>_y<y>_mpp<mpp>`, the place being the row's own). Crops of one
place, label and size are one sample, the finest first; of two crops at one scale the first in the manifest's order stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalog import has_scale

# How the file name of one of several crops ends.
SCALED_NAME = r"_x(-?\d+)_y(-?\d+)_mpp([0-9.eE+-]+)\.[A-Za-z0-9]+$"
PLACE = ["image_id", "x", "y", "label", "size"]


def numbered(rows: DataFrame) -> DataFrame:
    """Rows with numbers, and `kind`: multi (one crop of several), single, or none for a row without a file."""
    number = lambda c, kind: F.col(c).try_cast(kind)
    named = lambda k: F.regexp_extract("tile_path", SCALED_NAME, k).try_cast("long")
    t = rows.withColumn("mpp", F.coalesce(number("mpp", "double"), F.lit("NaN").cast("double"))).withColumn("roi_id", F.coalesce(number("roi_id", "long"), F.lit(-1)))
    t = t.withColumns({c: number(c, "long") for c in ("image_id", "x", "y", "size")})
    multi = (named(1) == F.col("x")) & (named(2) == F.col("y"))
    return t.withColumn("kind", F.when(F.length(F.coalesce("tile_path", F.lit(""))) == 0, "none").when(multi, "multi").otherwise("single"))


def is_wanted(scales: list[float] | None, mpp: Column) -> Column:
    return F.lit(True) if scales is None else has_scale(F.array(*[F.lit(float(s)) for s in scales]), mpp)


def typed(rows: DataFrame, scales: list[float] | None, classes: list[str] | None) -> DataFrame:
    """Rows that are read at all, with numbers, `kind` (single or multi) and whether their scale is `wanted`."""
    t = numbered(rows).where("kind <> 'none'")
    if classes is not None:
        t = t.where(F.col("label").isin(classes))
    return t.withColumn("wanted", is_wanted(scales, F.col("mpp")))


def crops(t: DataFrame, order: Column) -> DataFrame:
    """One row for each place: its crops by scale, and how many rows repeated one."""
    first = t.where("kind = 'multi' AND wanted").groupBy(*PLACE, "mpp")
    first = first.agg(F.min_by(F.struct("tile_path", "roi_id"), order).alias("row"), (F.count(F.lit(1)) - 1).alias("again"))
    held = F.array_sort(F.collect_list(F.struct("mpp", "row.tile_path", "row.roi_id")))
    return first.groupBy(*PLACE).agg(held.alias("crops"), F.sum("again").alias("again"))


def sample_reports(rows: DataFrame, modes: dict[str, tuple[list[float] | None, list[str] | None]]) -> DataFrame:
    """The report of sample_report for each mode (scales, classes), all of them from one pass over rows: adds `mode`.

    What is moved is a place's scales and counts, not its files.
    """
    several, n_rows = F.col("kind") == "multi", F.col("n")
    t = numbered(rows).select("kind", *[F.col(c) if c == "label" else F.when(several, F.col(c)).alias(c) for c in PLACE], "mpp")
    held = t.groupBy("kind", *PLACE, "mpp").agg(F.count(F.lit(1)).alias("n"))
    asked = [F.sum(F.when(is_wanted(s, F.col("mpp")), n_rows).otherwise(0)).alias(f"n{i}") for i, (s, _) in enumerate(modes.values())]
    # Rows that are no crops of places are only counted.
    held = held.groupBy("kind", *PLACE).agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.when(several, F.col("mpp")))).alias("all"), *asked)

    def view(i: int, mode: str, scales: list[float] | None, classes: list[str] | None) -> Column:
        found = F.col("all") if scales is None else F.filter("all", lambda m: is_wanted(scales, m))
        inside = F.lit(True) if classes is None else F.col("label").isin(classes)
        return F.struct(F.lit(mode).alias("mode"), F.col(f"n{i}").alias("wanted"), found.alias("scales"), inside.alias("inside"), F.lit(-1 if scales is None else len(scales)).alias("due"))

    s = held.select("kind", "n", F.explode(F.array(*[view(i, m, *ask) for i, (m, ask) in enumerate(modes.items())])).alias("v")).select("kind", "n", "v.*")
    place = several & F.col("inside") & (F.size("scales") > 0)
    told = s.groupBy("mode").agg(
        F.sum(F.when(F.col("kind") == "none", n_rows)).alias("coords_only"),
        F.sum(F.when((F.col("kind") != "none") & ~F.col("inside"), n_rows)).alias("other_classes"),
        F.sum(F.when((F.col("kind") == "single") & F.col("inside"), F.col("wanted"))).alias("singles"),
        F.count_if(place).alias("places"),
        F.sum(F.when(place, F.col("wanted") - F.size("scales"))).alias("repeated"),
        F.count_if(place & (F.col("due") >= 0) & (F.size("scales") != F.col("due"))).alias("incomplete"),
        F.count_distinct(F.when(place, F.array_join(F.transform("scales", lambda m: m.cast("string")), ","))).alias("scale_sets"),
    )
    # A manifest without rows has a report too.
    every = rows.sparkSession.range(1).select(F.explode(F.array(*[F.lit(m) for m in modes])).alias("mode"))
    counts = [c for c in told.columns if c != "mode"]
    out = every.join(told, "mode", "left").select("mode", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts])
    mixed = (F.col("places") > 0) & (F.col("singles") > 0)
    free, choosy = ([m for m, (s, _) in modes.items() if wanted(s)] for wanted in (lambda s: s is None, lambda s: s is not None and len(s) > 1))
    conflict = F.when(mixed, "single crops beside crops at several scales").when(F.col("scale_sets") > 1, "places with different scales")
    out = out.withColumn("singles_left_out", F.when(F.col("mode").isin(choosy) & mixed, F.col("singles")).otherwise(0).cast("long"))
    return out.withColumn("conflict", F.when(F.col("mode").isin(free), conflict))


def sample_report(rows: DataFrame, order: Column, scales: list[float] | None = None, classes: list[str] | None = None) -> DataFrame:
    """One row: what is left out and why, and `conflict`, the reason why the manifest can't be read so (null if it can)."""
    return sample_reports(rows, {"": (scales, classes)}).drop("mode")


def read_samples(rows: DataFrame, order: Column, scales: list[float] | None = None, classes: list[str] | None = None) -> DataFrame:
    """Samples: image_id, x, y, label, size, roi_id, mpp and image of the finest crop, the other `images`, and `scales` (null for one crop).

    Raises ValueError where single crops and several scales, or places with different scales, are mixed and
    scales does not choose. order is the manifest's own order of rows.
    """
    report = sample_report(rows, order, scales, classes).first()
    if report["conflict"]:
        raise ValueError(f"the manifest holds {report['conflict']}; choose scales")
    t = typed(rows, scales, classes)
    columns = [*PLACE, "roi_id", "mpp", "image", "images", "scales"]
    none = F.array().cast("array<string>")
    single = t.where("kind = 'single' AND wanted").select(*PLACE, "roi_id", "mpp", F.col("tile_path").alias("image"), none.alias("images"), F.lit(None).cast("array<double>").alias("scales"))
    held = crops(t, order)
    if scales is not None:
        held = held.where(F.size("crops") == len(scales))
    finest = F.get("crops", F.lit(0))
    several = F.size("crops") > 1
    rest = F.transform(F.slice("crops", 2, F.greatest(F.lit(1), F.size("crops"))), lambda c: c["tile_path"])
    multi = held.select(*PLACE, finest["roi_id"].alias("roi_id"), finest["mpp"].alias("mpp"), finest["tile_path"].alias("image"), rest.alias("images"), F.when(several, F.transform("crops", lambda c: c["mpp"])).alias("scales"))
    keep_single = scales is None or len(scales) <= 1 or not report["places"]
    return multi.select(*columns).unionByName(single.select(*columns)) if keep_single else multi.select(*columns)

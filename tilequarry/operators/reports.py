"""Reports on a run: classes and ROIs of a slide, with those that got nothing, and why slides failed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a drop is called in a report.
NAMES = {"dropped_no_tissue": "no tissue", "dropped_excluded": "exclusion", "dropped_roi_edge": "edge of a ROI", "dropped_unlabeled": "no label"}


def slide_report(tiles: DataFrame, kept: DataFrame) -> DataFrame:
    """(image_id, name, kept, available) for each outcome of a slide: its tiles, and those kept after the caps; drops keep none."""
    names = F.coalesce(*[F.when(F.col("outcome") == k, v) for k, v in NAMES.items()], F.col("outcome"))
    counts = tiles.groupBy("image_id", "outcome").agg(F.count(F.lit(1)).alias("available"))
    counts = counts.join(kept.groupBy("image_id", "outcome").agg(F.count(F.lit(1)).alias("kept")), ["image_id", "outcome"], "left")
    return counts.select("image_id", names.alias("name"), F.coalesce("kept", F.lit(0)).cast("long").alias("kept"), "available")


def roi_report(rois: DataFrame, tiles: DataFrame) -> DataFrame:
    """(image_id, roi_id, tiles, empty) for every ROI, those without a tile included."""
    n = tiles.groupBy("image_id", "roi_id").agg(F.count(F.lit(1)).alias("tiles"))
    out = rois.select("image_id", "roi_id").distinct().join(n, ["image_id", "roi_id"], "left")
    return out.select("image_id", "roi_id", F.coalesce("tiles", F.lit(0)).cast("long").alias("tiles"), F.col("tiles").isNull().alias("empty"))


def failure_type(reason: Column) -> Column:
    """The word before a colon, where a reason begins with one; else the reason."""
    reason = F.coalesce(F.nullif(reason, F.lit("")), F.lit("unknown"))
    head = F.substring_index(reason, ":", 1)
    return F.when(F.contains(reason, F.lit(":")) & (F.length(head) > 0) & ~F.contains(head, F.lit(" ")), head).otherwise(reason)


def failure_reasons(results: DataFrame, top: int = 5) -> DataFrame:
    """(what, name, n): failures by type, the top reasons, and how many other reasons there are. Ties go by name."""
    failed = results.where("status = 'failed'").select(F.coalesce(F.nullif("reason", F.lit("")), F.lit("unknown")).alias("reason"))
    reasons = failed.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    types = reasons.groupBy(failure_type(F.col("reason")).alias("name")).agg(F.sum("n").alias("n"))
    best = reasons.orderBy(F.desc("n"), "reason").limit(top)
    rest = reasons.agg(F.greatest(F.lit(0), F.count(F.lit(1)) - top).alias("n")).where("n > 0")
    out = types.select(F.lit("type").alias("what"), "name", "n").unionByName(best.select(F.lit("reason").alias("what"), F.col("reason").alias("name"), "n"))
    return out.unionByName(rest.select(F.lit("others").alias("what"), F.lit("").alias("name"), "n"))

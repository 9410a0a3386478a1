"""Tables of jobs: what was written for each is read, contradictions are named, and what was left open is settled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rings import bound

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
#: What holds where a job says nothing.
BACKGROUND = "benign"
MPP = 0.5


def number(text: Column) -> Column:
    """A decimal number, else null."""
    t = F.trim(text)
    return F.when(t.rlike(NUMBER), t.try_cast("double"))


def scales(text: Column) -> Column:
    """(values, reason) of a list such as `0.5,1.0`: distinct numbers above zero, ascending; null text has neither."""
    parts = F.filter(F.split(text, ","), lambda t: F.length(F.trim(t)) > 0)

    def judged(v: Column) -> Column:
        reason = F.when(F.exists(v, lambda x: x.isNull()), "scale is no number").when(F.size(v) == 0, "no scale")
        reason = reason.when(F.exists(v, lambda x: x <= 0), "scale is not positive").when(F.size(F.array_distinct(v)) < F.size(v), "scale is repeated")
        return F.struct(F.when(reason.isNull(), F.array_sort(v)).alias("values"), reason.alias("reason"))

    return F.when(text.isNotNull(), bound(F.transform(parts, number), judged))


def erode(text: Column) -> Column:
    """(um, reason): micrometres of zero or more; `auto` and null text leave both null."""
    value = number(text)
    reason = F.when(text.isNull() | (F.lower(F.trim(text)) == "auto"), None).when(value.isNull(), "erosion is no number").when(value < 0, "erosion is below zero")
    return F.struct(F.when(reason.isNull(), value).alias("um"), reason.alias("reason"))


def settled(jobs: DataFrame) -> DataFrame:
    """Adds reason (the first rule that a job breaks, else null) and, where there is none, overlap_px, mpp, values, erode_um and background.

    jobs: whole, include_all, no_background (boolean), texts (array), size, stride, overlap (integers), min_coverage, tissue_thresh, scales, erode and
    background_label. Null booleans are false, null lists empty, a null overlap 0; a stride stands before an overlap.
    """
    c = {n: F.coalesce(n, F.lit(False)) for n in ("whole", "include_all", "no_background")}
    given = F.coalesce(F.size("texts"), F.lit(-1)) > 0
    overlap = F.when(F.col("stride").isNotNull(), F.col("size") - F.col("stride")).otherwise(F.coalesce("overlap", F.lit(0)))
    s, e = F.col("_s"), F.col("_e")
    outside = lambda n: ~F.coalesce(F.col(n).between(0, 1), F.lit(False))
    reason = (
        F.when(c["whole"] & (c["include_all"] | given), "annotations are not read for whole slides")
        .when(c["whole"] & (F.col("background_label").isNotNull() | F.col("erode").isNotNull() | c["no_background"]), "whole slides have no background")
        .when(~c["whole"] & c["include_all"] & given, "all annotations and a list of them")
        .when(~c["whole"] & ~c["include_all"] & ~given, "no annotations chosen")
        .when(c["no_background"] & F.col("background_label").isNotNull(), "a background that is turned off")
        .when(~F.coalesce(F.col("size") > 0, F.lit(False)), "size is not positive")
        .when(F.col("stride").isNotNull() & ~F.col("stride").between(1, F.col("size")), "stride is not within the size")
        .when((overlap < 0) | (overlap >= F.col("size")), "overlap is not below the size")
        .when(outside("min_coverage") | outside("tissue_thresh"), "fraction is not within 0 and 1")
        .otherwise(F.coalesce(s["reason"], e["reason"]))
    )
    out = jobs.withColumn("_s", scales(F.col("scales"))).withColumn("_e", erode(F.col("erode"))).withColumn("reason", reason)
    ok = F.col("reason").isNull()
    kept = {
        "overlap_px": overlap,
        "mpp": F.coalesce(F.get(s["values"], F.lit(0)), F.lit(MPP)),
        "values": F.when(F.size(s["values"]) > 1, s["values"]),
        "erode_um": F.when(c["whole"], 0.0).otherwise(e["um"]),
        "background": F.when(~(c["whole"] | c["no_background"]), F.coalesce("background_label", F.lit(BACKGROUND))),
    }
    return out.select("*", *[F.when(ok, v).alias(n) for n, v in kept.items()]).drop("_s", "_e")


def segments(templates: DataFrame, label: str | None = None) -> DataFrame:
    """(template_id, number, label, algorithm) of every template's array `segments` (label, algorithm), numbered from 1.

    A label replaces the first one's; a segment without a label is named by its number. A template without segments has one row without a number.
    """
    s = templates.select("template_id", F.posexplode_outer("segments").alias("i", "s")).withColumn("number", F.col("i") + 1)
    name = F.coalesce(F.col("s.label"), F.concat(F.lit("Segment "), F.col("number").cast("string")))
    first = F.when(F.col("number") == 1, F.lit(label)).otherwise(F.lit(None).cast("string"))
    shown = F.when(F.col("number").isNotNull(), F.coalesce(first, name))
    return s.select("template_id", "number", shown.alias("label"), F.when(F.col("number").isNotNull(), F.coalesce("s.algorithm", F.lit("MANUAL"))).alias("algorithm"))

"""Which images, levels, regions and names a job works on: scalar rules over catalogue rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: File extensions and their media types.
MEDIA_TYPES = {"jp2": "image/jp2", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "tif": "image/tiff", "tiff": "image/tiff"}


def select_images(images: DataFrame, links: DataFrame | None = None, *, image: int | None = None, dataset: int | None = None, project: int | None = None, group: int | None = None) -> DataFrame:
    """Images by exactly one of image, dataset, project or group. links: (image_id, dataset_id, project_id), an image may be linked more than once."""
    given = {k: v for k, v in (("image_id", image), ("dataset_id", dataset), ("project_id", project), ("group_id", group)) if v is not None}
    if len(given) != 1:
        raise ValueError("an image, a dataset, a project or a group is needed, and only one of them")
    ((column, value),) = given.items()
    if column in ("image_id", "group_id"):
        return images.where(F.col(column) == value)
    if links is None:
        raise ValueError("datasets and projects need links")
    return images.join(links.where(F.col(column) == value).select("image_id").distinct(), "image_id", "left_semi")


def pixel_size(text: Column) -> Column:
    """A pixel size that can be used: a number above zero, else null."""
    size = text.try_cast("double")
    return F.when(size > 0, size)


def reduced(size: Column, factor: float) -> Column:
    """A side at 1 / factor, one pixel at least."""
    return F.greatest(F.lit(1.0), F.rint(size / factor)).cast("long")


def whole_image_level(levels: DataFrame, factor: float) -> DataFrame:
    """The smallest level, reached from the full one on, that has both sides of the image at 1 / factor; level 0 if none does."""
    enough = (F.col("width") >= reduced(F.col("width0"), factor)) & (F.col("height") >= reduced(F.col("height0"), factor))
    ordered = F.array_sort(F.collect_list(F.struct("idx", enough.alias("ok"), "width", "height")))
    held = levels.groupBy("image_id", "width0", "height0").agg(ordered.alias("l"))
    stop = F.coalesce(F.array_min(F.transform(F.filter("l", lambda x: ~x["ok"]), lambda x: x["idx"])), F.lit(1 << 30))
    last = F.element_at(F.concat(F.slice("l", 1, 1), F.filter("l", lambda x: (x["idx"] < stop) & (x["idx"] > 0))), -1)
    return held.select("image_id", last["idx"].alias("level"), reduced(F.col("width0"), factor).alias("out_w"), reduced(F.col("height0"), factor).alias("out_h"))


def region_origin(at: Column, downsample: Column, extent: Column, size: Column) -> Column:
    """Where a region begins in a level: rounded, and moved back so that it lies inside."""
    return F.least(F.greatest(F.rint(at / downsample), F.lit(0.0)), F.greatest(extent - size, F.lit(0)).cast("double")).cast("long")


def output_mpp(requested: float | None, size: Column, downsample: Column) -> Column:
    """Micrometres per output pixel: what was asked for, else the pixel size at the downsample."""
    return F.lit(requested) if requested is not None else F.when(size > 0, size * downsample)


def level_scale(size: Column, width0: Column, width: Column, objective: Column) -> Column:
    """(mpp, power) of a level; a missing or unusable pixel size or power stays null."""
    ratio = width0 / width
    return F.struct(F.when(size > 0, size * ratio).alias("mpp"), F.when(objective > 0, objective / ratio).alias("power"))


def extension(path: Column) -> Column:
    """The lower-cased extension of a path's last part, '' if it has none."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*\.([^./]*)$", 1))


def media_type(ext: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in MEDIA_TYPES.items() for x in pair])
    return F.coalesce(F.get(F.array(known[ext]), F.lit(0)), F.lit("application/octet-stream"))


def rebase(path: Column, root: str, target: str) -> Column:
    """A path below root as one relative to target; both roots are absolute."""
    a, b = [[x for x in p.split("/") if x] for p in (target, root)]
    same = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    lead = "/".join([".."] * (len(a) - same) + b[same:])
    return F.concat(F.lit(f"{lead}/" if lead else ""), path)


def has_scale(scales: Column, wanted: Column) -> Column:
    """Whether one of the scales is the wanted one, to a millionth."""
    return F.exists(scales, lambda s: F.abs(s - wanted) <= 1e-6 * F.greatest(F.abs(s), F.abs(wanted)))


#: Texts of the shares of 64 pixels, which all have six places at most.
SHARES = [str(k / 64) for k in range(65)]


def share_text(share: Column) -> Column:
    """A share rounded to six places as text. Shares of 64 pixels are looked up, as rounding and printing doubles take most of a row's time."""
    of_64 = share.cast("double") * 64
    place = of_64.try_cast("int")
    return F.when((of_64 == place) & place.between(0, 64), F.get(F.array(*[F.lit(t) for t in SHARES]), place)).otherwise(F.coalesce(F.round(share, 6).cast("string"), F.lit("")))


def manifest_rows(tiles: DataFrame, size: int, mpp: Column, level: Column, tier: Column) -> DataFrame:
    """The 19 columns of a manifest as text, null as blank. tiles: label, coverage, tissue_frac, roi_id, shape_id, case_id, slide_id, x0, y0, w0, h0 and grid place."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    place = F.concat_ws("/", "case_id", "label", F.concat_ws("_", "slide_id", F.concat(F.lit("x"), F.col("x0")), F.concat(F.lit("y"), F.col("y0"))))
    plain = {"image_id": "image_id", "case_id": "case_id", "slide_id": "slide_id", "roi_id": "roi_id", "label": "label"}
    return tiles.select(
        place.alias("tile_path"),
        *[text(F.col(c)).alias(n) for n, c in plain.items()],
        text(F.expr("x0 + w0 div 2")).alias("x"),
        text(F.expr("y0 + h0 div 2")).alias("y"),
        text(F.round(mpp, 6)).alias("mpp"),
        F.lit(str(size)).alias("size"),
        *[text(F.col(c)).alias(c) for c in ("shape_id", "x0", "y0", "w0", "h0")],
        text(level).alias("level"),
        share_text(F.col("coverage")).alias("coverage"),
        share_text(F.col("tissue_frac")).alias("tissue_frac"),
        text(tier).alias("tier"),
    )

"""Queries over catalogue rules, shapes as points and pixels, and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as C
from ..operators import reports as P
from ..operators import shapes as S
from ..operators import tiles as T
from ..sources import config
from . import derived as D
from .manifest_queries import RESULT, results
from .raster_queries import mask
from .registry import registry
from .tile_queries import ALL_LABELLED, PARAMS, SCALED, grid_sql, labelled

QUERIES, ORACLES, query = registry()


def links(spark, sf):
    """Images in two data sets each, data sets in projects."""
    i = D.slides(spark, sf).select("image_id", F.explode(F.array(F.col("image_id") % 20, F.col("image_id") % 7 + 20)).alias("dataset_id"))
    return i.withColumn("project_id", F.col("dataset_id") % 4)


@query(D.with_base("SELECT image_id, image_name FROM slides WHERE (image_id % 20) % 4 = 3 OR (image_id % 7 + 20) % 4 = 3", "slides"))
def images_of_project(spark, sf):
    return C.select_images(D.slides(spark, sf), links(spark, sf), project=3).select("image_id", "image_name")


@query(D.with_base("SELECT image_id, image_name FROM slides WHERE image_id % 20 = 5", "slides"))
def images_of_dataset(spark, sf):
    return C.select_images(D.slides(spark, sf), links(spark, sf), dataset=5).select("image_id", "image_name")


@query(D.with_base("SELECT image_id, image_name FROM slides WHERE group_id = 1", "slides"))
def images_of_group(spark, sf):
    return C.select_images(D.slides(spark, sf), group=1).select("image_id", "image_name")


@query(D.with_base("SELECT image_id, image_name FROM slides WHERE image_id = 17", "slides"))
def image_lookup(spark, sf):
    return C.select_images(D.slides(spark, sf), image=17).select("image_id", "image_name")


@query("SELECT c_custkey, CASE WHEN c_acctbal > 0 AND c_custkey % 3 <> 0 THEN c_acctbal END AS size FROM customer")
def pixel_size_sanitised(spark, sf):
    text = F.when(F.col("c_custkey") % 3 == 0, "n/a").otherwise(F.col("c_acctbal").cast("string"))
    return D.table(spark, sf, "customer").select("c_custkey", C.pixel_size(text).alias("size"))


@query(
    D.with_base(
        """SELECT image_id, max(idx) FILTER (ok OR idx = 0) AS level, any_value(greatest(1, round_even(width0 / 3, 0)))::BIGINT AS out_w, any_value(greatest(1, round_even(height0 / 3, 0)))::BIGINT AS out_h
FROM (SELECT *, bool_and(width >= greatest(1, round_even(width0 / 3, 0)) AND height >= greatest(1, round_even(height0 / 3, 0))) OVER (PARTITION BY image_id ORDER BY idx) AS ok FROM levels) GROUP BY image_id""",
        "slides",
        "levels",
    )
)
def whole_image_level(spark, sf):
    return C.whole_image_level(D.levels(spark, sf), 3)


@query(D.with_base("SELECT shape_id, idx, least(greatest(round_even(x / (width0 / width), 0), 0), greatest(width - 64, 0))::BIGINT AS x, least(greatest(round_even(y / (height0 / height), 0), 0), greatest(height - 64, 0))::BIGINT AS y FROM shapes JOIN levels USING (image_id)", "slides", "levels", "shapes"))
def region_windows(spark, sf):
    j = D.shapes(spark, sf).join(D.levels(spark, sf), "image_id")
    at = lambda v, full, own: C.region_origin(F.col(v), F.col(full) / F.col(own), F.col(own), F.lit(64)).alias(v)
    return j.select("shape_id", "idx", at("x", "width0", "width"), at("y", "height0", "height"))


@query(D.with_base("SELECT image_id, idx, pixel_size * (width0 / width) AS mpp, 40 / (width0 / width) AS power, pixel_size * 2 AS out_mpp FROM levels", "slides", "levels"))
def level_scales(spark, sf):
    v = D.levels(spark, sf).withColumn("s", C.level_scale(F.col("pixel_size"), F.col("width0"), F.col("width"), F.lit(40.0)))
    return v.select("image_id", "idx", "s.mpp", "s.power", C.output_mpp(None, F.col("pixel_size"), F.lit(2.0)).alias("out_mpp"))


@query("SELECT page_id, CASE WHEN page_id % 4 = 3 THEN '' ELSE CASE page_id % 4 WHEN 0 THEN 'png' WHEN 1 THEN 'jpeg' ELSE CASE WHEN page_id % 8 = 2 THEN 'jp2' ELSE 'xyz' END END END AS ext, CASE page_id % 4 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN CASE WHEN page_id % 8 = 2 THEN 'image/jp2' ELSE 'application/octet-stream' END ELSE 'application/octet-stream' END AS type, '../b/c/' || page_id AS path FROM pages")
def media_types(spark, sf):
    name = F.concat(F.lit("dir.v1/p"), F.col("page_id"), F.get(F.array(F.lit(".PNG"), F.lit(".tar.Jpeg"), F.when(F.col("page_id") % 8 == 2, ".JP2").otherwise(".xyz"), F.lit("")), (F.col("page_id") % 4).cast("int")))
    ext = C.extension(name)
    return D.table(spark, sf, "pages").select("page_id", ext.alias("ext"), C.media_type(ext).alias("type"), C.rebase(F.col("page_id").cast("string"), "/a/b/c", "/a/x").alias("path"))


@query("SELECT p_partkey, p_size % 3 = 0 OR p_size % 3 = 1 AS held FROM part")
def scale_membership(spark, sf):
    scales = F.array(F.lit(0.5), F.lit(1.0 + 4e-7), F.lit(3.0))
    wanted = F.when(F.col("p_size") % 3 == 0, 0.5).when(F.col("p_size") % 3 == 1, 1.0).otherwise(2.0)
    return D.table(spark, sf, "part").select("p_partkey", C.has_scale(scales, wanted).alias("held"))


@query(
    D.with_base(
        """SELECT (row_number() OVER (ORDER BY first) - 1)::INTEGER AS pos, label, r AS pr, g AS pg, b AS pb FROM (
  SELECT min(shape_id) AS first, arg_max(coalesce(text, ''), shape_id) AS label, r, g, b FROM shapes GROUP BY r, g, b)""",
        "slides",
        "shapes",
    )
)
def palette_config(spark, sf):
    """A palette from the shapes' colours, written alternately as hexadecimal text and as numbers; the last name of a colour stays, in its first place."""
    s = D.shapes(spark, sf)
    text = F.format_string("%s%02x%02X%02x", F.when(F.col("shape_id") % 3 == 0, "#").otherwise(""), "r", "g", "b")
    entries = s.select(F.col("shape_id").alias("pos"), F.coalesce("text", F.lit("")).alias("text"), F.when(F.col("shape_id") % 2 == 0, text).alias("hex"), F.when(F.col("shape_id") % 2 == 1, F.array("r", "g", "b")).alias("rgb"))
    return config.palette_of(entries)


@query("SELECT lower(trim(alias)) AS alias, arg_min(folder, c_custkey) AS folder FROM (SELECT c_custkey, ' ' || c_mktsegment || ' ' || c_nationkey % 7 AS alias, 'F' || c_custkey % 10 AS folder FROM customer) GROUP BY ALL")
def label_config(spark, sf):
    """The first folder that registers an alias has it."""
    c = D.table(spark, sf, "customer")
    alias = F.concat(F.lit(" "), "c_mktsegment", F.lit(" "), (F.col("c_nationkey") % 7).cast("string"))
    return config.label_map_of(c.select(F.col("c_custkey").alias("pos"), alias.alias("alias"), F.concat(F.lit("F"), F.col("c_custkey") % 10).alias("folder")))


@query(D.with_base("SELECT shape_id, (n + 4) // 5 AS points, fx, fy FROM (SELECT shape_id, 2 * (bw // 4 + 1) + 2 * (bh // 4 + 1) AS n, (x // 4)::DOUBLE AS fx, (y // 4)::DOUBLE AS fy FROM shapes)", "slides", "shapes"))
def boundary_points(spark, sf):
    """Every fifth pixel of each box's border at a quarter of the size, from its first corner."""
    s = D.shapes(spark, sf).join(D.slides(spark, sf).select("image_id", "width0", "height0"), "image_id")
    q = s.selectExpr("shape_id", "x div 4 AS x", "y div 4 AS y", "bw div 4 AS w", "bh div 4 AS h", "width0 div 4 AS iw", "height0 div 4 AS ih")
    p = S.thin(S.rectangle_perimeter(*[F.col(c) for c in ("x", "y", "w", "h", "iw", "ih")]), 5)
    return q.withColumn("p", p).select("shape_id", F.size("p").cast("long").alias("points"), F.col("p")[0]["x"].alias("fx"), F.col("p")[0]["y"].alias("fy"))


@query(D.with_base("SELECT shape_id, CASE shape_id % 4 WHEN 0 THEN shape_id % 5 >= 3 WHEN 1 THEN shape_id % 5 >= 2 WHEN 2 THEN shape_id % 5 >= 1 ELSE false END AS ok FROM shapes", "slides", "shapes"))
def degenerate_geometry(spark, sf):
    kind = F.get(F.array(*[F.lit(k) for k in ("polygon", "polyline", "point", "label")]), (F.col("shape_id") % 4).cast("int"))
    points = F.slice(F.array(*[S.point(F.lit(i), F.lit(i)) for i in range(5)]), 1, (F.col("shape_id") % 5).cast("int"))
    return D.shapes(spark, sf).select("shape_id", S.usable(kind, points).alias("ok"))


#: Each box's diamond, and a keyhole: the box with a bridged hole in its middle; at a sixteenth.
RINGS = """rings AS (
  SELECT image_id, shape_id, x / 16 AS x, y / 16 AS y, bw / 16 AS w, bh / 16 AS h FROM shapes
), corners AS (
  SELECT image_id, shape_id, i, CASE WHEN shape_id % 2 = 0 THEN [x + w / 2, x + w, x + w / 2, x][i + 1]
      ELSE [x, x + w, x + w, x, x, x + w / 4, x + w / 4, x + w / 2, x + w / 2, x + w / 4, x][i + 1] END AS px,
    CASE WHEN shape_id % 2 = 0 THEN [y, y + h / 2, y + h, y + h / 2][i + 1]
      ELSE [y, y, y + h, y + h, y, y + h / 4, y + h / 2, y + h / 2, y + h / 4, y + h / 4, y][i + 1] END AS py,
    CASE WHEN shape_id % 2 = 0 THEN 4 ELSE 11 END AS n
  FROM rings, unnest(range(11)) AS t(i) WHERE i < 4 OR shape_id % 2 = 1
), edges AS (
  SELECT a.image_id, a.shape_id, a.px AS ax, a.py AS ay, b.px AS bx, b.py AS by_ FROM corners a JOIN corners b ON a.shape_id = b.shape_id AND b.i = (a.i + 1) % a.n
), crossed AS (
  SELECT image_id, shape_id, yy, ax + (yy - ay) * (bx - ax) / (by_ - ay) AS xx
  FROM (SELECT *, unnest(range(ceil(least(ay, by_))::BIGINT, ceil(greatest(ay, by_))::BIGINT)) AS yy FROM edges)
), spans AS (
  SELECT image_id, shape_id, yy, ceil(xx)::BIGINT AS a, ceil(lead(xx) OVER w)::BIGINT AS b, row_number() OVER w AS k FROM crossed WINDOW w AS (PARTITION BY shape_id, yy ORDER BY xx)
), filled AS (SELECT image_id, shape_id, yy AS y, unnest(range(a, b)) AS x FROM spans WHERE k % 2 = 1)"""


def rings(spark, sf):
    s = D.shapes(spark, sf).selectExpr("image_id", "shape_id", "r", "g", "b", "x / 16 AS x", "y / 16 AS y", "bw / 16 AS w", "bh / 16 AS h")
    x, y, w, h = (F.col(c) for c in "xywh")
    diamond = [(x + w / 2, y), (x + w, y + h / 2), (x + w / 2, y + h), (x, y + h / 2)]
    keyhole = [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y), (x + w / 4, y + h / 4), (x + w / 4, y + h / 2), (x + w / 2, y + h / 2), (x + w / 2, y + h / 4), (x + w / 4, y + h / 4), (x, y)]
    made = [F.array(*[S.point(a, b) for a, b in ring]) for ring in (diamond, keyhole)]
    return s.withColumn("ring", F.when(F.col("shape_id") % 2 == 0, made[0]).otherwise(made[1]))


@query(D.with_base("SELECT image_id, shape_id, count(*) AS pixels, sum(x)::BIGINT AS sx, sum(y)::BIGINT AS sy FROM filled GROUP BY ALL", "slides", "shapes", RINGS))
def ring_fill(spark, sf):
    """Even-odd fill of diamonds and of boxes with a bridged hole."""
    f = S.fill(rings(spark, sf), "ring", "image_id", "shape_id")
    return f.groupBy("image_id", "shape_id").agg(F.count(F.lit(1)).alias("pixels"), F.sum("x").alias("sx"), F.sum("y").alias("sy"))


@query(
    D.with_base(
        "SELECT image_id, r, g, b, count(*) AS pixels FROM (SELECT f.image_id, y, x, arg_max({'r': r, 'g': g, 'b': b}, f.shape_id) AS v FROM (SELECT image_id, shape_id, y, x FROM filled) f "
        "JOIN (SELECT shape_id, r, g, b FROM shapes) s USING (shape_id) GROUP BY ALL), (SELECT unnest([0]) AS z), LATERAL (SELECT v.r AS r, v.g AS g, v.b AS b) GROUP BY ALL",
        "slides",
        "shapes",
        RINGS,
    )
)
def mask_rgb(spark, sf):
    """Colours of a mask as pixel counts; the later shape owns a shared pixel, and what no shape has stays white."""
    shapes = rings(spark, sf)
    # The colour rides below the shape's number in one whole number, so that the greatest is the later shape's.
    spans = shapes.select("image_id", (F.col("shape_id") * (1 << 24) + F.col("r") * 65536 + F.col("g") * 256 + F.col("b")).alias("code"), F.explode(S.ring_spans(F.col("ring"))).alias("s")).select("image_id", "code", "s.*")
    m = S.row_owners(spans, "code", T.tasks_of(shapes)).groupBy("image_id", F.expr("code & 16777215").alias("c")).agg(F.count(F.lit(1)).alias("pixels"))
    return m.select("image_id", *[F.expr(f"cast(shiftright(c, {n}) & 255 AS int)").alias(k) for k, n in (("r", 16), ("g", 8), ("b", 0))], "pixels")


@query(D.with_base("SELECT image_id, shape_id FROM shapes WHERE shape_id IN (SELECT shape_id FROM filled)", "slides", "shapes", RINGS))
def ids_in_mask(spark, sf):
    """Shapes that own or share a pixel of the mask."""
    return S.filled(rings(spark, sf), "ring").select("image_id", "shape_id")


@query(D.with_base("SELECT image_id, count(DISTINCT shape_id) AS shapes FROM filled GROUP BY image_id", "slides", "shapes", RINGS))
def rendered_shapes(spark, sf):
    return S.filled(rings(spark, sf), "ring").groupBy("image_id").agg(F.count_distinct("shape_id").alias("shapes"))


@query(D.with_base("SELECT image_id, roi_id, arg_min(text, shape_id) FILTER (length(trim(text)) > 0) AS label, any_value(n) AS n FROM (SELECT *, count(*) OVER (PARTITION BY image_id, roi_id) AS n FROM shapes) GROUP BY ALL", "slides", "shapes"))
def first_label(spark, sf):
    held = F.array_sort(F.collect_list(F.struct("shape_id", "text")))
    g = D.shapes(spark, sf).groupBy("image_id", "roi_id").agg(held.alias("h"), F.count(F.lit(1)).alias("n"))
    return g.select("image_id", "roi_id", S.first_given(F.transform("h", lambda x: x["text"])).alias("label"), "n")


@query(
    D.with_base(
        """SELECT shape_id, CASE WHEN k % 6 IN (0, 1, 2) THEN 'polygon' WHEN k % 6 = 3 THEN 'polyline' WHEN k % 6 = 4 THEN 'point' END AS kind, [5, 64, 4, 3, 1, NULL][(k % 6)::INTEGER + 1]::INTEGER AS points,
  CASE k % 6 WHEN 1 THEN round(x + bw / 2, 2) WHEN 5 THEN NULL ELSE x END::DOUBLE AS fx,
  CASE k % 6 WHEN 0 THEN y WHEN 1 THEN round(y + bh / 2 * sin(2 * pi() * 63 / 64), 2) WHEN 2 THEN y + bh WHEN 3 THEN y + bh WHEN 4 THEN y END::DOUBLE AS ly, 'roi-' || roi_id AS source_id FROM shapes""",
        "slides",
        "shapes",
    )
)
def shape_specs(spark, sf):
    """What a server's shapes say, of all kinds; x, y are an ellipse's centre and w, h its radii."""
    kind = F.get(F.array(*[F.lit(k) for k in ("rectangle", "ellipse", "polygon", "polyline", "point", "label")]), (F.col("k") % 6).cast("int"))
    x, y, w, h = (F.col(c).cast("double") for c in ("x", "y", "bw", "bh"))
    corners = F.array(S.point(x, y), S.point(x + w, y), S.point(x + w, y + h), S.point(x, y + h))
    points = F.when(F.col("k") % 6 == 2, corners).when(F.col("k") % 6 == 3, F.concat(F.slice(corners, 1, 1), F.slice(corners, 3, 2)))
    round_ = F.col("k") % 6 == 1
    s = D.shapes(spark, sf).withColumn("s", S.shape_spec(kind, x, y, F.when(round_, w / 2).otherwise(w), F.when(round_, h / 2).otherwise(h), points))
    first, last = F.get("s.points", F.lit(0)), F.element_at("s.points", -1)
    return s.select("shape_id", "s.kind", F.when(F.col("s").isNotNull(), F.size("s.points")).alias("points"), first["x"].alias("fx"), last["y"].alias("ly"), F.concat(F.lit("roi-"), F.col("roi_id")).alias("source_id"))


KEPT = """kept AS (SELECT image_id, outcome FROM (
  SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY h) AS again FROM (
    SELECT *, row_number() OVER (PARTITION BY image_id, outcome ORDER BY h) AS place FROM (
      SELECT *, md5('7|' || image_id || '|' || col || '|' || row) AS h FROM labelled WHERE outcome NOT LIKE 'dropped%' AND outcome <> 'unannotated'))
  WHERE place <= CASE WHEN outcome = 'benign' THEN 5 ELSE 6 END) WHERE again <= 12)"""


@query(
    D.with_base(
        """SELECT image_id, CASE outcome WHEN 'dropped_no_tissue' THEN 'no tissue' WHEN 'dropped_excluded' THEN 'exclusion' WHEN 'dropped_unlabeled' THEN 'no label' ELSE outcome END AS name,
  coalesce(k, 0)::BIGINT AS kept, available FROM (SELECT image_id, outcome, count(*) AS available FROM labelled GROUP BY ALL) LEFT JOIN (SELECT image_id, outcome, count(*) AS k FROM kept GROUP BY ALL) USING (image_id, outcome)""",
        *ALL_LABELLED,
        KEPT,
    )
)
def slide_report(spark, sf):
    tiles = labelled(spark, sf)
    return P.slide_report(tiles, T.cap_labels(tiles.where("outcome NOT LIKE 'dropped%' AND outcome <> 'unannotated'").select("image_id", "col", "row", "outcome"), 6, "benign", 5, 12, 7))


@query(
    D.with_base(
        "SELECT image_id, roi_id, count(n) AS tiles, count(n) = 0 AS empty FROM (SELECT DISTINCT image_id, roi_id FROM shapes) LEFT JOIN "
        "(SELECT image_id, roi_id, col, row, count(DISTINCT (px, py)) AS n FROM pixels GROUP BY ALL HAVING count(DISTINCT (px, py)) >= 48) USING (image_id, roi_id) GROUP BY ALL",
        *ALL_LABELLED[:8],
    )
)
def roi_report(spark, sf):
    """Tiles of which a ROI covers three quarters, for every ROI."""
    shapes = D.shapes(spark, sf)
    c = T.covered(T.box_masks(shapes, T.scale(D.slides(spark, sf), PARAMS), PARAMS), "roi_id")
    return P.roi_report(shapes, c.where("px >= 48"))


@query(
    D.with_base(
        """SELECT 'type' AS what, CASE WHEN contains(reason, ':') AND NOT contains(split_part(reason, ':', 1), ' ') THEN split_part(reason, ':', 1) ELSE reason END AS name, count(*) AS n FROM results WHERE status = 'failed' GROUP BY 2
UNION ALL SELECT * FROM (SELECT 'reason', reason, count(*) AS n FROM results WHERE status = 'failed' GROUP BY reason ORDER BY n DESC, reason LIMIT 5)
UNION ALL SELECT 'others', '', count(DISTINCT reason) - 5 FROM results WHERE status = 'failed' HAVING count(DISTINCT reason) > 5""",
        "slides",
        RESULT,
    )
)
def failure_reasons(spark, sf):
    return P.failure_reasons(results(spark, sf))


@query("SELECT conv_id, turn, 1 + dense_rank() OVER (ORDER BY role) - 1 AS number, CASE WHEN role = 'assistant' THEN NULL ELSE role END AS segment, role = 'assistant' AS missing FROM conversations")
def segment_lookup(spark, sf):
    """Segments numbered from 1 by name, looked up by number; one without a record is reported."""
    c = D.table(spark, sf, "conversations")
    names = F.transform(F.array_sort(F.collect_set("role")), lambda n, i: F.struct((i + 1).cast("long").alias("number"), n.alias("name")))
    numbered = c.agg(names.alias("s")).select(F.explode("s").alias("s")).select("s.*")
    asked = c.join(F.broadcast(numbered), F.col("role") == F.col("name")).select("conv_id", "turn", "number")
    records = numbered.where("name <> 'assistant'").withColumnRenamed("name", "segment")
    return asked.join(F.broadcast(records), "number", "left").select("conv_id", "turn", "number", "segment", F.col("segment").isNull().alias("missing"))


@query("SELECT event_id, ((event_id) // (SELECT (count(*) + 6) // 7 FROM events))::BIGINT AS chunk FROM events")
def row_chunks(spark, sf):
    """Seven runs of rows of ceil(n / 7) each, by dense ids."""
    e = D.table(spark, sf, "events")
    return e.crossJoin(F.broadcast(e.agg(F.count(F.lit(1)).alias("n")))).select("event_id", F.expr("event_id div ((n + 6) div 7)").alias("chunk"))


@query(D.with_base("SELECT vec_id, (y // 4)::INTEGER AS y4, (x // 4)::INTEGER AS x4, count(*) FILTER (v > 0) AS set_pixels FROM thumbs GROUP BY ALL HAVING count(*) FILTER (v > 0) > 0", "thumbs"))
def downsample_whole(spark, sf):
    """A mask at a quarter, as set pixels of each output pixel."""
    return mask(spark, sf).groupBy("vec_id", F.expr("cast(y div 4 AS int)").alias("y4"), F.expr("cast(x div 4 AS int)").alias("x4")).agg(F.count(F.lit(1)).alias("set_pixels"))


@query(
    D.with_base(
        """SELECT coalesce(regexp_extract(image_name, '^N\\d+', 0), '') || '/' || outcome || '/' || split_part(image_name, '.', 1) || '_x' || x0 || '_y' || y0 AS tile_path, image_id::VARCHAR AS image_id,
  regexp_extract(image_name, '^N\\d+', 0) AS case_id, split_part(image_name, '.', 1) AS slide_id, '' AS roi_id, outcome AS label, (x0 + w0 // 2)::VARCHAR AS x, (y0 + h0 // 2)::VARCHAR AS y,
  '0.5' AS mpp, '32' AS size, '' AS shape_id, x0::VARCHAR AS x0, y0::VARCHAR AS y0, w0::VARCHAR AS w0, h0::VARCHAR AS h0, '0' AS level,
  (round(CASE WHEN outcome = f THEN n / 64 ELSE 0.0 END, 6)::DOUBLE)::VARCHAR AS coverage, round(tissue_frac, 6)::VARCHAR AS tissue_frac, 'local' AS tier
FROM labelled JOIN slides USING (image_id) WHERE outcome NOT LIKE 'dropped%' AND outcome <> 'unannotated'""",
        *ALL_LABELLED,
    )
)
def manifest_rows(spark, sf):
    # A slide's names are made once, before it becomes tiles.
    names = {"case_id": F.regexp_extract("image_name", r"^N\d+", 0), "slide_id": F.substring_index("image_name", ".", 1)}
    slides = D.slides(spark, sf).withColumns(names)
    kept = labelled(spark, sf, *names, slides=slides).where("outcome NOT LIKE 'dropped%' AND outcome <> 'unannotated'").withColumnRenamed("outcome", "label")
    none = F.lit(None).cast("long")
    return C.manifest_rows(kept.withColumn("roi_id", none).withColumn("shape_id", none), 32, F.lit(0.5), F.lit(0), F.lit("local"))

"""Queries over outlines of shapes, first colours, listed files and written parameters."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import jobs as J
from ..operators import outlines as O
from ..sources import files
from . import derived as D
from .registry import registry

QUERIES, ORACLES, query = registry()
#: Every fourth pixel at a quarter of the size. Shapes are boxes, ellipses around a box's corner, triangles and labels in turn.
OUTLINED = """picked AS (
  SELECT image_id, shape_id, shape_id % 4 AS kind, lower(text) AS label, x / 4 AS x, y / 4 AS y, bw / 4 AS w, bh / 4 AS h, width0 / 4 AS iw, height0 / 4 AS ih
  FROM shapes JOIN slides USING (image_id) WHERE lower(text) IN ('gleason 3', 'hgpin', 'weird label')
), sides AS (
  SELECT shape_id, iw, ih, round_even(x, 0)::BIGINT AS c0, round_even(x + w, 0)::BIGINT AS c1, round_even(y, 0)::BIGINT AS r0, round_even(y + h, 0)::BIGINT AS r1 FROM picked WHERE kind = 0
), boxes AS (
  SELECT shape_id, iw, ih, 1 AS side, unnest(range(c0, c1 + 1)) AS x, r0 AS y, unnest(range(c1 - c0 + 1)) AS k, 0 AS q FROM sides
  UNION ALL SELECT shape_id, iw, ih, 2, c1, unnest(range(r0, r1 + 1)), unnest(range(r1 - r0 + 1)), 0 FROM sides
  UNION ALL SELECT shape_id, iw, ih, 3, unnest(range(c0, c1 + 1)), r1, unnest(range(c0 - c1, 1)) * -1, 0 FROM sides
  UNION ALL SELECT shape_id, iw, ih, 4, c0, unnest(range(r0, r1 + 1)), unnest(range(r0 - r1, 1)) * -1, 0 FROM sides
), rounds AS (
  SELECT shape_id, iw, ih, round_even(x, 0)::BIGINT AS cx, round_even(y, 0)::BIGINT AS cy, round_even(w / 2, 0)::BIGINT AS a, round_even(h / 2, 0)::BIGINT AS b FROM picked WHERE kind = 1
), walk AS (
  SELECT shape_id, a, b, 0 AS k, -a AS u, 0::BIGINT AS v, (1 - 2 * a) * b * b + a * a AS e FROM rounds
  UNION ALL SELECT shape_id, a, b, k + 1, u + du, v + dv, e + du * (2 * (u + du) + 1) * b * b + dv * (2 * (v + dv) + 1) * a * a
  FROM (SELECT *, CASE WHEN 2 * e >= (2 * u + 1) * b * b THEN 1 ELSE 0 END AS du, CASE WHEN 2 * e <= (2 * v + 1) * a * a THEN 1 ELSE 0 END AS dv FROM walk WHERE u <= 0)
), steps AS (
  SELECT shape_id, 1 AS side, k, q, [-u, u, u, -u][q + 1] AS dx, [v, v, -v, -v][q + 1] AS dy FROM walk, unnest(range(4)) AS t(q) WHERE u <= 0
  UNION ALL SELECT shape_id, 2, n, q, 0, CASE q WHEN 0 THEN n ELSE -n END FROM (SELECT shape_id, unnest(range(v + 1, b + 1)) AS n FROM walk WHERE u > 0), unnest(range(2)) AS t(q)
), every AS (
  SELECT shape_id, side, k, q, x, y FROM boxes WHERE x >= 0 AND y >= 0 AND x < iw AND y < ih
  UNION ALL SELECT shape_id, side, k, q, cx + dx, cy + dy FROM steps JOIN rounds USING (shape_id) WHERE cx + dx >= 0 AND cy + dy >= 0 AND cx + dx < iw AND cy + dy < ih
), thinned AS (
  SELECT shape_id, i // 4 AS i, x::DOUBLE AS x, y::DOUBLE AS y FROM (SELECT *, row_number() OVER (PARTITION BY shape_id ORDER BY side, k, q) - 1 AS i FROM every) WHERE i % 4 = 0
  UNION ALL SELECT shape_id, i, [x, x + w, x][i + 1], [y, y, y + h][i + 1] FROM picked, unnest(range(3)) AS t(i) WHERE kind = 2
)"""


@query(
    D.with_base(
        """SELECT image_id, shape_id, label, CASE WHEN kind < 3 THEN coalesce(n, 0) END AS points, sx, sy, CASE WHEN kind = 3 THEN 'unsupported kind: label' END AS warning
FROM picked LEFT JOIN (SELECT shape_id, count(*)::INTEGER AS n, sum((i + 1) * x) AS sx, sum((i + 1) * y) AS sy FROM thinned GROUP BY ALL) USING (shape_id)""",
        "slides",
        "shapes",
        OUTLINED,
    ).replace("WITH ", "WITH RECURSIVE ", 1)
)
def shape_outlines(spark, sf):
    """Outlines of boxes, ellipses and triangles with one of three texts; sums weigh each point by its place."""
    kind = F.get(F.array(*[F.lit(k) for k in ("rectangle", "ellipse", "polygon", "label")]), (F.col("shape_id") % 4).cast("int"))
    half = lambda c: F.when(F.col("shape_id") % 4 == 1, F.col(c) / 2).otherwise(F.col(c))
    given = F.concat_ws(" ", F.concat_ws(",", "x", "y"), F.concat_ws(",", F.col("x") + F.col("bw"), F.col("y")), F.concat_ws(",", F.col("x"), F.col("y") + F.col("bh")))
    s = D.shapes(spark, sf).select("image_id", "shape_id", kind.alias("kind"), "text", "x", "y", half("bw").alias("w"), half("bh").alias("h"), given.alias("points"))
    o = O.outlines(s, D.slides(spark, sf), 4, 4, text_filter=("gleason 3", "hgpin", "weird label"))
    total = lambda c: F.when(F.size("points") > 0, F.aggregate(F.transform("points", lambda p, i: (i + 1) * p[c]), F.lit(0.0), lambda a, v: a + v))
    return o.select("image_id", "shape_id", "label", F.when(F.col("points").isNotNull(), F.size("points")).alias("points"), total("x").alias("sx"), total("y").alias("sy"), "warning")


@query(D.with_base("SELECT image_id, roi_id, arg_min(CASE WHEN k % 3 > 0 THEN r * 65536 + g * 256 + b END, shape_id) FILTER (k % 3 > 0)::INTEGER AS colour FROM shapes GROUP BY ALL", "slides", "shapes"))
def first_colour(spark, sf):
    """The first colour that a ROI's shapes give; a third of the shapes have none."""
    colour = F.when(F.col("k") % 3 > 0, F.col("r") * 65536 + F.col("g") * 256 + F.col("b"))
    return D.shapes(spark, sf).groupBy("image_id", "roi_id").agg(F.min_by(colour, F.when(colour.isNotNull(), F.col("shape_id"))).alias("colour"))


@query(
    """WITH listed AS (SELECT 'a/d' || page_id % 50 || CASE WHEN page_id % 7 = 0 THEN '/sub' ELSE '' END || '/f' || page_id || CASE page_id % 3 WHEN 0 THEN '.geojson' WHEN 1 THEN '.json' ELSE '.txt' END AS path, page_id FROM pages),
given AS (SELECT page_id AS pos, CASE page_id % 5 WHEN 0 THEN 'a/d' || page_id % 50 || '/' WHEN 1 THEN path WHEN 2 THEN 'a/none' || page_id WHEN 3 THEN 'a/d' || page_id % 50 || '/sub' ELSE 'a' END AS given FROM listed)
SELECT pos, given, path, reason, (row_number() OVER (PARTITION BY pos ORDER BY CASE WHEN path LIKE '%.geojson' THEN 0 ELSE 1 END, path))::INTEGER AS place FROM (
  SELECT pos, given, path, NULL AS reason FROM given JOIN listed ON given = path
  UNION ALL SELECT pos, given, path, NULL FROM given JOIN listed ON rtrim(given, '/') || '/' || split_part(path, '/', -1) = path WHERE path NOT LIKE '%.txt'
  UNION ALL SELECT pos, given, NULL, 'no such file or directory' FROM given WHERE NOT EXISTS (FROM listed WHERE path = given OR starts_with(path, rtrim(given, '/') || '/'))
)"""
)
def files_chosen(spark, sf):
    """Files that names of files and directories stand for, in order."""
    p = D.table(spark, sf, "pages").select("page_id")
    path = "concat('a/d', page_id % 50, CASE WHEN page_id % 7 = 0 THEN '/sub' ELSE '' END, '/f', page_id, CASE page_id % 3 WHEN 0 THEN '.geojson' WHEN 1 THEN '.json' ELSE '.txt' END)"
    given = f"CASE page_id % 5 WHEN 0 THEN concat('a/d', page_id % 50, '/') WHEN 1 THEN {path} WHEN 2 THEN concat('a/none', page_id) WHEN 3 THEN concat('a/d', page_id % 50, '/sub') ELSE 'a' END"
    c = files.chosen(p.selectExpr("page_id AS pos", f"{given} AS given"), p.selectExpr(f"{path} AS path"))
    return c.select("pos", "given", "path", "reason", F.row_number().over(W.partitionBy("pos").orderBy("place")).alias("place"))


JOBS = """jobs AS (
  SELECT c_custkey AS k, c_custkey % 4 = 0 AS whole, c_custkey % 4 = 1 AS include_all, c_custkey % 8 IN (2, 5) AS texts, c_custkey % 11 = 0 AS no_background, (c_nationkey - 1) * 8 AS size,
    CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 200 END AS stride, CASE WHEN c_custkey % 3 = 1 THEN c_custkey % 40 END AS overlap, c_acctbal / 9000 AS cover,
    CASE c_custkey % 7 WHEN 0 THEN NULL WHEN 1 THEN '0.5, 2,1' WHEN 2 THEN ' 1e1,' WHEN 3 THEN '1,x' WHEN 4 THEN ',' WHEN 5 THEN '1,-2' ELSE '2,2.0' END AS scales,
    CASE c_custkey % 13 WHEN 1 THEN 'Auto' WHEN 2 THEN '-1' WHEN 3 THEN '12d' WHEN 4 THEN '128' END AS erode, CASE WHEN c_custkey % 17 = 0 THEN 'stroma' END AS background_label
  FROM customer
)"""


@query(
    f"""WITH {JOBS}, o AS (SELECT *, CASE WHEN stride IS NOT NULL THEN size - stride ELSE coalesce(overlap, 0) END AS ov FROM jobs), judged AS (SELECT *, CASE
  WHEN whole AND (include_all OR texts) THEN 'annotations are not read for whole slides'
  WHEN whole AND (background_label IS NOT NULL OR erode IS NOT NULL OR no_background) THEN 'whole slides have no background'
  WHEN NOT whole AND include_all AND texts THEN 'all annotations and a list of them'
  WHEN NOT whole AND NOT include_all AND NOT texts THEN 'no annotations chosen'
  WHEN no_background AND background_label IS NOT NULL THEN 'a background that is turned off'
  WHEN size <= 0 THEN 'size is not positive' WHEN stride NOT BETWEEN 1 AND size THEN 'stride is not within the size' WHEN ov < 0 OR ov >= size THEN 'overlap is not below the size'
  WHEN cover NOT BETWEEN 0 AND 1 THEN 'fraction is not within 0 and 1' WHEN scales = '1,x' THEN 'scale is no number' WHEN scales = ',' THEN 'no scale' WHEN scales = '1,-2' THEN 'scale is not positive'
  WHEN scales = '2,2.0' THEN 'scale is repeated' WHEN erode = '12d' THEN 'erosion is no number' WHEN erode = '-1' THEN 'erosion is below zero' END AS reason FROM o)
SELECT k, reason, CASE WHEN reason IS NULL THEN ov END AS overlap_px, CASE WHEN reason IS NULL THEN CASE scales WHEN ' 1e1,' THEN 10.0 ELSE 0.5 END END::DOUBLE AS mpp,
  CASE WHEN reason IS NULL AND scales = '0.5, 2,1' THEN '0.5|1.0|2.0' END AS scale_list, CASE WHEN reason IS NULL THEN CASE WHEN whole THEN 0.0 WHEN erode = '128' THEN 128.0 END END::DOUBLE AS erode_um,
  CASE WHEN reason IS NULL AND NOT whole AND NOT no_background THEN coalesce(background_label, 'benign') END AS background FROM judged"""
)
def jobs_settled(spark, sf):
    """Written parameters of a job for each customer: the first rule broken, or what the job will do."""
    j = D.table(spark, sf, "customer").selectExpr(
        "c_custkey AS k", "c_custkey % 4 = 0 AS whole", "c_custkey % 4 = 1 AS include_all", "CASE WHEN c_custkey % 8 IN (2, 5) THEN array('g3') END AS texts", "c_custkey % 11 = 0 AS no_background", "(c_nationkey - 1) * 8 AS size",
        "CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 200 END AS stride", "CASE WHEN c_custkey % 3 = 1 THEN c_custkey % 40 END AS overlap", "c_acctbal / 9000 AS min_coverage", "0.5D AS tissue_thresh",
        "CASE c_custkey % 7 WHEN 0 THEN NULL WHEN 1 THEN '0.5, 2,1' WHEN 2 THEN ' 1e1,' WHEN 3 THEN '1,x' WHEN 4 THEN ',' WHEN 5 THEN '1,-2' ELSE '2,2.0' END AS scales",
        "CASE c_custkey % 13 WHEN 1 THEN 'Auto' WHEN 2 THEN '-1' WHEN 3 THEN '12d' WHEN 4 THEN '128' END AS erode", "CASE WHEN c_custkey % 17 = 0 THEN 'stroma' END AS background_label",
    )
    return J.settled(j).select("k", "reason", "overlap_px", "mpp", F.array_join("values", "|").alias("scale_list"), "erode_um", "background")


@query(
    """SELECT template_id, number, label, algorithm FROM (SELECT p_partkey AS template_id, unnest(range(1, p_partkey % 4 + 1))::INTEGER AS number,
  CASE WHEN number = 1 THEN 'prostate' WHEN (p_partkey + number) % 2 = 0 THEN 'L' || p_size ELSE 'Segment ' || number END AS label, CASE WHEN number = 2 THEN 'AUTOMATIC' ELSE 'MANUAL' END AS algorithm FROM part)
UNION ALL SELECT p_partkey, NULL, NULL, NULL FROM part WHERE p_partkey % 4 = 0"""
)
def segment_descriptions(spark, sf):
    """Numbered segments of a template for each part, the first one renamed."""
    made = F.expr("transform(slice(array(1, 2, 3), 1, cast(p_partkey % 4 AS int)), n -> struct(CASE WHEN (p_partkey + n) % 2 = 0 THEN concat('L', p_size) END AS label, CASE WHEN n = 2 THEN 'AUTOMATIC' END AS algorithm))")
    return J.segments(D.table(spark, sf, "part").select(F.col("p_partkey").alias("template_id"), made.alias("segments")), "prostate")

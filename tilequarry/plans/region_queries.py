"""Queries over block stores: regions, regions as squares, and whole images made smaller."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import blocks as B
from ..operators import rings as R
from . import derived as D
from .raster_queries import GREY, grey
from .registry import registry

QUERIES, ORACLES, query = registry()
#: Side of a stored block, of a region, and of a region's square; the mosaics are read at a third.
SIDE, SIZE, SQUARE, FACTOR = 10, 12, 5, 3
MOSAICS = (
    "px AS (SELECT vec_id // 12 AS raster, (vec_id % 12 // 4 * 8 + y)::INTEGER AS y, (vec_id % 4 * 8 + x)::INTEGER AS x, [g, (g * 7 + 3) % 256, 255 - g] AS b FROM grey)",
    "extents AS (SELECT DISTINCT vec_id // 12 AS raster, 24 - vec_id // 12 % 5 AS height, 32 - vec_id // 12 % 3 AS width FROM embeddings)",
)
WINDOWS = f"""win AS (
  SELECT vec_id, raster, least(round_even(vec_id * 37 % 90 / 3, 0), width - {SIZE})::INTEGER AS x, least(round_even(vec_id * 53 % 70 / 3, 0), height - {SIZE})::INTEGER AS y
  FROM embeddings JOIN extents ON raster = vec_id // 12
)"""


def extents(spark, sf):
    e = D.table(spark, sf, "embeddings").select(F.expr("vec_id div 12").alias("raster")).distinct()
    return e.selectExpr("raster", "24 - raster % 5 AS height", "32 - raster % 3 AS width")


def mosaics(spark, sf, planar):
    """Twelve embeddings side by side as one raster of three bands."""
    g = grey(spark, sf).selectExpr("vec_id div 12 AS raster", "cast(vec_id % 12 div 4 * 8 + y AS int) AS y", "cast(vec_id % 4 * 8 + x AS int) AS x", "g", "(g * 7 + 3) % 256 AS g7", "255 - g AS inverse")
    return B.to_blocks(g, extents(spark, sf), "raster", SIDE, ["g", "g7", "inverse"], planar)


def read(spark, sf, planar):
    w = D.table(spark, sf, "embeddings").selectExpr("vec_id", "vec_id div 12 AS raster", "vec_id * 37 % 90 AS x", "vec_id * 53 % 70 AS y")
    w = B.clamped(w, extents(spark, sf), "raster", SIZE, F.lit(float(FACTOR)))
    return B.regions(w, mosaics(spark, sf, planar), "raster", "vec_id", SIDE, 3)


@query(
    D.with_base(
        f"""SELECT vec_id, w.x, w.y, md5(unhex(string_agg(printf('%02x', coalesce(b[c], 0)), '' ORDER BY w.y + dy, w.x + dx, c))) AS bytes
FROM win w, unnest(range({SIZE})) AS a(dy), unnest(range({SIZE})) AS e(dx), unnest([1, 2, 3]) AS d(c) LEFT JOIN px p ON p.raster = w.raster AND p.y = w.y + dy AND p.x = w.x + dx GROUP BY ALL""",
        "thumbs",
        GREY,
        *MOSAICS,
        WINDOWS,
    )
)
def region_bytes(spark, sf):
    """Each window's bytes, cut from planar blocks that its borders cross."""
    return read(spark, sf, True).select("vec_id", "x", "y", F.md5("data").alias("bytes"))


@query(
    D.with_base(
        f"""SELECT vec_id, md5(unhex(string_agg(printf('%02x', (2 * s + n) // (2 * n)), '' ORDER BY oy, ox, c))) AS bytes FROM (
  SELECT vec_id, oy, ox, c, sum(coalesce(b[c], 0))::BIGINT AS s, count(*) AS n
  FROM win w, unnest(range({SQUARE})) AS o(oy), unnest(range({SQUARE})) AS q(ox), unnest(range({SIZE})) AS a(dy), unnest(range({SIZE})) AS e(dx), unnest([1, 2, 3]) AS d(c)
    LEFT JOIN px p ON p.raster = w.raster AND p.y = w.y + dy AND p.x = w.x + dx
  WHERE dy >= oy * {SIZE} // {SQUARE} AND dy * {SQUARE} < (oy + 1) * {SIZE} AND dx >= ox * {SIZE} // {SQUARE} AND dx * {SQUARE} < (ox + 1) * {SIZE} GROUP BY ALL
) GROUP BY ALL""",
        "thumbs",
        GREY,
        *MOSAICS,
        WINDOWS,
    )
)
def region_squares(spark, sf):
    """Each window as a square of means of boxes whose sides are no whole numbers."""
    return B.resized(read(spark, sf, False), "raster", "vec_id", SQUARE).select("vec_id", F.md5("data").alias("bytes"))


@query(
    D.with_base(
        f"""SELECT raster, (oy // {SIDE})::INTEGER AS "by", (ox // {SIDE})::INTEGER AS bx, max(oy) - min(oy) + 1 AS h, max(ox) - min(ox) + 1 AS w, md5(unhex(string_agg(printf('%02x', (2 * s + n) // (2 * n)), '' ORDER BY oy, ox, c))) AS bytes FROM (
  SELECT o.raster, oy, ox, c, sum(coalesce(b[c], 0))::BIGINT AS s, count(*) AS n FROM (
    SELECT *, unnest(range(ox * width // ow, ((ox + 1) * width + ow - 1) // ow)) AS sx FROM (
      SELECT *, unnest(range(oy * height // oh, ((oy + 1) * height + oh - 1) // oh)) AS sy FROM (
        SELECT *, unnest(range(ow)) AS ox FROM (SELECT *, unnest(range(oh)) AS oy FROM (
          SELECT *, round_even(height / {FACTOR}, 0)::BIGINT AS oh, round_even(width / {FACTOR}, 0)::BIGINT AS ow FROM extents))))) o, unnest([1, 2, 3]) AS d(c)
    LEFT JOIN px p ON p.raster = o.raster AND p.y = sy AND p.x = sx GROUP BY ALL
) GROUP BY ALL""",
        "thumbs",
        GREY,
        *MOSAICS,
    )
)
def whole_image_blocks(spark, sf):
    """Each mosaic at a third, as blocks again."""
    b = B.whole_at(mosaics(spark, sf, True), extents(spark, sf), "raster", SIDE, FACTOR, 3)
    return b.select("raster", "by", "bx", "h", "w", F.md5("data").alias("bytes"))


@query(D.with_base(f"""SELECT raster, count(*) AS blocks, sum(h * w * 3)::BIGINT AS size, bool_and(true) AS rgb FROM (
  SELECT DISTINCT raster, least({SIDE}, height - y // {SIDE} * {SIDE}) AS h, least({SIDE}, width - x // {SIDE} * {SIDE}) AS w, y // {SIDE} AS v, x // {SIDE} AS u FROM px JOIN extents USING (raster) WHERE y < height AND x < width
) GROUP BY ALL""", "thumbs", GREY, *MOSAICS))
def block_store(spark, sf):
    """What is stored of each mosaic, and whether it is a colour image."""
    s = mosaics(spark, sf, False)
    return s.groupBy("raster").agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.length("data")).alias("size"), F.bool_and(B.is_rgb(F.col("bands"))).alias("rgb"))


@query(
    D.with_base(
        """SELECT image_id, z, c, t, x, y, w, h, number, number // ((count(*) OVER (PARTITION BY image_id) + 4) // 5) AS part FROM (
  SELECT *, least(256, width0 - x) AS w, least(200, height0 - y) AS h, row_number() OVER (PARTITION BY image_id ORDER BY z, ci, t DESC, y, x) - 1 AS number FROM (
    SELECT image_id, width0, height0, z, ci, [7, 2][ci] AS c, t, y, unnest(range(0, width0, 256)) AS x FROM (
      SELECT *, unnest(range(0, height0, 200)) AS y FROM slides, unnest([0, 1, 2]) AS a(z), unnest([1, 2]) AS b(ci), unnest([3, 1]) AS d(t) WHERE z <= j % 3)))""",
        "slides",
    )
)
def plane_blocks(spark, sf):
    """Blocks of all planes of each slide in five runs; channels and times in the order they are asked for."""
    s = D.slides(spark, sf).selectExpr("image_id", "width0 AS width", "height0 AS height", "sequence(0, cast(j % 3 AS int)) AS zs", "array(7, 2) AS channels", "array(3, 1) AS times")
    return B.plane_blocks(s, 256, 200, 5)


@query(
    D.with_base(
        "SELECT shape_id, string_agg(px || ',' || py, ' ' ORDER BY i) AS points FROM (SELECT *, lag(px) OVER w AS lx, lag(py) OVER w AS ly FROM ("
        "SELECT shape_id, i, [x, x, x + k % 2 * bw, x, x][i + 1] AS px, [y, y, y, y, y + k % 3][i + 1] AS py FROM shapes, unnest(range(5)) AS t(i)) WINDOW w AS (PARTITION BY shape_id ORDER BY i)) "
        "WHERE i = 0 OR px <> lx OR py <> ly GROUP BY ALL",
        "slides",
        "shapes",
    )
)
def repeats_dropped(spark, sf):
    """Points of which some equal the one before."""
    ring = F.expr("array(struct(x, y), struct(x, y), struct(x + k % 2 * bw AS x, y), struct(x, y), struct(x, y + k % 3 AS y))")
    text = F.transform(R.drop_repeats(ring), lambda p: F.concat_ws(",", p["x"], p["y"]))
    return D.shapes(spark, sf).select("shape_id", F.array_join(text, " ").alias("points"))

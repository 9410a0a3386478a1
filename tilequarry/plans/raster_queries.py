"""Queries over rasters and volumes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rasters as R
from ..operators import shapes as S
from ..operators import tiles as T
from ..operators import tissue as TI
from ..operators import volumes as V
from . import derived as D
from .registry import registry

QUERIES, ORACLES, query = registry()
SET = "mask AS (SELECT vec_id, y, x FROM thumbs WHERE v > 0)"
GREY = "grey AS (SELECT vec_id, y, x, least(255, greatest(0, 128 + round_even(256 * v, 0)))::INTEGER AS g FROM thumbs)"


def mask(spark, sf):
    return D.thumbs(spark, sf).where("v > 0").select("vec_id", "y", "x")


def grey(spark, sf):
    return D.thumbs(spark, sf).select("vec_id", "y", "x", F.least(F.lit(255.0), F.greatest(F.lit(0.0), 128 + F.rint(256 * F.col("v")))).cast("int").alias("g"))


def table_of_sums(spark, sf):
    return R.prefix_sums(D.thumbs(spark, sf), "vec_id", (F.col("v") > 0).cast("long"))


@query(D.with_base("SELECT vec_id, y, x, sum(r) OVER (PARTITION BY vec_id, x ORDER BY y)::BIGINT AS s FROM (SELECT *, sum((v > 0)::INTEGER) OVER (PARTITION BY vec_id, y ORDER BY x) AS r FROM thumbs)", "thumbs"))
def sat_prefix(spark, sf):
    return table_of_sums(spark, sf).select("vec_id", "y", "x", "s")


WINDOWS = "(SELECT vec_id, wx, wy FROM (SELECT DISTINCT vec_id FROM thumbs), (VALUES (0), (2), (4)) AS a(wx), (VALUES (0), (3), (5)) AS b(wy))"


@query(D.with_base(f"SELECT w.vec_id, wx AS x0, wy AS y0, count(*) FILTER (v > 0) / greatest(1, 3 * 4) AS fraction FROM {WINDOWS} w JOIN thumbs t ON t.vec_id = w.vec_id AND x >= wx AND x < wx + 4 AND y >= wy AND y < wy + 3 GROUP BY ALL", "thumbs"))
def window_fraction(spark, sf):
    w = D.table(spark, sf, "embeddings").select("vec_id", F.explode(F.array(F.lit(0), F.lit(2), F.lit(4))).alias("x0")).withColumn("y0", F.explode(F.array(F.lit(0), F.lit(3), F.lit(5))))
    w = w.withColumn("x1", F.col("x0") + 4).withColumn("y1", F.col("y0") + 3)
    return R.window_sum(table_of_sums(spark, sf), w, "vec_id").select("vec_id", "x0", "y0", (F.col("total") / F.greatest(F.lit(1), F.lit(12))).alias("fraction"))


@query(D.with_base("SELECT vec_id, count(*) FILTER (v > 0) = 4 AS inside FROM thumbs WHERE x IN (3, 4) AND y IN (3, 4) GROUP BY vec_id", "thumbs"))
def center_inside(spark, sf):
    return D.thumbs(spark, sf).where("x IN (3, 4) AND y IN (3, 4)").groupBy("vec_id").agg((F.count_if(F.col("v") > 0) == 4).alias("inside"))


@query(
    D.with_base(
        """SELECT vec_id, arg_min(g, (-v, g)) AS threshold FROM (
  SELECT vec_id, g, ((m0 * (w - w0) - (m - m0) * w0)::DOUBLE * (m0 * (w - w0) - (m - m0) * w0)::DOUBLE) / (w0 * (w - w0)) AS v FROM (
    SELECT vec_id, g, sum(n) OVER (PARTITION BY vec_id ORDER BY g)::BIGINT AS w0, sum(n * g) OVER (PARTITION BY vec_id ORDER BY g)::BIGINT AS m0,
      sum(n) OVER (PARTITION BY vec_id)::BIGINT AS w, sum(n * g) OVER (PARTITION BY vec_id)::BIGINT AS m
    FROM (SELECT vec_id, g, count(*) AS n FROM grey GROUP BY ALL)) WHERE w0 < w) GROUP BY vec_id""",
        "thumbs",
        GREY,
    )
)
def otsu_threshold(spark, sf):
    return R.otsu(grey(spark, sf), "vec_id", "g")


@query(D.with_base("SELECT vec_id, (y // 4)::INTEGER AS ty, (x // 4)::INTEGER AS tx, count(*) FILTER (v > 0) / 16 AS tissue FROM thumbs GROUP BY ALL", "thumbs"))
def tissue_fraction(spark, sf):
    t = D.thumbs(spark, sf).withColumn("ty", F.expr("cast(y div 4 AS int)")).withColumn("tx", F.expr("cast(x div 4 AS int)"))
    return t.groupBy("vec_id", "ty", "tx").agg((F.count_if(F.col("v") > 0) / 16).alias("tissue"))


DISK = "(SELECT dy, dx FROM unnest(range(-2, 3)) AS a(dy), unnest(range(-2, 3)) AS b(dx) WHERE dy * dy + dx * dx <= 4)"


@query(D.with_base(f"SELECT DISTINCT vec_id, (y + dy)::INTEGER AS y, (x + dx)::INTEGER AS x FROM mask, {DISK} WHERE y + dy BETWEEN 0 AND 7 AND x + dx BETWEEN 0 AND 7", "thumbs", SET))
def dilate_disk(spark, sf):
    return R.dilate(mask(spark, sf), "vec_id", 2, 8)


ERODED = "SELECT a.vec_id, a.y, a.x FROM {m} a JOIN {m} b ON a.vec_id = b.vec_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY ALL HAVING count(*) = 9"


@query(D.with_base(ERODED.format(m="mask"), "thumbs", SET))
def erode_square(spark, sf):
    return R.erode(mask(spark, sf), "vec_id", 3)


@query(D.with_base(ERODED.format(m="grown"), "thumbs", SET, "grown AS (SELECT DISTINCT vec_id, (y + dy)::INTEGER AS y, (x + dx)::INTEGER AS x FROM mask, (VALUES (0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)) AS o(dy, dx) WHERE y + dy BETWEEN 0 AND 7 AND x + dx BETWEEN 0 AND 7)"))
def closing(spark, sf):
    return R.erode(R.dilate(mask(spark, sf), "vec_id", 1, 8), "vec_id", 3)


@query(
    D.with_base(
        """SELECT vec_id, c, count(*) AS pixels FROM (SELECT vec_id, y, x, min(c) AS c FROM reach GROUP BY ALL) GROUP BY ALL HAVING count(*) >= 4""",
        "thumbs",
        SET,
        """reach AS (SELECT vec_id, y, x, (y * 8 + x)::BIGINT AS c FROM mask
  UNION SELECT m.vec_id, m.y, m.x, r.c FROM reach r JOIN mask m ON m.vec_id = r.vec_id AND abs(m.y - r.y) + abs(m.x - r.x) = 1)""",
    ).replace("WITH ", "WITH RECURSIVE ", 1)
)
def components_filter(spark, sf):
    """Components of at least four pixels, with their size."""
    c = R.components(mask(spark, sf), "vec_id", 8).groupBy("vec_id", "c").agg(F.count(F.lit(1)).alias("pixels"))
    return c.where("pixels >= 4")


@query(D.with_base("SELECT image_id, y, x, max(shape_id) AS shape_id FROM (SELECT image_id, shape_id, y, unnest(range(x // 16, (x + bw) // 16)) AS x FROM (SELECT image_id, shape_id, x, bw, unnest(range(y // 16, (y + bh) // 16)) AS y FROM shapes)) GROUP BY ALL", "slides", "shapes"))
def polygon_fill(spark, sf):
    """Boxes as pixels at a sixteenth; the later shape owns a shared pixel."""
    shapes = D.shapes(spark, sf)
    s = shapes.selectExpr("image_id", "shape_id", "explode(sequence(y div 16, (y + bh) div 16 - 1)) AS y", "x div 16 AS x_from", "(x + bw) div 16 AS x_to")
    return S.row_owners(s, "shape_id", T.tasks_of(shapes))


@query(D.with_base("SELECT image_id, v, count(*) AS pixels FROM (SELECT image_id, y, x, arg_max(v, shape_id) AS v FROM (SELECT image_id, shape_id, v, y, unnest(range(x // 16, (x + bw) // 16)) AS x FROM (SELECT image_id, shape_id, x, bw, unnest(range(y // 16, (y + bh) // 16)) AS y, CASE text WHEN 'Gleason 3' THEN 1 WHEN 'g4 cg' THEN 2 ELSE 3 END AS v FROM shapes WHERE text IN ('Gleason 3', 'g4 cg', 'hgpin'))) GROUP BY ALL) GROUP BY ALL", "slides", "shapes"))
def mask_palette(spark, sf):
    """Mask values numbered by the order of the filter, as pixel counts."""
    wanted = F.array(F.lit("Gleason 3"), F.lit("g4 cg"), F.lit("hgpin"))
    s = D.shapes(spark, sf).withColumn("v", F.array_position(wanted, F.col("text")).cast("int")).where("v > 0")
    s = s.selectExpr("image_id", "shape_id", "v", "x", "bw", "explode(sequence(y div 16, (y + bh) div 16 - 1)) AS y").selectExpr("image_id", "shape_id", "v", "y", "explode(sequence(x div 16, (x + bw) div 16 - 1)) AS x")
    return s.groupBy("image_id", "y", "x").agg(F.max_by("v", "shape_id").alias("v")).groupBy("image_id", "v").agg(F.count(F.lit(1)).alias("pixels"))


@query(D.with_base("SELECT vec_id, (y // 2)::INTEGER AS y2, (x // 2)::INTEGER AS x2, sum(g)::BIGINT AS total FROM grey WHERE y BETWEEN 2 AND 7 AND x BETWEEN 0 AND 5 GROUP BY ALL", "thumbs", GREY))
def crop_resize_box(spark, sf):
    g = grey(spark, sf).where("y BETWEEN 2 AND 7 AND x BETWEEN 0 AND 5")
    return g.groupBy("vec_id", F.expr("cast(y div 2 AS int)").alias("y2"), F.expr("cast(x div 2 AS int)").alias("x2")).agg(F.sum("g").cast("long").alias("total"))


@query(D.with_base("SELECT vec_id, 7 - y AS y, x, g FROM grey", "thumbs", GREY))
def volume_flip(spark, sf):
    return grey(spark, sf).select("vec_id", (7 - F.col("y")).alias("y"), "x", "g")


@query("SELECT p_partkey, -s AS a, o + s * 7 AS t FROM (SELECT p_partkey, p_size::DOUBLE AS s, p_retailprice AS o FROM part)")
def affine_flip(spark, sf):
    """Flip an axis of eight samples: its step changes sign and the origin moves to the other end."""
    p = D.table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("s"), F.col("p_retailprice").alias("o"))
    return p.select("p_partkey", (-F.col("s")).alias("a"), (F.col("o") + F.col("s") * 7).alias("t"))


#: A volume for each part: rows and columns along world axes that its key chooses, and in LPS; the reference is plain RAS.
AFFINES = """v AS (
  SELECT p_partkey, p_partkey % 3 AS a, (p_partkey + 1 + p_partkey // 3 % 2) % 3 AS b, CASE WHEN p_partkey % 5 < 2 THEN -1.0 ELSE 1.0 END AS sa, CASE WHEN p_partkey % 7 < 3 THEN -1.0 ELSE 1.0 END AS sb,
    p_size::DOUBLE AS step, p_retailprice AS o, 5 + p_partkey % 4 AS n0, 6 AS n1, 7 AS n2 FROM part
), d AS (
  SELECT *, 3 - a - b AS c, (CASE WHEN (b - a + 3) % 3 = 1 THEN 1.0 ELSE -1.0 END) * sa * sb AS sc FROM v
), m AS (
  SELECT *, CASE WHEN a < 2 THEN -sa ELSE sa END AS ra, CASE WHEN b < 2 THEN -sb ELSE sb END AS rb, CASE WHEN c < 2 THEN -sc ELSE sc END AS rc FROM d
), codes AS (
  SELECT *, substr(['RL', 'AP', 'SI'][a + 1], CASE WHEN ra > 0 THEN 1 ELSE 2 END, 1) AS ca, substr(['RL', 'AP', 'SI'][b + 1], CASE WHEN rb > 0 THEN 1 ELSE 2 END, 1) AS cb,
    substr(['RL', 'AP', 'SI'][c + 1], CASE WHEN rc > 0 THEN 1 ELSE 2 END, 1) AS cc FROM m
), turned AS (SELECT *, ca <> 'R' AS fa, cb <> 'A' AS fb, cc <> 'S' AS fc FROM codes)"""


def world(i: int) -> str:
    origin = f"{'-' if i < 2 else ''}(o + {i})"
    moved = " + ".join(f"CASE WHEN {x} = {i} AND f{x} THEN r{x} * {step} * ({n} - 1) ELSE 0 END" for x, step, n in (("a", "step", "n0"), ("b", "(step + 1)", "n1"), ("c", "2.0", "n2")))
    return f"({origin} + {moved})::DOUBLE AS o{i}"


@query(f"WITH {AFFINES} SELECT p_partkey, ca || cb || cc AS codes, fa::INTEGER || '' || fb::INTEGER || fc::INTEGER AS flips, {', '.join(world(i) for i in range(3))} FROM turned")
def affine_orientation(spark, sf):
    """Volumes in LPS brought to RAS and turned to a plain reference: their axes, which of them turn, and the new origins."""
    p = D.table(spark, sf, "part").selectExpr(
        "*", "p_partkey % 3 AS a", "(p_partkey + 1 + p_partkey div 3 % 2) % 3 AS b", "CASE WHEN p_partkey % 5 < 2 THEN -1D ELSE 1D END AS sa", "CASE WHEN p_partkey % 7 < 3 THEN -1D ELSE 1D END AS sb", "cast(p_size AS double) AS step"
    )
    unit = lambda axis, sign: F.array(*[F.when(F.col(axis) == i, F.col(sign)).otherwise(F.lit(0.0)) for i in range(3)])
    rows, columns = unit("a", "sa"), unit("b", "sb")
    origin = F.array(*[F.col("p_retailprice") + i for i in range(3)])
    own = V.to_ras(V.from_directions(rows, columns, F.col("step"), F.col("step") + 1, V.cross(rows, columns, F.lit(2.0)), origin))
    plain = F.array(*[F.lit(float(i in (0, 5, 10))) for i in range(12)])
    lengths = F.array((F.col("p_partkey") % 4 + 5).cast("int"), F.lit(6), F.lit(7))
    t = p.select("p_partkey", own.alias("m"), lengths.alias("n")).withColumn("f", V.flips(F.col("m"), plain))
    t = t.withColumn("new", V.flip(F.col("m"), F.col("f"), F.col("n")))
    marks = F.array_join(F.transform("f", lambda x: x.cast("int").cast("string")), "")
    return t.select("p_partkey", V.axis_codes(F.col("m")).alias("codes"), marks.alias("flips"), *[(V.entry(F.col("new"), i, 3) + 0.0).alias(f"o{i}") for i in range(3)])


@query("SELECT conv_id, round(regr_slope(z, turn), 6) AS step FROM (SELECT conv_id, turn, (turn * 3 + conv_id % 5)::DOUBLE AS z FROM conversations) GROUP BY conv_id HAVING count(DISTINCT turn) > 1")
def slice_step_fit(spark, sf):
    c = D.table(spark, sf, "conversations").select("conv_id", F.col("turn").cast("double").alias("turn"), (F.col("turn") * 3 + F.col("conv_id") % 5).cast("double").alias("z"))
    return c.groupBy("conv_id").agg(F.round(F.regr_slope("z", "turn"), 6).alias("step"), F.count_distinct("turn").alias("n")).where("n > 1").select("conv_id", "step")


#: Sixteen small rasters side by side as one of 32 x 32 pixels in colour; every ninth is flat.
MOSAIC = """mosaic AS (
  SELECT vec_id // 16 AS image, (vec_id % 16 // 4 * 8 + y)::INTEGER AS y, (vec_id % 4 * 8 + x)::INTEGER AS x,
    220 AS r, CASE WHEN vec_id // 16 % 9 = 8 THEN 200 ELSE 220 - g * 3 // 4 END AS g, CASE WHEN vec_id // 16 % 9 = 8 THEN 200 ELSE 220 - g // 2 END AS b FROM grey
), signal AS (
  SELECT image, y, x, (greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b) AS s FROM mosaic
), ends AS (SELECT image, min(s) AS low, max(s) AS high, max(s) - min(s) AS span FROM signal GROUP BY image HAVING max(s) - min(s) >= 1e-6
), binned AS (SELECT image, least(255, floor((s - low) / span * 256))::INTEGER AS bin, count(*) AS n FROM signal JOIN ends USING (image) GROUP BY ALL
), upto AS (
  SELECT image, bin, sum(n) OVER (PARTITION BY image ORDER BY bin)::BIGINT AS w0, sum(n * bin) OVER (PARTITION BY image ORDER BY bin)::BIGINT AS m0,
    sum(n) OVER (PARTITION BY image)::BIGINT AS w, sum(n * bin) OVER (PARTITION BY image)::BIGINT AS m FROM binned
), best AS (
  SELECT image, arg_min(bin, (-((m0 * (w - w0) - (m - m0) * w0)::DOUBLE * (m0 * (w - w0) - (m - m0) * w0)::DOUBLE) / (w0 * (w - w0)), bin)) AS bin FROM upto WHERE w0 < w GROUP BY image
), marked AS (SELECT image, y, x FROM signal JOIN ends USING (image) JOIN best USING (image) WHERE s > low + (bin + 0.5) * span / 256
), plus AS (SELECT * FROM (VALUES (0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)) AS o(dy, dx)
), here AS (SELECT image, max(y) + 1 AS h, max(x) + 1 AS w FROM signal GROUP BY image
), grown AS (SELECT DISTINCT image, y + dy AS y, x + dx AS x FROM marked JOIN here USING (image), plus WHERE y + dy >= 0 AND y + dy < h AND x + dx >= 0 AND x + dx < w
), closed AS (
  SELECT g.image, g.y, g.x FROM grown g JOIN here USING (image), plus LEFT JOIN grown o ON o.image = g.image AND o.y = g.y + dy AND o.x = g.x + dx
  GROUP BY g.image, g.y, g.x, h, w HAVING count(o.image) = 5 - (g.y = 0)::INTEGER - (g.x = 0)::INTEGER - (g.y = h - 1)::INTEGER - (g.x = w - 1)::INTEGER
), rows_ AS (SELECT image, y, min(x) AS a, max(x) + 1 AS b FROM (SELECT *, x - row_number() OVER (PARTITION BY image, y ORDER BY x) AS k FROM closed) GROUP BY image, y, k
), touch AS (SELECT p.image, p.y AS y, p.a AS a, q.y AS y2, q.a AS a2 FROM rows_ p JOIN rows_ q ON p.image = q.image AND abs(p.y - q.y) = 1 AND p.a < q.b AND q.a < p.b
), reach AS (SELECT image, y, a, y * 1000 + a AS c FROM rows_
  UNION SELECT t.image, t.y2, t.a2, r.c FROM reach r JOIN touch t ON t.image = r.image AND t.y = r.y AND t.a = r.a
), named AS (SELECT image, y, a, min(c) AS c FROM reach GROUP BY ALL
), parts AS (SELECT *, sum(b - a) OVER (PARTITION BY image, c) AS pixels FROM named JOIN rows_ USING (image, y, a))"""


@query(D.with_base("SELECT image, y::BIGINT AS y, a::BIGINT AS a, b::BIGINT AS b FROM parts WHERE pixels >= 16", "thumbs", GREY, MOSAIC).replace("WITH ", "WITH RECURSIVE ", 1))
def tissue_chain(spark, sf):
    """Tissue of colour rasters as runs: saturation, Otsu, closing, components of at least 16 pixels; flat rasters have none."""
    flat = F.expr("vec_id div 16 % 9 = 8")
    m = grey(spark, sf).select(
        F.expr("vec_id div 16").alias("image"),
        F.expr("cast(vec_id % 16 div 4 * 8 + y AS int)").alias("y"),
        F.expr("cast(vec_id % 4 * 8 + x AS int)").alias("x"),
        TI.saturation(F.lit(220), F.when(flat, 200).otherwise(F.expr("220 - g * 3 div 4")), F.when(flat, 200).otherwise(F.expr("220 - g div 2"))).alias("s"),
    )
    return TI.tissue_mask(m, "image", "s").select("image", F.col("y").cast("long").alias("y"), "a", "b")

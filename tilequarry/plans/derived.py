"""Slides, shapes, tissue and manifests derived from the supplied tables, for Spark and as SQL text.

Only integer arithmetic is used, so any engine derives the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The default label map (folder, aliases) and the default palette (label, r, g, b), in order.
LABEL_MAP = {
    "G3": ["g3", "gleason 3", "gleason3", "pattern 3"],
    "G4cg": ["g4cg", "g4 cg", "gleason 4 cribriform", "cribriform"],
    "G4fg": ["g4fg", "g4 fg", "gleason 4 fused", "fused glands"],
    "G5": ["g5", "gleason 5", "pattern 5"],
    "Atrophy": ["atrophy"],
    "HGPIN": ["hgpin", "high grade pin"],
    "Seminal_Vesicles": ["seminal vesicles", "seminal vesicle"],
    "Vessel": ["vessel", "vessels"],
    "Urethra": ["urethra"],
}
PALETTE = [
    ("Seminal Vesicles", 25, 20, 255),
    ("Atrophy", 0, 0, 0),
    ("HGPIN", 255, 122, 0),
    ("G3", 48, 255, 50),
    ("G4FG", 255, 250, 20),
    ("G4CG", 254, 22, 255),
    ("G5", 33, 255, 255),
    ("Vessel", 181, 187, 253),
    ("Urethra", 128, 128, 128),
    ("Exclusion ROI", 255, 16, 0),
]
EXCLUSION = "exclusion roi"


#: Bytes of a method up to which the JVM compiles it; a larger one is interpreted, which takes several times as long.
COMPILED = 8000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A supplied table. Steps that would make too large a method of Spark's are made one by one, unless the session has a limit of its own."""
    key = "spark.sql.codegen.hugeMethodLimit"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(COMPILED))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One slide for each part."""
    part = table(spark, sf_dir, "part").selectExpr("p_partkey AS image_id", "p_partkey AS j")
    return part.selectExpr(
        "image_id",
        "j",
        "cast(j % 3 AS int) AS group_id",
        "CASE WHEN j % 17 = 0 THEN concat('mystery_', j, '.tiff') ELSE concat('N', 101 + j % 40, '_S', lpad(cast(j % 12 AS string), 2, '0'), "
        "'_', CASE j % 3 WHEN 0 THEN 'HE' WHEN 1 THEN 'PHH3' ELSE 'CD31' END, '.ome.tiff') END AS image_name",
        "600 + 64 * (j % 13) AS width0",
        "500 + 48 * (j % 11) AS height0",
        "CASE WHEN j % 19 = 0 THEN NULL WHEN j % 2 = 0 THEN 0.25D ELSE 0.5D END AS pixel_size",
    )


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("idx"), F.lit(d).alias("d")) for i, d in ((0, 1), (1, 2), (2, 4))])).alias("l")
    return slides(spark, sf_dir).select("image_id", "width0", "height0", "pixel_size", steps).selectExpr(
        "image_id", "width0", "height0", "pixel_size", "l.idx AS idx", "width0 div l.d AS width", "height0 div l.d AS height"
    )


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rectangle with text and packed colour for each order; slides whose id is divisible by 13 have none."""
    m = table(spark, sf_dir, "part").count()
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS shape_id", "o_orderkey AS k", "o_custkey AS c", "left(o_orderpriority, 1) AS p")
    o = o.withColumn("image_id", F.col("k") % m).where("image_id % 13 <> 0").join(slides(spark, sf_dir).select("image_id", "width0", "height0"), "image_id")
    jitter = lambda v: F.least(F.lit(255), F.greatest(F.lit(0), v + F.col("k") % 25 - 12)).cast("int")
    colour = [F.element_at(F.array(*[F.lit(x[i]) for x in PALETTE]), (F.col("k") % 10 + 1).cast("int")) for i in (1, 2, 3)]
    return o.selectExpr(
        "*",
        "k div 2 AS roi_id",
        "(k * 37 + c * 11) % (width0 - 200) AS x",
        "(k * 53 + c * 7) % (height0 - 200) AS y",
        "100 + (k * 13) % 100 AS bw",
        "80 + (k * 29) % 120 AS bh",
        "CASE p WHEN '1' THEN 'Gleason 3' WHEN '2' THEN 'g4 cg' WHEN '3' THEN 'Pattern 5' "
        "WHEN '4' THEN CASE WHEN k % 3 = 0 THEN 'Exclusion ROI' ELSE 'weird label' END ELSE CASE WHEN k % 7 = 0 THEN NULL ELSE 'hgpin' END END AS text",
    ).select("image_id", "roi_id", "shape_id", "k", "x", "y", "bw", "bh", "text", *[jitter(v).alias(n) for v, n in zip(colour, "rgb", strict=True)])


def ring_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shapes, of which a third stay boxes, a third are their diamonds, and a third have a hole in their middle, bridged."""
    s = shapes(spark, sf_dir)
    x, y, w, h = (F.col(c).cast("double") for c in ("x", "y", "bw", "bh"))
    diamond = [(x + w / 2, y), (x + w, y + h / 2), (x + w / 2, y + h), (x, y + h / 2)]
    near, far = (x + w / 4, y + h / 4), (x + w / 2, y + h / 2)
    keyhole = [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y), near, (near[0], far[1]), far, (far[0], near[1]), near, (x, y)]
    made = [F.array(*[F.struct(a.alias("x"), b.alias("y")) for a, b in ring]) for ring in (diamond, keyhole)]
    return s.withColumn("ring", F.when(F.col("shape_id") % 3 == 1, made[0]).when(F.col("shape_id") % 3 == 2, made[1]))


def thumbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, y, x, v): the 8 x 8 raster of each embedding in long form."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    return e.selectExpr("vec_id", "i div 8 AS y", "i % 8 AS x", "cast(v AS double) AS v")


_PICK = "CASE k % 10 " + " ".join(f"WHEN {i} THEN {{}}" for i in range(10)) + " END"


def _channel(n: int) -> str:
    return f"least(255, greatest(0, {_PICK.format(*[p[n] for p in PALETTE])} + k % 25 - 12))::INTEGER"


SLIDES_SQL = """slides AS (
  SELECT image_id, j, (j % 3)::INTEGER AS group_id,
    CASE WHEN j % 17 = 0 THEN 'mystery_' || j || '.tiff' ELSE 'N' || (101 + j % 40) || '_S' || lpad((j % 12)::VARCHAR, 2, '0') || '_'
      || CASE j % 3 WHEN 0 THEN 'HE' WHEN 1 THEN 'PHH3' ELSE 'CD31' END || '.ome.tiff' END AS image_name,
    600 + 64 * (j % 13) AS width0, 500 + 48 * (j % 11) AS height0,
    CASE WHEN j % 19 = 0 THEN NULL WHEN j % 2 = 0 THEN 0.25::DOUBLE ELSE 0.5::DOUBLE END AS pixel_size
  FROM (SELECT p_partkey AS image_id, p_partkey AS j FROM part)
)"""
LEVELS_SQL = """levels AS (
  SELECT image_id, width0, height0, pixel_size, l.idx, width0 // l.d AS width, height0 // l.d AS height
  FROM slides, (VALUES (0, 1), (1, 2), (2, 4)) AS l(idx, d)
)"""
SHAPES_SQL = f"""shapes AS (
  SELECT image_id, k // 2 AS roi_id, shape_id, k, (k * 37 + c * 11) % (width0 - 200) AS x, (k * 53 + c * 7) % (height0 - 200) AS y,
    100 + (k * 13) % 100 AS bw, 80 + (k * 29) % 120 AS bh,
    CASE p WHEN '1' THEN 'Gleason 3' WHEN '2' THEN 'g4 cg' WHEN '3' THEN 'Pattern 5'
      WHEN '4' THEN CASE WHEN k % 3 = 0 THEN 'Exclusion ROI' ELSE 'weird label' END ELSE CASE WHEN k % 7 = 0 THEN NULL ELSE 'hgpin' END END AS text,
    {_channel(1)} AS r, {_channel(2)} AS g, {_channel(3)} AS b
  FROM (
    SELECT o_orderkey AS shape_id, o_orderkey AS k, o_custkey AS c, left(o_orderpriority, 1) AS p,
      o_orderkey % (SELECT count(*) FROM part) AS image_id
    FROM orders
  ) JOIN slides USING (image_id) WHERE image_id % 13 <> 0
)"""
#: Pixels of ring_shapes, at the slide's analysis scale: boxes as elsewhere, rings by the crossings of each row.
RING_PIXELS_SQL = """corners AS (
  SELECT n.image_id, shape_id, ads, tw, th, i,
    CASE WHEN shape_id % 3 = 1 THEN [x + bw / 2, x + bw, x + bw / 2, x][i + 1]
      ELSE [x, x + bw, x + bw, x, x, x + bw / 4, x + bw / 4, x + bw / 2, x + bw / 2, x + bw / 4, x][i + 1] END / ads AS px,
    CASE WHEN shape_id % 3 = 1 THEN [y, y + bh / 2, y + bh, y + bh / 2][i + 1]
      ELSE [y, y, y + bh, y + bh, y, y + bh / 4, y + bh / 2, y + bh / 2, y + bh / 4, y + bh / 4, y][i + 1] END / ads AS py,
    CASE WHEN shape_id % 3 = 1 THEN 4 ELSE 11 END AS n
  FROM shapes n JOIN (SELECT *, greatest(1, round_even(width0 / ads, 0))::BIGINT AS tw, greatest(1, round_even(height0 / ads, 0))::BIGINT AS th FROM scaled WHERE status = 'ok') USING (image_id),
    unnest(range(11)) AS t(i) WHERE shape_id % 3 > 0 AND (i < 4 OR shape_id % 3 = 2)
), edges AS (
  SELECT a.image_id, a.shape_id, a.tw, a.th, a.px AS ax, a.py AS ay, b.px AS bx, b.py AS by_ FROM corners a JOIN corners b ON a.shape_id = b.shape_id AND b.i = (a.i + 1) % a.n
), crossed AS (
  SELECT image_id, shape_id, tw, th, yy, ax + (yy - ay) * (bx - ax) / (by_ - ay) AS xx
  FROM (SELECT *, unnest(range(ceil(least(ay, by_))::BIGINT, ceil(greatest(ay, by_))::BIGINT)) AS yy FROM edges)
), spans AS (
  SELECT image_id, shape_id, tw, th, yy, ceil(xx)::BIGINT AS a, ceil(lead(xx) OVER w)::BIGINT AS b, row_number() OVER w AS k FROM crossed WINDOW w AS (PARTITION BY shape_id, yy ORDER BY xx)
), ring_pixels AS (
  SELECT image_id, shape_id, yy AS py, unnest(range(greatest(a, 0), least(b, tw))) AS px FROM spans WHERE k % 2 = 1 AND yy >= 0 AND yy < th
), box_pixels AS (
  SELECT image_id, shape_id, py, unnest(range(ax, ex)) AS px FROM (
    SELECT image_id, shape_id, ax, ex, unnest(range(ay, ey)) AS py FROM boxed WHERE shape_id % 3 = 0)
), every_pixel AS (
  SELECT p.*, folder, excluded FROM (SELECT * FROM ring_pixels UNION ALL SELECT image_id, shape_id, py, px FROM box_pixels) p JOIN named USING (image_id, shape_id)
)"""
ALIAS_SQL = "alias AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{f}')" for f, al in LABEL_MAP.items() for a in dict.fromkeys([f.lower(), *al])) + ") AS t(alias, folder))"
PALETTE_SQL = "palette AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{n}', {r}, {g}, {b})" for i, (n, r, g, b) in enumerate(PALETTE)) + ") AS t(pos, label, pr, pg, pb))"
THUMBS_SQL = """thumbs AS (
  SELECT vec_id, (i // 8)::INTEGER AS y, (i % 8)::INTEGER AS x, embedding[i + 1]::DOUBLE AS v
  FROM (SELECT vec_id, embedding, unnest(range(64)) AS i FROM embeddings)
)"""


def with_base(body: str, *parts: str) -> str:
    """A statement over the named derived relations."""
    known = {"slides": SLIDES_SQL, "levels": LEVELS_SQL, "shapes": SHAPES_SQL, "alias": ALIAS_SQL, "palette": PALETTE_SQL, "thumbs": THUMBS_SQL}
    return "WITH " + ",\n".join(known.get(p, p) for p in parts) + "\n" + body

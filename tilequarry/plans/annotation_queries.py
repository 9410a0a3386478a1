"""Queries over names, colours, labels, rings and GeoJSON annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rings as R
from ..operators import rules as RU
from ..operators import tiles as T
from . import derived as D
from .registry import registry
from .tile_queries import alias

QUERIES, ORACLES, query = registry()


@query(D.with_base("SELECT image_id, coalesce(nullif(upper(regexp_extract(trim(image_name), '(?i)^(N\\d+)_', 1)), ''), 'unknown_subject') AS subject FROM slides", "slides"))
def subject_parse(spark, sf):
    name = F.upper(F.regexp_extract(F.trim("image_name"), r"(?i)^(N\d+)(?=_)", 1))
    return D.slides(spark, sf).select("image_id", F.coalesce(F.nullif(name, F.lit("")), F.lit("unknown_subject")).alias("subject"))


@query("SELECT DISTINCT p_name AS name, coalesce(nullif(trim(regexp_replace(trim(p_name), '[^A-Za-z0-9._-]+', '_', 'g'), '._-'), ''), 'unlabeled') AS safe FROM part")
def safe_label(spark, sf):
    safe = F.btrim(F.regexp_replace(F.trim("p_name"), "[^A-Za-z0-9._-]+", "_"), F.lit("._-"))
    return D.table(spark, sf, "part").select(F.col("p_name").alias("name"), F.coalesce(F.nullif(safe, F.lit("")), F.lit("unlabeled")).alias("safe")).distinct()


@query(D.with_base("SELECT image_id, split_part(image_name, '.', 1) AS stem, 'LR10_' || split_part(image_name, '.', 1) || '_mask.png' AS out_name FROM slides", "slides"))
def stem_names(spark, sf):
    stem = F.substring_index("image_name", ".", 1)
    return D.slides(spark, sf).select("image_id", stem.alias("stem"), F.format_string("LR%d_%s_mask.png", F.lit(10), stem).alias("out_name"))


@query(
    "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_custkey WHEN 1 THEN c_custkey ELSE NULL END AS image_id FROM customer"
)
def uri_parse(spark, sf):
    uri = F.expr("CASE c_custkey % 4 WHEN 0 THEN concat('image://', c_custkey) WHEN 1 THEN concat('image:///', c_custkey, '/') WHEN 2 THEN cast(c_custkey AS string) ELSE concat('image://x', c_custkey) END")
    return D.table(spark, sf, "customer").select("c_custkey", F.nullif(F.regexp_extract(uri, r"^image:///*(\d+)/*$", 1), F.lit("")).cast("long").alias("image_id"))


PACK = "((r::BIGINT * 16777216 + g * 65536 + b * 256 + 255 + 2147483648) % 4294967296 - 2147483648)"


@query(D.with_base(f"SELECT shape_id, {PACK}::INTEGER AS packed, r AS r2, g AS g2, b AS b2, 255 AS a2 FROM shapes", "slides", "shapes"))
def color_unpack_pack(spark, sf):
    wide = F.expr("cast(r AS bigint) * 16777216 + g * 65536 + b * 256 + 255")
    s = D.shapes(spark, sf).withColumn("packed", F.when(wide >= 2**31, wide - 2**32).otherwise(wide).cast("int"))
    u = F.pmod(F.col("packed").cast("long"), F.lit(2**32))
    return s.select("shape_id", "packed", *[F.shiftright(u, k).bitwiseAND(255).cast("int").alias(n) for n, k in (("r2", 24), ("g2", 16), ("b2", 8), ("a2", 0))])


NEAREST = "LEFT JOIN palette ON abs(r - pr) <= 10 AND abs(g - pg) <= 10 AND abs(b - pb) <= 10"


def matched(spark: SparkSession, sf: str) -> DataFrame:
    """Shapes with the first palette entry within the tolerance of every channel; the palette is a fixed list."""
    palette = F.broadcast(spark.createDataFrame([(i, *p) for i, p in enumerate(D.PALETTE)], "pos int, label string, pr int, pg int, pb int"))
    s = D.shapes(spark, sf)
    close = (F.abs(F.col("r") - F.col("pr")) <= 10) & (F.abs(F.col("g") - F.col("pg")) <= 10) & (F.abs(F.col("b") - F.col("pb")) <= 10)
    return s.join(palette, close, "left").groupBy("image_id", "shape_id", "text").agg(F.min_by("label", "pos").alias("label"))


@query(D.with_base(f"SELECT shape_id, arg_min(label, pos) AS label FROM shapes {NEAREST} GROUP BY shape_id", "slides", "shapes", "palette"))
def palette_match(spark, sf):
    return matched(spark, sf).select("shape_id", "label")


@query(
    D.with_base(
        "SELECT image_id, count(*) FILTER (length(trim(coalesce(text, ''))) > 0) AS had_comment, count(*) FILTER (length(trim(coalesce(text, ''))) = 0 AND label IS NOT NULL) AS updated, "
        f"count(*) FILTER (length(trim(coalesce(text, ''))) = 0 AND label IS NULL) AS no_match FROM (SELECT image_id, shape_id, text, arg_min(label, pos) AS label FROM shapes {NEAREST} GROUP BY ALL) GROUP BY image_id",
        "slides",
        "shapes",
        "palette",
    )
)
def meta_fill_counts(spark, sf):
    has = F.length(F.trim(F.coalesce("text", F.lit("")))) > 0
    m = matched(spark, sf).groupBy("image_id")
    return m.agg(F.count_if(has).alias("had_comment"), F.count_if(~has & F.col("label").isNotNull()).alias("updated"), F.count_if(~has & F.col("label").isNull()).alias("no_match"))


@query(D.with_base("SELECT shape_id, folder FROM shapes LEFT JOIN alias ON lower(trim(text)) = alias.alias", "slides", "shapes", "alias"))
def label_lookup(spark, sf):
    return T.label_of(D.shapes(spark, sf), alias(spark), T.TileParams(exclusion="")).select("shape_id", "folder")


@query(D.with_base("SELECT shape_id, folder FROM (SELECT shape_id, CASE WHEN lower(text) = 'weird label' THEN 'weird_label' ELSE folder END AS folder FROM shapes LEFT JOIN alias ON lower(trim(text)) = alias.alias) WHERE folder IN ('G3', 'weird_label')", "slides", "shapes", "alias"))
def label_filter(spark, sf):
    return T.label_of(D.shapes(spark, sf), alias(spark), T.TileParams(text_filter=("g3", "Weird label"))).where("folder IS NOT NULL").select("shape_id", "folder")


@query(D.with_base("SELECT CASE WHEN lower(text) = 'exclusion roi' THEN NULL ELSE coalesce(folder, regexp_replace(trim(text), '[^A-Za-z0-9._-]+', '_', 'g')) END AS folder, count(*) AS shapes FROM shapes LEFT JOIN alias ON lower(trim(text)) = alias.alias GROUP BY 1", "slides", "shapes", "alias"))
def label_unmapped_all(spark, sf):
    return T.label_of(D.shapes(spark, sf), alias(spark), T.TileParams(include_all=True)).groupBy("folder").agg(F.count(F.lit(1)).alias("shapes"))


#: Ordered rules of a group: pattern, and the directory its parts give. The first match decides.
FS_RULES = [
    (0, r"^N(\d+)_S0*(\d+)_HE\.ome\.tiff$", "data/{1}/Hist/{2}"),
    (1, r"^N(\d+)_S0*(\d+)_(\w+)\.ome\.tiff$", "data/{1}/Hist/{2}/{3}"),
]


@query(
    D.with_base(
        "SELECT image_id, CASE WHEN image_name NOT LIKE 'N%' THEN NULL ELSE 'data/' || regexp_extract(image_name, '^N(\\d+)', 1) || '/Hist/' || (regexp_extract(image_name, '_S(\\d+)_', 1)::INTEGER)::VARCHAR "
        "|| CASE WHEN image_name LIKE '%\\_HE.%' ESCAPE '\\' THEN '' ELSE '/' || regexp_extract(image_name, '_([A-Z0-9]+)\\.ome', 1) END END AS dir FROM slides",
        "slides",
    )
)
def fs_rule_first_match(spark, sf):
    rules = F.broadcast(spark.createDataFrame(FS_RULES, "pos int, pattern string, template string"))
    hit = D.slides(spark, sf).join(rules, F.expr("image_name RLIKE pattern"), "left")
    first = hit.groupBy("image_id", "image_name").agg(F.min_by(F.struct("pattern", "template"), "pos").alias("rule"))
    part = lambda k: F.expr(f"regexp_extract(image_name, rule.pattern, {k})")
    he = F.concat(F.lit("data/"), part(1), F.lit("/Hist/"), part(2))
    return first.select("image_id", F.when(F.col("rule").isNull(), None).when(F.col("rule.template").contains("{3}"), F.concat(he, F.lit("/"), F.expr("CASE WHEN rule.template LIKE '%{3}' THEN regexp_extract(image_name, rule.pattern, 3) END"))).otherwise(he).alias("dir"))


def rule_table(spark: SparkSession, sf: str) -> DataFrame:
    """Two rules a region of the world, which is a group: a directory that ends with a case's number, then a plain one; group 2 has a base that is not there."""
    r = D.table(spark, sf, "region").where("r_regionkey < 3").select(F.col("r_regionkey").cast("int").alias("group_id"), F.concat(F.lit("/data/"), "r_name").alias("home"))

    def rule(pos: int, pattern: str, base: Column, template: str, suffix: int | None, names: list[str]) -> DataFrame:
        groups = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(k).alias("number")) for k, n in enumerate(names, 1)])
        return r.select("group_id", F.lit(pos).alias("pos"), F.lit(pattern).alias("pattern"), base.alias("base"), F.lit(template).alias("template"), F.lit(suffix).cast("int").alias("suffix"), groups.alias("groups"))

    case = rule(0, r"N(?<case>\d+)_S(?<slice>\d+)_(?<stain>[A-Z0-9]+)", F.col("home"), "slices/${slice}/${stain}", 1, ["case", "slice", "stain"])
    return case.unionByName(rule(1, r"(?<kind>[A-Za-z]+)\d*_", F.when(F.col("group_id") == 2, "/gone").otherwise(F.col("home")), "other/${kind}", None, ["kind"]))


def rule_dirs(spark: SparkSession, sf: str) -> DataFrame:
    """The bases, and below them two directories for most case numbers."""
    r = D.table(spark, sf, "region").where("r_regionkey < 3").selectExpr("concat('/data/', r_name) AS base")
    cases = D.slides(spark, sf).select(F.regexp_extract("image_name", r"^N(\d+)", 1).alias("n")).where("n <> '' AND n % 5 <> 0").distinct()
    below = r.join(F.broadcast(cases)).select(F.explode(F.array(F.concat("base", F.lit("/b_"), "n"), F.concat("base", F.lit("/a_"), "n"), F.concat("base", F.lit("/.h"), "n"))).alias("path"))
    return r.select(F.col("base").alias("path")).unionByName(below)


@query(
    D.with_base(
        """SELECT image_id, CASE WHEN image_name LIKE 'N%' AND n % 5 <> 0 THEN '/data/' || r_name || '/a_' || n || '/slices/' || regexp_extract(image_name, '_S(\\d+)_', 1) || '/' || regexp_extract(image_name, '_S\\d+_([A-Z0-9]+)', 1)
  WHEN group_id < 2 THEN '/data/' || r_name || '/other/' || regexp_extract(image_name, '^[A-Za-z]+', 0) END AS dir,
  CASE WHEN image_name LIKE 'N%' AND n % 5 <> 0 OR group_id < 2 THEN 'found' ELSE 'no_base' END AS status
FROM (SELECT *, try_cast(regexp_extract(image_name, '^N(\\d+)', 1) AS INTEGER) AS n FROM slides) JOIN region ON r_regionkey = group_id""",
        "slides",
    )
)
def directory_rules(spark, sf):
    """Output directories by rules, templates and directories that are rows of tables."""
    return RU.resolve_directories(D.slides(spark, sf), rule_table(spark, sf), rule_dirs(spark, sf))


FILES = """files AS (SELECT image_id, CASE WHEN j % 5 = 0 THEN lower(split_part(image_name, '.', 1)) || '_roi' ELSE lower(split_part(image_name, '.', 1)) END AS stem, 'f' || image_id || '.geojson' AS path FROM slides)"""


@query(
    D.with_base(
        "SELECT path, count(i.image_id) AS candidates, CASE WHEN count(i.image_id) = 1 THEN min(i.image_id) END AS image_id, CASE WHEN count(i.image_id) = 1 THEN 'pair' ELSE 'problem' END AS status FROM files f LEFT JOIN "
        "(SELECT image_id, lower(split_part(image_name, '.', 1)) AS istem FROM slides) i ON i.istem = f.stem OR (f.stem NOT IN (SELECT lower(split_part(image_name, '.', 1)) FROM slides) AND (starts_with(f.stem, i.istem) OR starts_with(i.istem, f.stem))) GROUP BY path",
        "slides",
        FILES,
    )
)
def name_match_unique(spark, sf):
    """Files to images by stem; without an equal stem by a stem that begins the other."""
    images = D.slides(spark, sf).select("image_id", "j", F.lower(F.substring_index("image_name", ".", 1)).alias("istem"))
    files = images.select(F.when(F.expr("j % 5 = 0"), F.concat("istem", F.lit("_roi"))).otherwise(F.col("istem")).alias("stem"), F.format_string("f%d.geojson", "image_id").alias("path"))
    return RU.match_names(files, images)


@query("SELECT o_orderkey AS image_id, arg_max(l_partkey, (size, -pos)) AS source FROM (SELECT *, CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE l_quantity END AS size, l_partkey * 100000000 + l_suppkey * 1000 + l_linenumber AS pos FROM orders JOIN lineitem ON l_orderkey = o_orderkey) GROUP BY o_orderkey")
def source_largest_file(spark, sf):
    files = D.table(spark, sf, "lineitem").selectExpr("l_orderkey AS o_orderkey", "l_partkey", "CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_quantity END AS size", "l_partkey * 100000000 + l_suppkey * 1000 + l_linenumber AS pos")
    j = D.table(spark, sf, "orders").select("o_orderkey").join(files, "o_orderkey")
    return j.groupBy(F.col("o_orderkey").alias("image_id")).agg(F.max_by("l_partkey", F.struct(F.coalesce("size", F.lit(0.0)), -F.col("pos"))).alias("source"))


@query(D.with_base("SELECT image_id FROM slides WHERE image_id NOT IN (SELECT image_id FROM shapes WHERE k % 3 = 0)", "slides", "shapes"))
def attachment_missing(spark, sf):
    return D.slides(spark, sf).join(D.shapes(spark, sf).where("k % 3 = 0"), "image_id", "left_anti").select("image_id")


@query(D.with_base("SELECT image_id, CASE WHEN j % 7 = 0 OR j % 5 = 0 THEN 'network' WHEN j % 4 = 1 AND j % 3 <> 0 THEN 'network' ELSE 'local' END AS tier FROM slides", "slides"))
def tier_choice(spark, sf):
    s = D.slides(spark, sf).selectExpr("image_id", "CASE WHEN j % 7 = 0 THEN NULL WHEN j % 4 = 1 THEN concat('/d/', j, '.JP2') ELSE concat('/d/', j, '.tiff') END AS path", "j % 5 <> 0 AS there", "j % 3 = 0 AS forced")
    slow = F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1)).isin("jp2", "j2k", "jpx")
    return s.select("image_id", F.when(F.col("path").isNull() | ~F.col("there"), "network").when(slow & ~F.col("forced"), "network").otherwise("local").alias("tier"))


@query(D.with_base("SELECT image_id, CASE WHEN j % 4 = 0 THEN '/out/LR10_' || split_part(image_name, '.', 1) || '.tiff' WHEN image_name LIKE 'N%' THEN '/map/LR10_' || split_part(image_name, '.', 1) || '.tiff' END AS path FROM slides", "slides"))
def output_path_choice(spark, sf):
    name = F.format_string("LR%d_%s.tiff", F.lit(10), F.substring_index("image_name", ".", 1))
    folder = F.coalesce(F.when(F.expr("j % 4 = 0"), "/out"), F.when(F.col("image_name").startswith("N"), "/map"))
    return D.slides(spark, sf).select("image_id", F.concat_ws("/", folder, name).alias("p"), folder.alias("f")).select("image_id", F.when(F.col("f").isNotNull(), F.col("p")).alias("path"))


@query(D.with_base("SELECT image_id, CASE WHEN j % 3 = 0 AND j % 11 <> 0 THEN 'attachment' WHEN j % 2 = 0 THEN 'local' ELSE 'network' END AS tier FROM slides", "slides"))
def recon_cascade(spark, sf):
    s = D.slides(spark, sf)
    attached = s.where("j % 3 = 0").select("image_id", F.lit("attachment").alias("a"))
    j = s.join(attached, "image_id", "left")
    return j.select("image_id", F.coalesce(F.when(F.expr("j % 11 <> 0"), F.col("a")), F.when(F.expr("j % 2 = 0"), "local"), F.lit("network")).alias("tier"))


@query(D.with_base("SELECT shape_id, x || ',' || y || ' ' || x || '.25,' || (y + bh) AS text, 2 AS n FROM shapes", "slides", "shapes"))
def points_text_roundtrip(spark, sf):
    s = D.shapes(spark, sf).select("shape_id", F.expr("concat(x, ',', y, ' oops ', x, '.25,', y + bh, ' 7')").alias("t"))
    ring = R.parse_points(F.col("t"))
    return s.select("shape_id", ring.alias("ring")).select("shape_id", R.format_points(F.col("ring")).alias("text"), F.size("ring").alias("n"))


@query(D.with_base("SELECT shape_id, 5 AS closed, 4 AS opened, (bw * bh)::DOUBLE AS area FROM shapes", "slides", "shapes"))
def ring_close_area(spark, sf):
    ring = R.rectangle(*[F.col(c) for c in ("x", "y", "bw", "bh")])
    s = D.shapes(spark, sf).select("shape_id", ring.alias("ring"))
    return s.select("shape_id", F.size(R.close_ring(R.open_ring(F.col("ring")))).alias("closed"), F.size(R.open_ring(F.col("ring"))).alias("opened"), R.signed_area(F.col("ring")).alias("area"))


@query(D.with_base("SELECT shape_id, i::INTEGER AS i, round(x + bw / 2 * cos(2 * pi() * i / 64), 2) + 0.0 AS px, round(y + bh / 2 * sin(2 * pi() * i / 64), 2) + 0.0 AS py FROM shapes, unnest(range(64)) AS t(i)", "slides", "shapes"))
def ellipse_ring(spark, sf):
    ring = R.ellipse(F.col("x").cast("double"), F.col("y").cast("double"), F.col("bw") / 2, F.col("bh") / 2)
    s = D.shapes(spark, sf).select("shape_id", F.posexplode(ring).alias("i", "p"))
    return s.select("shape_id", "i", (F.col("p.x") + 0.0).alias("px"), (F.col("p.y") + 0.0).alias("py"))


@query(D.with_base("SELECT shape_id, x || ',' || y || ' ' || (x + bw) || ',' || y || ' ' || (x + bw) || ',' || (y + bh) || ' ' || x || ',' || (y + bh) || ' ' || x || ',' || y AS text FROM shapes", "slides", "shapes"))
def rect_ring(spark, sf):
    return D.shapes(spark, sf).select("shape_id", R.format_points(R.rectangle(*[F.col(c) for c in ("x", "y", "bw", "bh")])).alias("text"))


@query(D.with_base("SELECT shape_id, 2 AS rings, bw * bh + (bw - 20) * (bh - 20) AS area FROM shapes", "slides", "shapes"))
def unbridge_ring(spark, sf):
    """Box with a box-shaped hole, bridged to one ring and taken apart again; the hole comes back wound the other way, here like the box."""
    s = D.shapes(spark, sf).select("shape_id", *[F.col(c).cast("double").alias(c) for c in ("x", "y", "bw", "bh")])
    outer, hole = R.rectangle(F.col("x"), F.col("y"), F.col("bw"), F.col("bh")), R.rectangle(F.col("x") + 10, F.col("y") + 10, F.col("bw") - 20, F.col("bh") - 20)
    # The hole runs the other way round; its first vertex is nearest to the outer ring's first.
    ring = F.concat(F.slice(outer, 1, 1), F.reverse(hole), outer)
    parts = s.select("shape_id", R.unbridge(ring).alias("parts"))
    area = F.aggregate("parts", F.lit(0.0), lambda a, r: a + R.signed_area(R.close_ring(r)))
    return parts.select("shape_id", F.size("parts").alias("rings"), area.cast("long").alias("area"))


HOLES = 3


@query(
    D.with_base(
        "SELECT shape_id, i::INTEGER AS ring, CASE i WHEN 0 THEN 4 ELSE 5 END AS points, CASE i WHEN 0 THEN (bw * bh)::DOUBLE ELSE (4 * i * 4 * i)::DOUBLE END AS area, "
        "CASE WHEN i = 0 THEN 4 + 18 END AS bridged FROM shapes, unnest(range(4)) AS t(i)",
        "slides",
        "shapes",
    )
)
def bridge_several(spark, sf):
    """Boxes with three square holes folded into one ring and taken apart again; holes come back closed."""
    s = D.shapes(spark, sf).select("shape_id", *[F.col(c).cast("double").alias(c) for c in ("x", "y", "bw", "bh")])
    outer = R.rectangle(F.col("x"), F.col("y"), F.col("bw"), F.col("bh"))
    # Each is nearest to a corner of its own.
    left, right, low, high = F.col("x") + 5, F.col("x") + F.col("bw") - 5, F.col("y") + 5, F.col("y") + F.col("bh") - 5
    holes = [R.rectangle(a, b, F.lit(n), F.lit(n)) for a, b, n in ((left, low, 4.0), (right - 8, low, 8.0), (left, high - 12, 12.0))]
    ring = s.select("shape_id", R.bridge_all(outer, F.array(*holes)).alias("ring"))
    parts = ring.select("shape_id", F.size("ring").alias("n"), R.unbridge(F.col("ring")).alias("parts"))
    area = lambda r: F.abs(R.signed_area(R.close_ring(r)))
    # Holes in order of their size.
    each = F.transform("parts", lambda r: F.struct(area(r).alias("area"), F.size(r).alias("points")))
    ordered = F.concat(F.slice(each, 1, 1), F.array_sort(F.slice(each, 2, HOLES)))
    out = parts.select("shape_id", "n", F.posexplode(ordered).alias("ring", "p"))
    return out.select("shape_id", "ring", "p.points", "p.area", F.when(F.col("ring") == 0, F.col("n")).alias("bridged"))


FEATURE = "struct<type:string,id:string,geometry:struct<type:string,coordinates:array<array<array<double>>>>,properties:struct<objectType:string,classification:struct<name:string,colorRGB:int>>>"


def feature_text(spark: SparkSession, sf: str) -> DataFrame:
    """(image_id, feature): one GeoJSON feature a shape; every 41st is broken."""
    ring = F.transform(R.rectangle(*[F.col(c) for c in ("x", "y", "bw", "bh")]), lambda p: F.array(p["x"], p["y"]))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    named = F.when(F.col("text").isNotNull(), F.struct(F.col("text").alias("name"), F.expr("r * 65536 + g * 256 + b").alias("colorRGB")))
    properties = F.struct(F.lit("annotation").alias("objectType"), named.alias("classification"))
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), F.format_string("s%d", "shape_id").alias("id"), geometry.alias("geometry"), properties.alias("properties")))
    return D.shapes(spark, sf).select("image_id", F.when(F.expr("k % 41 = 0"), F.substring(feature, 1, 40)).otherwise(feature).alias("feature"))


def features(spark: SparkSession, sf: str) -> DataFrame:
    return feature_text(spark, sf).select("image_id", F.from_json("feature", FEATURE).alias("f")).where("f.geometry.coordinates IS NOT NULL")


@query(D.with_base("SELECT image_id, 's' || shape_id AS id, text AS label, (bw * bh)::DOUBLE AS area, r, g, b FROM (SELECT image_id, shape_id, text, bw, bh, k, CASE WHEN text IS NOT NULL THEN r END AS r, CASE WHEN text IS NOT NULL THEN g END AS g, CASE WHEN text IS NOT NULL THEN b END AS b FROM shapes) WHERE k % 41 <> 0", "slides", "shapes"))
def geojson_flatten(spark, sf):
    ring = F.transform(F.col("f.geometry.coordinates")[0], lambda c: F.struct(c[0].alias("x"), c[1].alias("y")))
    rgb = F.col("f.properties.classification.colorRGB")
    channels = [F.shiftright(rgb, k).bitwiseAND(255).alias(n) for n, k in (("r", 16), ("g", 8), ("b", 0))]
    return features(spark, sf).select("image_id", F.col("f.id").alias("id"), F.col("f.properties.classification.name").alias("label"), R.signed_area(ring).alias("area"), *channels)


@query(D.with_base("SELECT image_id, count(*) AS n, min('s' || shape_id) AS first_id FROM shapes WHERE k % 41 <> 0 GROUP BY image_id", "slides", "shapes"))
def geojson_rebuild(spark, sf):
    """One FeatureCollection a slide, written as text and read again."""
    one = features(spark, sf).groupBy("image_id").agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.collect_list("f").alias("features"))).alias("doc"))
    back = one.select("image_id", F.from_json("doc", f"struct<type:string,features:array<{FEATURE}>>").alias("d"))
    return back.select("image_id", F.size("d.features").cast("long").alias("n"), F.array_min(F.transform("d.features", lambda f: f["id"])).alias("first_id"))


@query(D.with_base("SELECT image_id, count(*) AS features, array_to_string(list_sort(list_distinct(list(text))), '|') AS classes, 0 AS holed FROM shapes WHERE k % 41 <> 0 GROUP BY image_id", "slides", "shapes"))
def geojson_summary(spark, sf):
    f = features(spark, sf).groupBy("image_id")
    return f.agg(F.count(F.lit(1)).alias("features"), F.array_join(F.array_sort(F.collect_set("f.properties.classification.name")), "|").alias("classes"), F.count_if(F.size("f.geometry.coordinates") > 1).cast("int").alias("holed"))


@query(D.with_base("SELECT shape_id, CASE WHEN k % 3 = 2 THEN NULL ELSE text END AS name, CASE WHEN k % 3 = 1 THEN r END AS r FROM shapes", "slides", "shapes"))
def classification_parse(spark, sf):
    """Classification as a plain string, as an object with a colour, or as something else."""
    value = F.expr("CASE k % 3 WHEN 0 THEN to_json(struct(text AS classification)) WHEN 1 THEN to_json(struct(struct(text AS name, array(r, g, b) AS color) AS classification)) ELSE '{\"classification\": 5}' END")
    s = D.shapes(spark, sf).select("shape_id", F.expr("k % 3").alias("kind"), F.get_json_object(value, "$.classification").alias("c"))
    nested = F.from_json("c", "struct<name:string,color:array<int>>")
    return s.select("shape_id", F.when(F.col("c").startswith("{"), nested["name"]).when(F.col("c").rlike("^[0-9.]+$"), None).otherwise(F.col("c")).alias("name"), F.when(F.col("c").startswith("{"), F.get(nested["color"], F.lit(0))).alias("r"))


@query(D.with_base("SELECT shape_id, CASE WHEN k % 4 = 0 THEN 'a' || k END AS source FROM shapes", "slides", "shapes"))
def provenance_guard(spark, sf):
    text = F.expr("CASE WHEN k % 4 = 0 THEN to_json(struct('annotation' AS tag, concat('a', k) AS source)) WHEN k % 4 = 1 THEN to_json(struct('other' AS tag, concat('a', k) AS source)) WHEN k % 4 = 2 THEN '{bad' END")
    p = D.shapes(spark, sf).select("shape_id", F.from_json(text, "struct<tag:string,source:string>").alias("p"))
    return p.select("shape_id", F.when(F.col("p.tag") == "annotation", F.col("p.source")).alias("source"))

"""Queries over file contents and stored outputs: strict manifests, GeoJSON containers, maps, slices, attachments."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import rings as R
from ..sources import files as S
from . import derived as D
from .registry import registry

QUERIES, ORACLES, query = registry()
KEPT = ["l_linenumber", "l_partkey", "l_suppkey"]


@query(
    "SELECT l_orderkey, reason, count(*) AS n FROM (SELECT l_orderkey, CASE WHEN r = 1 AND l_orderkey % 5 = 0 THEN 'unterminated' WHEN l_linenumber = 3 THEN 'fields' ELSE 'accepted' END AS reason "
    "FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC) AS r FROM lineitem)) GROUP BY ALL"
)
def strict_manifest(spark, sf):
    """One manifest file an order: line 3 has a field too many, and every fifth file does not end in a line end."""
    cells = F.concat_ws(",", *KEPT, F.when(F.col("l_linenumber") == 3, "extra"))
    lines = D.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(*KEPT, cells.alias("t")))).alias("r"))
    end = F.when(F.col("l_orderkey") % 5 == 0, "").otherwise("\n")
    text = F.concat(F.lit("number,part,supplier\n"), F.array_join(F.transform("r", lambda x: x["t"]), "\n"), end)
    rows = S.strict_manifest(lines.select(F.col("l_orderkey").cast("string").alias("path"), text.alias("text")))
    return rows.groupBy(F.col("path").cast("long").alias("l_orderkey"), F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(
    D.with_base(
        "SELECT shape_id, CASE k % 5 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 3 END AS n, CASE k % 5 WHEN 3 THEN 'malformed' WHEN 4 THEN 'not GeoJSON features' END AS reason FROM shapes",
        "slides",
        "shapes",
    )
)
def geojson_containers(spark, sf):
    s = D.shapes(spark, sf)
    one = F.to_json(F.struct(F.lit("Feature").alias("type"), F.col("shape_id").cast("string").alias("id")))
    kind = F.col("k") % 5
    text = F.when(kind == 0, F.concat(F.lit('{"type": "FeatureCollection", "features": ['), one, F.lit(","), one, F.lit("]}"))).when(kind == 1, one)
    text = text.when(kind == 2, F.concat(F.lit(" ["), F.array_join(F.array(one, one, one), ","), F.lit("]"))).when(kind == 3, F.substring(one, 1, 12)).otherwise('{"type": "Point"}')
    found, reason = S.geojson_features(F.col("text"))
    return s.select("shape_id", text.alias("text")).select("shape_id", F.when(found.isNotNull(), F.size(found)).alias("n"), reason.alias("reason"))


@query(
    "SELECT c_custkey + 1 AS line, c_name AS path, CASE WHEN c_custkey % 7 = 3 THEN NULL ELSE c_custkey END AS image_id, CASE WHEN c_custkey % 7 = 3 THEN 'bad image id' END AS reason "
    "FROM customer WHERE c_custkey % 11 <> 5 AND c_custkey > 0"
)
def image_map_lines(spark, sf):
    """Line 1 is a header; some lines are comments, some have no image number."""
    c = F.col("c_custkey")
    pair = F.concat("c_name", F.lit(", "), F.when(c % 7 == 3, "none").otherwise(c.cast("string")))
    text = F.when(c == 0, "path,image_id").when(c % 11 == 5, F.concat(F.lit("# "), pair)).otherwise(pair)
    return S.image_map(D.table(spark, sf, "customer").select((c + 1).alias("line"), text.alias("text")))


SLICES = "(SELECT conv_id, turn, CASE WHEN conv_id % 3 = 1 AND turn % 2 = 1 THEN NULL ELSE (turn * 7 + conv_id) % 5 END AS z, CASE WHEN conv_id % 2 = 1 AND turn = 0 THEN NULL ELSE 100 - turn END AS number FROM conversations)"


@query(
    "SELECT conv_id, turn, rule, CASE WHEN rule <> 'unordered' THEN row_number() OVER (PARTITION BY conv_id ORDER BY CASE rule WHEN 'position' THEN z WHEN 'number' THEN number END, turn) END::INTEGER AS place "
    f"FROM (SELECT *, CASE WHEN bool_and(z IS NOT NULL) OVER w THEN 'position' WHEN bool_and(number IS NOT NULL) OVER w THEN 'number' ELSE 'unordered' END AS rule FROM {SLICES} WINDOW w AS (PARTITION BY conv_id))"
)
def slice_order(spark, sf):
    """Slices of a series by position if all have one, else by number if all have one, else not at all."""
    c, t = F.col("conv_id"), F.col("turn")
    z, number = F.when(~((c % 3 == 1) & (t % 2 == 1)), (t * 7 + c) % 5), F.when(~((c % 2 == 1) & (t == 0)), 100 - t)
    s = D.table(spark, sf, "conversations").select("conv_id", "turn", z.alias("z"), number.alias("number"))
    every = lambda name: F.bool_and(F.col(name).isNotNull()).over(W.partitionBy("conv_id"))
    s = s.withColumn("rule", F.when(every("z"), "position").when(every("number"), "number").otherwise("unordered"))
    key = F.when(F.col("rule") == "position", F.col("z")).when(F.col("rule") == "number", F.col("number"))
    place = F.row_number().over(W.partitionBy("conv_id").orderBy(key, "turn"))
    return s.select("conv_id", "turn", "rule", F.when(F.col("rule") != "unordered", place).alias("place"))


@query(
    D.with_base(
        "SELECT image_id, min(reader) FILTER (ok) AS reader FROM (SELECT image_id, reader, bool_and(CASE reader WHEN 0 THEN (image_id + idx) % 4 <> 0 WHEN 1 THEN idx < 2 OR image_id % 3 = 0 ELSE width > 200 END) AS ok "
        "FROM levels, (VALUES (0), (1), (2)) AS r(reader) GROUP BY ALL) GROUP BY image_id",
        "slides",
        "levels",
    )
)
def reader_probe(spark, sf):
    """The first reader, in order of preference, that can read every level of a slide."""
    able = F.expr("CASE reader WHEN 0 THEN (image_id + idx) % 4 <> 0 WHEN 1 THEN idx < 2 OR image_id % 3 = 0 ELSE width > 200 END")
    probes = D.levels(spark, sf).select("*", F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("reader")).groupBy("image_id", "reader").agg(F.bool_and(able).alias("ok"))
    return probes.groupBy("image_id").agg(F.min(F.when(F.col("ok"), F.col("reader"))).alias("reader"))


@query(
    "WITH old AS (SELECT o_orderkey AS image_id, 'mask' || o_custkey % 3 AS name, 0 AS version FROM orders), fresh AS (SELECT o_orderkey AS image_id, 'mask' || o_custkey % 2 AS name, 1 AS version FROM orders WHERE o_orderkey % 4 = 0) "
    "SELECT * FROM old WHERE NOT EXISTS (SELECT 1 FROM fresh WHERE fresh.image_id = old.image_id AND fresh.name = old.name) UNION ALL SELECT * FROM fresh"
)
def attachment_upsert(spark, sf):
    """New attachments replace those of the same image and name; the others stay."""
    o = D.table(spark, sf, "orders")
    name = lambda n: F.concat(F.lit("mask"), (F.col("o_custkey") % n).cast("string")).alias("name")
    old = o.select(F.col("o_orderkey").alias("image_id"), name(3), F.lit(0).alias("version"))
    fresh = o.where("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("image_id"), name(2), F.lit(1).alias("version"))
    return old.join(fresh, ["image_id", "name"], "left_anti").unionByName(fresh)


@query(D.with_base("SELECT shape_id, 10 AS points, bw * bh - (bw - 20) * (bh - 20) AS area FROM shapes", "slides", "shapes"))
def bridge_single(spark, sf):
    """A box and a box-shaped hole, both wound alike, joined to one ring."""
    s = D.shapes(spark, sf).select("shape_id", *[F.col(c).cast("double").alias(c) for c in ("x", "y", "bw", "bh")])
    outer, hole = R.rectangle(F.col("x"), F.col("y"), F.col("bw"), F.col("bh")), R.rectangle(F.col("x") + 10, F.col("y") + 10, F.col("bw") - 20, F.col("bh") - 20)
    ring = s.select("shape_id", R.bridge(outer, hole).alias("ring"))
    return ring.select("shape_id", F.size("ring").alias("points"), F.abs(R.signed_area(R.close_ring(F.col("ring")))).cast("long").alias("area"))


@query(
    D.with_base(
        "SELECT roi_id, CASE WHEN points > 0 AND boxes > 0 THEN 'GeometryCollection' WHEN points + boxes = 1 THEN CASE WHEN points = 1 THEN 'Point' ELSE 'Polygon' END "
        "WHEN points > 0 THEN 'MultiPoint' ELSE 'MultiPolygon' END AS type, points + boxes AS parts FROM (SELECT image_id, roi_id, count(*) FILTER (k % 3 = 0) AS points, count(*) FILTER (k % 3 <> 0) AS boxes FROM shapes GROUP BY ALL)",
        "slides",
        "shapes",
    )
)
def merged_geometry(spark, sf):
    """Shapes of one annotation as one geometry: several of a kind a Multi, several kinds a collection."""
    kind = F.when(F.col("k") % 3 == 0, "Point").otherwise("Polygon")
    by_kind = D.shapes(spark, sf).groupBy("image_id", "roi_id", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    merged = by_kind.groupBy("image_id", "roi_id").agg(F.count(F.lit(1)).alias("kinds"), F.first("kind").alias("kind"), F.sum("n").alias("parts"))
    name = F.when(F.col("kinds") > 1, "GeometryCollection").when(F.col("parts") == 1, F.col("kind")).otherwise(F.concat(F.lit("Multi"), F.col("kind")))
    return merged.select("roi_id", name.alias("type"), "parts")

"""Queries over manifests, samples, splits and run reports."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import manifests as M
from ..operators import samples as SA
from ..sources.merge import merge_run, read_part
from ..sources.scratch import fresh_path, materialize
from ..streaming.manifest import append_stream, read_manifest
from . import derived as D
from .registry import registry
from .tile_queries import ALL_LABELLED, labelled

QUERIES, ORACLES, query = registry()
KEYS = ["l_orderkey", "l_linenumber"]
REST = ["l_partkey", "l_suppkey", "l_returnflag", "l_linestatus"]
ORDER = [*REST, "l_quantity", "l_extendedprice", "l_shipdate"]
TEXT = " || '/' || ".join(f"{c}::VARCHAR" for c in REST)
CLASSIFIED = f"""rows_ AS (SELECT *, {TEXT} AS t, l_orderkey % 4 = 0 AND l_partkey % 2 = 0 AS old FROM lineitem
), held AS (SELECT l_orderkey, l_linenumber, arg_min(t, (l_partkey, l_suppkey, l_returnflag, l_linestatus)) AS h FROM rows_ WHERE old GROUP BY ALL
), seen AS (SELECT r.*, h, row_number() OVER w AS n, first_value(t) OVER w AS f FROM (SELECT * FROM rows_ WHERE NOT old) r LEFT JOIN held USING (l_orderkey, l_linenumber)
  WINDOW w AS (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_returnflag, l_linestatus, l_quantity, l_extendedprice, l_shipdate)
), classified AS (SELECT *, CASE WHEN h IS NULL AND n = 1 THEN 'appended' WHEN t = coalesce(h, f) THEN 'identical' ELSE 'conflicting' END AS status FROM seen)"""


def manifest(spark, sf):
    """(existing, incoming): a manifest with one row a key, and later rows, some with the same keys."""
    rows = D.table(spark, sf, "lineitem")
    old = F.expr("l_orderkey % 4 = 0 AND l_partkey % 2 = 0")
    first = rows.where(old).groupBy(*KEYS).agg(F.min(F.struct(*REST)).alias("r")).select(*KEYS, "r.*")
    return first, rows.where(~old)


def classified(spark, sf):
    existing, incoming = manifest(spark, sf)
    return M.classify(incoming, existing, KEYS, REST, ORDER)


@query(f"WITH {CLASSIFIED} SELECT l_orderkey, l_linenumber, status, count(*) AS n FROM classified GROUP BY ALL")
def manifest_append_classify(spark, sf):
    return classified(spark, sf).groupBy(*KEYS, "status").agg(F.count(F.lit(1)).alias("n"))


#: Rows keyed by a path that every third one lacks; those go by order and line.
BLANK = """rows_ AS (SELECT *, CASE WHEN l_orderkey % 3 = 0 THEN NULL WHEN l_orderkey % 3 = 1 THEN '' ELSE 'p' || l_orderkey || '_' || l_linenumber % 2 END AS path, l_partkey || '/' || l_suppkey AS t FROM lineitem
), keyed AS (SELECT *, CASE WHEN coalesce(path, '') = '' THEN 'f' || l_orderkey || '/' || l_linenumber ELSE path END AS key FROM rows_
), first AS (SELECT key, arg_min(t, (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)) AS t FROM keyed GROUP BY key
), again AS (SELECT k.path IS NULL OR k.path = '' AS blank, CASE WHEN k.t = f.t THEN 'identical' ELSE 'conflicting' END AS status FROM keyed k JOIN first f USING (key))"""


@query(f"WITH {BLANK} SELECT blank, status, count(*) AS n FROM again GROUP BY ALL")
def manifest_blank_keys(spark, sf):
    """Rows sent a second time, some without a key: nothing is appended again."""
    path = F.expr("CASE l_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat('p', l_orderkey, '_', l_linenumber % 2) END")
    rows = D.table(spark, sf, "lineitem").withColumn("path", path)
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    columns, fallback = ["l_partkey", "l_suppkey"], ["l_orderkey", "l_linenumber"]
    none = spark.createDataFrame([], rows.select("path", *columns, *fallback).schema)
    held = M.classify(rows, none, ["path"], columns, order, fallback).where("status = 'appended'").select(*none.columns)
    again = M.classify(rows, materialize(held), ["path"], columns, order, fallback)
    return again.groupBy((F.coalesce("path", F.lit("")) == "").alias("blank"), "status").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {CLASSIFIED} SELECT status, count(*) AS n FROM classified GROUP BY status")
def manifest_merge_report(spark, sf):
    return classified(spark, sf).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {CLASSIFIED} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'conflicting' AS reason FROM classified WHERE status = 'conflicting'")
def manifest_quarantine(spark, sf):
    return classified(spark, sf).where("status = 'conflicting'").select(*KEYS, "l_partkey", "l_suppkey", F.col("status").alias("reason"))


@query(D.with_base("SELECT image_id, CASE WHEN j % 4 = 0 THEN 'run' WHEN j % 4 = 1 AND j % 3 = 0 THEN 'skip_same' WHEN j % 4 = 1 THEN 'skip_different' WHEN j % 4 = 2 AND j % 3 = 0 THEN 'resume' ELSE 'run' END AS action FROM slides", "slides"))
def skip_resume_decision(spark, sf):
    """Saved runs against the wanted parameters: complete runs are skipped, an equal unfinished one goes on."""
    s = D.slides(spark, sf)
    runs = s.where("j % 4 IN (1, 2)").selectExpr("image_id", "CASE j % 4 WHEN 1 THEN 'complete' ELSE 'in_progress' END AS state", "concat('sig', j % 3) AS signature")
    j = s.join(runs, "image_id", "left").withColumn("same", F.col("signature") == "sig0")
    return j.select("image_id", F.when(F.col("state").isNull(), "run").when((F.col("state") == "complete") & F.col("same"), "skip_same").when(F.col("state") == "complete", "skip_different").when(F.col("same"), "resume").otherwise("run").alias("action"))


@query("SELECT c_custkey AS image_id, CASE WHEN c_custkey % 6 = 0 THEN -1 ELSE c_custkey // 2 END AS roi_id, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal END AS mpp, c_mktsegment AS label FROM customer")
def manifest_samples_single(spark, sf):
    text = D.table(spark, sf, "customer").selectExpr("cast(c_custkey AS string) AS image_id", "CASE WHEN c_custkey % 6 = 0 THEN '' ELSE cast(c_custkey div 2 AS string) END AS roi_id", "CASE WHEN c_custkey % 5 = 0 THEN '' ELSE cast(c_acctbal AS string) END AS mpp", "c_mktsegment AS label")
    return text.selectExpr("cast(image_id AS bigint) AS image_id", "coalesce(try_cast(roi_id AS bigint), -1) AS roi_id", "coalesce(try_cast(mpp AS double), double('NaN')) AS mpp", "label")


@query("SELECT l_orderkey, l_partkey, count(*) AS scales, string_agg(scale::VARCHAR, '|' ORDER BY scale) AS list FROM (SELECT DISTINCT l_orderkey, l_partkey % 7 AS l_partkey, l_linenumber % 3 AS scale FROM lineitem) GROUP BY ALL HAVING count(*) = 3")
def manifest_samples_multi(spark, sf):
    """Crops of one place at several scales; the first of a scale stays, incomplete sets go."""
    l = D.table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_partkey % 7 AS l_partkey", "l_linenumber % 3 AS scale").distinct()
    g = l.groupBy("l_orderkey", "l_partkey").agg(F.count(F.lit(1)).alias("scales"), F.array_join(F.array_sort(F.collect_list("scale")), "|").alias("list"))
    return g.where("scales = 3")


@query("SELECT string_agg(DISTINCT c_mktsegment, '|' ORDER BY c_mktsegment) AS classes, count(DISTINCT c_mktsegment) AS n FROM customer")
def class_list(spark, sf):
    return D.table(spark, sf, "customer").agg(F.array_join(F.array_sort(F.collect_set("c_mktsegment")), "|").alias("classes"), F.count_distinct("c_mktsegment").alias("n"))


@query("SELECT conv_id, count(*) AS tiles, string_agg(role, '|' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id")
def case_groups(spark, sf):
    g = D.table(spark, sf, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("tiles"), F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("r"))
    return g.select("conv_id", "tiles", F.array_join(F.transform("r", lambda x: x["role"]), "|").alias("roles"))


@query("SELECT conv_id, turn, CASE WHEN rn <= floor(n * 0.25) THEN 'test' WHEN rn <= floor(n * 0.25) * 2 THEN 'val' ELSE 'train' END AS section FROM conversations JOIN (SELECT conv_id, row_number() OVER (ORDER BY md5('7|' || conv_id)) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT conv_id FROM conversations)) USING (conv_id)")
def case_split_hash(spark, sf):
    """Cases split by a seeded order; the place of a case comes from counts of hash buckets, not from one sort."""
    rows = D.table(spark, sf, "conversations")
    cases = rows.select("conv_id").distinct().withColumn("h", F.md5(F.concat(F.lit("7|"), F.col("conv_id").cast("string")).cast("binary")))
    cases = cases.withColumn("bucket", F.substring("h", 1, 2))
    counts = cases.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))  # 256 rows at most
    starts = counts.select("bucket", (F.sum("n").over(W.orderBy("bucket")) - F.col("n")).alias("start"), F.sum("n").over(W.partitionBy()).alias("total"))
    ranked = cases.withColumn("r", F.row_number().over(W.partitionBy("bucket").orderBy("h"))).join(F.broadcast(starts), "bucket")
    place, part = F.col("r") + F.col("start"), F.floor(F.col("total") * 0.25)
    section = F.when(place <= part, "test").when(place <= part * 2, "val").otherwise("train")
    return rows.join(ranked.select("conv_id", section.alias("section")), "conv_id").select("conv_id", "turn", "section")


RESULT = """results AS (SELECT image_id, CASE WHEN j % 19 = 0 THEN 'failed' WHEN j % 13 = 0 THEN 'unannotated' WHEN j % 7 = 0 THEN 'skipped' ELSE 'done' END AS status,
  CASE WHEN j % 3 = 0 THEN 'network' ELSE 'local' END AS tier, CASE WHEN j % 19 = 0 THEN CASE j % 4 WHEN 0 THEN 'IOError: disk ' || j % 5 WHEN 1 THEN 'no pixel size: none' WHEN 2 THEN 'Timeout: slow' ELSE 'odd' END END AS reason FROM slides)"""


def results(spark, sf):
    return D.slides(spark, sf).selectExpr(
        "image_id",
        "CASE WHEN j % 19 = 0 THEN 'failed' WHEN j % 13 = 0 THEN 'unannotated' WHEN j % 7 = 0 THEN 'skipped' ELSE 'done' END AS status",
        "CASE WHEN j % 3 = 0 THEN 'network' ELSE 'local' END AS tier",
        "CASE WHEN j % 19 = 0 THEN CASE j % 4 WHEN 0 THEN concat('IOError: disk ', j % 5) WHEN 1 THEN 'no pixel size: none' WHEN 2 THEN 'Timeout: slow' ELSE 'odd' END END AS reason",
    )


@query(D.with_base("SELECT coalesce(status, 'all') AS status, coalesce(tier, 'all') AS tier, count(*) AS n FROM results GROUP BY GROUPING SETS ((status), (tier), ())", "slides", RESULT))
def batch_status_summary(spark, sf):
    r = results(spark, sf).groupingSets([["status"], ["tier"], []], "status", "tier").agg(F.count(F.lit(1)).alias("n"))
    return r.select(F.coalesce("status", F.lit("all")).alias("status"), F.coalesce("tier", F.lit("all")).alias("tier"), "n")


@query(D.with_base("SELECT type, count(*) AS n FROM (SELECT CASE WHEN contains(reason, ':') AND NOT contains(split_part(reason, ':', 1), ' ') THEN split_part(reason, ':', 1) ELSE reason END AS type FROM results WHERE reason IS NOT NULL) GROUP BY type ORDER BY n DESC, type LIMIT 5", "slides", RESULT))
def failure_top_reasons(spark, sf):
    head = F.substring_index("reason", ":", 1)
    kind = F.when(F.col("reason").contains(":") & ~head.contains(" "), head).otherwise(F.col("reason")).alias("type")
    return results(spark, sf).where("reason IS NOT NULL").groupBy(kind).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "type").limit(5)


@query(D.with_base("SELECT tier, outcome, count(*) AS tiles FROM labelled JOIN results USING (image_id) WHERE status = 'done' GROUP BY ALL", *ALL_LABELLED, RESULT))
def tier_breakdown(spark, sf):
    r = results(spark, sf).where("status = 'done'").select("image_id", "tier")
    return labelled(spark, sf).groupBy("image_id", "outcome").agg(F.count(F.lit(1)).alias("n")).join(r, "image_id").groupBy("tier", "outcome").agg(F.sum("n").alias("tiles"))


@query("SELECT user_id, event_type, count(*) AS n, min(event_id) AS first_event FROM events GROUP BY ALL")
def stream_manifest_append(spark, sf):
    """Events appended by a file stream, twice; the second run adds nothing."""
    base = fresh_path(spark, "stream")
    schema = D.table(spark, sf, "events").schema
    for run in range(2):
        stream = spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*")
        append_stream(stream, f"{base}/manifest", f"{base}/checkpoint{run}", f"run{run}", ["event_id"], ["user_id", "event_type"], ["event_id"])
    rows = read_manifest(spark, f"{base}/manifest", stream.select("event_id", "user_id", "event_type").schema)
    return rows.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"))


#: Manifest rows of crops: the line's number gives the scale; every eleventh part has a plain file name, every seventh supplier none.
CROPS = """rows_ AS (
  SELECT l_orderkey AS image_id, l_partkey % 3 * 64 AS x, l_suppkey % 2 * 64 AS y, l_returnflag AS label, 32 AS size, CASE l_linenumber % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 1 ELSE 2 END::DOUBLE AS mpp,
    l_partkey % 11 = 0 AS plain, l_suppkey % 7 = 0 AS none, CASE WHEN l_partkey % 4 = 0 THEN -1 ELSE l_suppkey END AS roi_id,
    'N' || l_orderkey || '/' || l_partkey || '_' || l_suppkey || '_' || l_linenumber AS stem,
    row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS pos FROM lineitem
), read_ AS (
  SELECT *, CASE WHEN plain THEN stem || '.png' ELSE stem || '_x' || x || '_y' || y || '_mpp' || mpp || '.png' END AS tile_path FROM rows_ WHERE NOT none
), first_ AS (
  SELECT image_id, x, y, label, size, mpp, arg_min(tile_path, pos) AS tile_path, arg_min(roi_id, pos) AS roi_id, count(*) - 1 AS again FROM read_ WHERE NOT plain AND {wanted} GROUP BY ALL
), places AS (
  SELECT image_id, x, y, label, size, list({{'mpp': mpp, 'tile_path': tile_path, 'roi_id': roi_id}} ORDER BY mpp) AS crops, sum(again) AS again FROM first_ GROUP BY ALL
)"""


def crop_rows(spark, sf):
    """The rows as text, and their order."""
    l = D.table(spark, sf, "lineitem")
    t = l.selectExpr("*", "cast(l_partkey % 3 * 64 AS string) AS x", "cast(l_suppkey % 2 * 64 AS string) AS y", "CASE l_linenumber % 3 WHEN 0 THEN '0.5' WHEN 1 THEN '1.0' ELSE '2.0' END AS mpp")
    stem = F.concat(F.lit("N"), "l_orderkey", F.lit("/"), F.concat_ws("_", "l_partkey", "l_suppkey", "l_linenumber"))
    named = F.concat(stem, F.lit("_x"), "x", F.lit("_y"), "y", F.lit("_mpp"), "mpp", F.lit(".png"))
    path = F.when(F.expr("l_suppkey % 7 = 0"), "").when(F.expr("l_partkey % 11 = 0"), F.concat(stem, F.lit(".png"))).otherwise(named)
    roi = F.expr("CASE WHEN l_partkey % 4 = 0 THEN '' ELSE cast(l_suppkey AS string) END")
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    rows = t.select(F.col("l_orderkey").cast("string").alias("image_id"), "x", "y", F.col("l_returnflag").alias("label"), F.lit("32").alias("size"), "mpp", roi.alias("roi_id"), path.alias("tile_path"), order.alias("pos"))
    return rows, F.col("pos")


@query(
    f"WITH {CROPS.format(wanted='mpp IN (0.5, 2)')} SELECT image_id, x, y, label, size::BIGINT AS size, crops[1].roi_id AS roi_id, crops[1].mpp AS mpp, crops[1].tile_path AS image, crops[2].tile_path AS second, "
    "crops[1].mpp::VARCHAR || '|' || crops[2].mpp::VARCHAR AS scales FROM places WHERE len(crops) = 2"
)
def manifest_samples_scaled(spark, sf):
    """Samples of two scales out of three: plain files and places that lack a crop are left out."""
    rows, order = crop_rows(spark, sf)
    s = SA.read_samples(rows, order, scales=[0.5, 2.0])
    return s.select("image_id", "x", "y", "label", "size", "roi_id", "mpp", "image", F.get("images", F.lit(0)).alias("second"), F.array_join(F.transform("scales", lambda v: v.cast("string")), "|").alias("scales"))


def report_sql(name: str, wanted: str, n_scales: int, where: str = "") -> str:
    conflict = "CASE WHEN places > 0 AND singles > 0 THEN 'single crops beside crops at several scales' WHEN scale_sets > 1 THEN 'places with different scales' END" if not n_scales else "NULL::VARCHAR"
    left = "CASE WHEN places > 0 AND singles > 0 THEN singles ELSE 0 END" if n_scales > 1 else "0"
    short = f"count(*) FILTER (len(crops) <> {n_scales})" if n_scales else "0"
    return f"""SELECT '{name}' AS mode, coords_only, other_classes, singles, places, repeated, incomplete, scale_sets, ({left})::BIGINT AS singles_left_out, {conflict} AS conflict FROM (
  WITH {CROPS.format(wanted=wanted + where)}
  SELECT (SELECT count(*) FROM rows_ WHERE none) AS coords_only, (SELECT count(*) FROM rows_ WHERE NOT none AND NOT (true {where})) AS other_classes,
    (SELECT count(*) FROM read_ WHERE plain AND {wanted} {where}) AS singles, count(*) AS places, coalesce(sum(again), 0)::BIGINT AS repeated, ({short})::BIGINT AS incomplete,
    count(DISTINCT list_transform(crops, lambda c: c.mpp)) AS scale_sets FROM places)"""


@query(" UNION ALL ".join([report_sql("all", "true", 0), report_sql("one", "mpp = 1", 1), report_sql("two", "mpp IN (0.5, 2)", 2), report_sql("class", "mpp IN (0.5, 2)", 2, " AND label = 'R'")]))
def manifest_sample_report(spark, sf):
    """What reading the crops leaves out, and what forbids it, for four ways to ask."""
    rows, _ = crop_rows(spark, sf)
    return SA.sample_reports(rows, {"all": (None, None), "one": ([1.0], None), "two": ([0.5, 2.0], None), "class": ([0.5, 2.0], ["R"])})


@query(
    f"""WITH {BLANK}, shard AS (SELECT *, l_suppkey % 5 = 0 AS bad, l_partkey % 2 AS run_ FROM keyed
), one AS (SELECT key, arg_min(t, (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)) AS t FROM shard WHERE NOT bad AND run_ = 0 GROUP BY key
), two AS (SELECT key, arg_min(t, (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)) AS t FROM shard WHERE NOT bad AND run_ = 1 AND key NOT IN (SELECT key FROM one) GROUP BY key
), held AS (SELECT key, t, 'r0' AS run FROM one UNION ALL SELECT key, t, 'r1' FROM two)
SELECT run, 'data' AS part, '' AS reason, count(*) AS n FROM held GROUP BY run
UNION ALL SELECT 'r' || run_, 'rejected', 'malformed', count(*) FROM shard WHERE bad GROUP BY run_
UNION ALL SELECT 'r' || run_, 'rejected', 'conflicts with the row that holds the key', count(*) FROM shard s JOIN held h ON s.key = h.key WHERE NOT bad AND s.t <> h.t GROUP BY run_"""
)
def manifest_merge_runs(spark, sf):
    """Two runs merged into a manifest on disk, each of them sent twice: rows appended and rejected by run."""
    path = F.expr("CASE l_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat('p', l_orderkey, '_', l_linenumber % 2) END")
    rows = D.table(spark, sf, "lineitem").withColumn("path", path)
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    columns, fallback = ["l_partkey", "l_suppkey"], ["l_orderkey", "l_linenumber"]
    base = fresh_path(spark, "merge")
    for run in ("r0", "r1", "r0", "r1"):
        merge_run(rows.where(F.expr(f"l_partkey % 2 = {run[1]}")), base, run, ["path"], columns, order, "l_suppkey % 5 = 0", fallback)
    schema = rows.select("path", *columns, *fallback).schema
    data = read_part(spark, base, "data", schema).select("run", F.lit("data").alias("part"), F.lit("").alias("reason"))
    rejected = read_part(spark, base, "rejected", schema).select("run", F.lit("rejected").alias("part"), "reason")
    return data.unionByName(rejected).groupBy("run", "part", "reason").agg(F.count(F.lit(1)).alias("n"))

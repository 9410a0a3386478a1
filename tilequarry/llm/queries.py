"""One query for each operator, over its whole tables, with the parameters for production."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, extract, langid, licenses, lmscore, periods, pieces, quality, resample, shard, simhash, substrings, tokenfile


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_languages(table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.shard_documents(table(spark, sf_dir, "documents"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract_pages(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", *quality.BASE, "base_failed", "kept", "stratum")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.encode_to_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    return lmscore.score_documents(table(spark, sf_dir, "documents"), good.where("q = 1 and t = 0"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    return pieces.encode_decode(table(spark, sf_dir, "documents"), model, ids=False, decoded=False)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).drop("found")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """The texts whose runs op12 reports: where crc32(doc_id) is a multiple of 10, the words from a place on repeat a few of them.

    A null doc_id plants nothing.
    """
    hashed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    g = F.expr("h div 10")
    words = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")

    def fold(w: Column) -> Column:
        a = g % F.size(w)
        period = F.floor((F.size(w) - a) / (3 + g % 8)) + 1
        return F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, (a + (i - a) % period).cast("int"))))

    # The words are bound once; words joined by one space are the same words.
    folded = F.array_join(F.transform(F.array(words), fold)[0], " ")
    return hashed.select("doc_id", F.when((F.col("h") % 10 == 0) & F.col("text").isNotNull(), folded).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.digest(periods.periodic_runs(with_planted_runs(table(spark, sf_dir, "documents"))))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_sharding,
        op3_html_extraction,
        op4_quality_rules,
        op5_token_files,
        op6_lm_scoring,
        op7_sentencepiece,
        op8_simhash,
        op9_suffix_array_dedup,
        op10_decontamination,
        op11_license_scan,
        op12_periodic_runs,
        op13_importance_resampling,
    )
}

#: The 256 CRC-32 states of one byte, by their rule, and the CRC-32 of a string's UTF-8 bytes.
CRC_TABLE = """crc_table AS (
  SELECT list(list_reduce(list_prepend(i::UBIGINT, [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) ORDER BY i) AS crcs FROM range(256) r(i)
)"""


def crc_sql(text: str) -> str:
    """SQL for the CRC-32 of a string, beside crc_table."""
    code = f"list_transform(range(octet_length(encode({text}))), lambda b: ('0x' || substr(hex(encode({text})), 2 * b + 1, 2))::UBIGINT)"
    step = "lambda c, x: xor(c >> 8, crcs[(xor(c, x) & 255)::BIGINT + 1])"
    return f"xor(list_reduce(list_prepend(4294967295::UBIGINT, {code}), {step}), 4294967295::UBIGINT)"


LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
LETTERS = r"coalesce(regexp_extract_all(" + LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"
NOTICE_ROWS = ", ".join(f"({n}, '{label}', '{words}', {list(must)}, {licenses.bound(words)}, {str(n < licenses.N_BASE).lower()})" for n, (label, words, must) in enumerate(licenses.NOTICES))

ORACLES: dict[str, str] = {
    # Every stretch of words of every document against every notice; characters beyond ASCII are in none.
    "op11_license_scan": f"""
WITH notices(notice, label, words, must, k, base) AS (VALUES {NOTICE_ROWS}
), d AS (SELECT row_number() OVER () AS rid, doc_id, {LETTERS} AS w FROM documents
), tried AS (
  SELECT rid, w, notice, words, must, k, base, label, unnest(range(len(w))) AS i FROM d JOIN notices ON list_has_all(w, must)
), spans AS (
  SELECT *, unnest(range(len(string_split(words, ' ')) - k, len(string_split(words, ' ')) + k + 1)) AS n FROM tried
), near AS (
  SELECT *, levenshtein(words, regexp_replace(array_to_string(w[i + 1:i + n], ' '), '[^\\x00-\\x7F]', '~', 'g')) AS edits
  FROM spans WHERE n > 0 AND i + n <= len(w) AND list_has_all(w[i + 1:i + n], must)
), found AS (SELECT * FROM near WHERE edits <= k
), one AS (
  SELECT rid, count(*) FILTER (base AND edits = 0) AS n_base, min(i) FILTER (base AND edits = 0) AS first_word, max(i) FILTER (base AND edits = 0) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base AND edits = 0) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
    max(1 - edits / length(words)) AS score
  FROM found GROUP BY rid
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN one USING (rid)
""",
    # Every pair of equal words at most a quarter of the text apart; pairs at one distance that follow each other are a run.
    "op12_periodic_runs": rf"""
WITH {CRC_TABLE}, d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(list_filter(regexp_split_to_array(text, '[ 	-
]+'), lambda x: x <> ''), []) AS w0,
    CASE WHEN doc_id IS NOT NULL THEN {crc_sql("doc_id::VARCHAR")} END AS h FROM documents, crc_table
), e AS (SELECT *, len(w0)::BIGINT AS n, (h // 10)::BIGINT AS g FROM d
), f AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a FROM e
), t AS (
  SELECT rid, doc_id, n, CASE WHEN a IS NULL THEN w0
    ELSE list_transform(range(n), lambda i: CASE WHEN i < a THEN w0[i + 1] ELSE w0[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] END) END AS w FROM f
), words AS (SELECT rid, n, unnest(w) AS word, unnest(range(n)) AS i FROM t
), pairs AS (
  SELECT x.rid, x.i, y.i - x.i AS p FROM words x JOIN words y ON x.rid = y.rid AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n
), islands AS (SELECT *, i - row_number() OVER (PARTITION BY rid, p ORDER BY i) AS island FROM pairs
), stretches AS (
  SELECT rid, p, min(i) AS s, count(*) + p AS len FROM islands GROUP BY rid, p, island HAVING count(*) + p >= greatest(6, 4 * p)
), runs AS (SELECT rid, s, len, min(p) AS p FROM stretches GROUP BY rid, s, len
), told AS (
  SELECT rid, count(*) AS n_runs, string_agg(s || ',' || len || ',' || p || chr(10), '' ORDER BY s, p) AS lines,
    first({{'s': s, 'len': len, 'p': p}} ORDER BY len / p DESC, s, p) AS best FROM runs GROUP BY rid
), dropped AS (
  SELECT DISTINCT words.rid, words.i FROM words JOIN runs ON words.rid = runs.rid AND words.i >= s + p AND words.i < s + len
), kept AS (
  SELECT rid, string_agg(word, ' ' ORDER BY i) AS line FROM words ANTI JOIN dropped USING (rid, i) GROUP BY rid
)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.s::BIGINT AS start, best.len::BIGINT AS length, best.p::BIGINT AS period,
  ((1000 * best.len) // best.p)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(line, '')) AS collapsed_sha256
FROM t LEFT JOIN told USING (rid) LEFT JOIN kept USING (rid)
""",
    "op13_importance_resampling": rf"""
WITH {CRC_TABLE}, texts AS (
  SELECT row_number() OVER () AS rid, doc_id, true AS corpus, {LETTERS} AS w FROM documents
  UNION ALL SELECT -row_number() OVER (), NULL, false, {LETTERS} FROM benchmark
), runs AS (
  SELECT rid, corpus, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
    list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS feature FROM texts
), kinds AS (
  SELECT feature, ({crc_sql("feature")} % 10000)::BIGINT AS bucket FROM (SELECT DISTINCT feature FROM runs), crc_table
), features AS (SELECT rid, corpus, bucket FROM runs JOIN kinds USING (feature)
), counts AS (SELECT bucket, count(*) FILTER (corpus) AS s, count(*) FILTER (NOT corpus) AS t FROM features GROUP BY bucket
), sums AS (SELECT sum(s) AS all_s, sum(t) AS all_t FROM counts
), gains AS (
  SELECT bucket, floor(1000 * ln(((t + 1) * (all_s + 10000))::DOUBLE / ((s + 1) * (all_t + 10000))::DOUBLE))::BIGINT AS gain FROM counts, sums
), weights AS (SELECT rid, count(*) AS n_features, sum(gain) AS weight FROM features JOIN gains USING (bucket) WHERE corpus GROUP BY rid
), scored AS (
  SELECT rid, doc_id, len(w) >= 20 AS able, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    ('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM texts LEFT JOIN weights USING (rid) WHERE corpus
), ranked AS (
  SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score, able,
    count(*) FILTER (able) OVER () AS n, rid FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= n * 5 // 100 THEN place END::BIGINT AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id NULLS LAST, rid) AS place FROM ranked)
""",
    "op10_decontamination": r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark
), dw AS (SELECT rid, unnest(w) AS word, unnest(range(len(w))) AS pos FROM d
), bw AS (SELECT item_id, unnest(w) AS word, unnest(range(len(w))) AS pos, len(w) AS n FROM b
), pairs AS (
  SELECT rid, item_id, dw.pos - bw.pos AS shift, count(*) / any_value(n) AS share
  FROM dw JOIN bw USING (word) GROUP BY ALL HAVING count(*) / any_value(n) >= 0.8
), best AS (SELECT rid, item_id, max(share) AS share FROM pairs GROUP BY ALL
), one AS (
  SELECT rid, count(*) AS n_items, arg_min(item_id, (-share, item_id)) AS item_id, max(share) AS best FROM best GROUP BY rid
)
SELECT doc_id, n_items IS NOT NULL AS contaminated, coalesce(n_items, 0)::BIGINT AS n_items, item_id::BIGINT AS item_id,
  coalesce(best, 0.0)::DOUBLE AS best
FROM d LEFT JOIN one USING (rid)
""",
}

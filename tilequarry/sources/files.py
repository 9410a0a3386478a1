"""Annotation and manifest files as DataFrames. Each file is one row of text; files are read in parallel."""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST_ROWS = "path string, line int, cells array<string>, reason string, raw string"
#: A record: a line, except that line ends inside double quotes belong to it.
RECORD = re.compile(r'((?:[^"\n]|"[^"]*(?:"|\Z))*)(\n|\Z)')


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of every file under path."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def manifest_rows(path: str, text: str) -> list[tuple]:
    """The records after the header; one that cannot be trusted has a reason.

    A record with more or fewer fields than the header, and a last record without its line end (it
    may have been cut off), are rejected. So is a header without its line end.
    """
    out: list[tuple] = []
    line, width = 1, None
    for m in RECORD.finditer(text):
        raw, end = m.groups()
        if not raw and not end:
            break
        cells = next(csv.reader([raw]), [])
        if width is None:
            width = len(cells)
            if not end:
                out.append((path, line, cells, "header cut off", raw))
        elif not end:
            out.append((path, line, cells, "unterminated", raw))
        elif raw:
            out.append((path, line, cells, None if len(cells) == width else "fields", raw))
        line += raw.count("\n") + 1
    return out


def strict_manifest(files: DataFrame) -> DataFrame:
    """Every record of (path, text) rows: path, line, cells, reason (null: accepted) and raw."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [r for path, text in zip(pdf["path"], pdf["text"], strict=True) for r in manifest_rows(path, text or "")]
            yield pd.DataFrame(rows, columns=["path", "line", "cells", "reason", "raw"])

    return files.select("path", "text").mapInPandas(run, MANIFEST_ROWS)


def geojson_features(text: Column) -> tuple[Column, Column]:
    """(features as an array of JSON texts, reason): a collection, one feature or a bare list; else a reason."""
    whole = F.from_json(text, "type string, features array<string>")
    listed = F.ltrim(text).startswith("[")
    broken = F.try_parse_json(text).isNull()
    found = F.when(broken, None).when(listed, F.from_json(text, "array<string>"))
    found = found.when(whole["type"] == "FeatureCollection", F.coalesce(whole["features"], F.array().cast("array<string>"))).when(whole["type"] == "Feature", F.array(text))
    return found, F.when(broken, "malformed").when(found.isNull(), "not GeoJSON features")


def image_map(lines: DataFrame) -> DataFrame:
    """(line, text) rows of a `path,image_id` file to line, path, image_id, reason.

    Blank lines and `#` comments are left out, as is a first line that is no pair (a header); any
    other line without a whole image number has a reason.
    """
    text = F.trim("text")
    parts = F.split(text, ",")
    number = F.trim(F.element_at(parts, -1)).try_cast("long")
    rows = lines.where((F.length(text) > 0) & ~text.startswith("#")).select("line", F.trim(parts[0]).alias("path"), number.alias("image_id"), F.size(parts).alias("_n"))
    good = F.col("image_id").isNotNull() & (F.col("_n") == 2)
    return rows.where(good | (F.col("line") > 1)).select("line", "path", F.when(good, F.col("image_id")).alias("image_id"), F.when(~good, "bad image id").alias("reason"))


def chosen(given: DataFrame, listed: DataFrame) -> DataFrame:
    """(pos, given, path, reason) for given (pos, given): a listed file stands for itself, a directory for the files right inside it, *.geojson before *.json, by name.

    listed: (path) of every file. What is neither has a reason; a directory without such files has no row, if it holds others.
    """
    rank = F.when(F.col("path").endswith(".geojson"), 0).when(F.col("path").endswith(".json"), 1)
    files = listed.select("path", F.regexp_replace("path", "/[^/]*$", "").alias("parent"), rank.alias("rank"))
    above = F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/")) - 1), lambda n: F.array_join(F.slice(F.split("path", "/"), 1, n), "/"))
    known = files.select("path", F.lit(False).alias("is_dir")).unionByName(listed.select(F.explode(above).alias("path"), F.lit(True).alias("is_dir"))).distinct()
    named = given.select("pos", "given", F.regexp_replace("given", "(?<=.)/+$", "").alias("at")).join(known.withColumnRenamed("path", "at"), "at", "left")
    inside = files.where("rank IS NOT NULL").select(F.col("parent").alias("at"), "path", "rank")
    dirs = named.where("is_dir").join(inside, "at").select("pos", "given", "path", "rank", F.lit(None).cast("string").alias("reason"))
    plain = named.where("is_dir IS NULL OR NOT is_dir")
    plain = plain.select("pos", "given", F.when(F.col("is_dir").isNotNull(), F.col("at")).alias("path"), F.lit(0).alias("rank"), F.when(F.col("is_dir").isNull(), "no such file or directory").alias("reason"))
    place = F.struct("rank", "path").alias("place")
    return dirs.unionByName(plain).select("pos", "given", "path", "reason", place)

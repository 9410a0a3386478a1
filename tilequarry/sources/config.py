"""Palettes, label maps and directory rules as DataFrames: from small files, parsed once on the driver, or from tables of entries."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def parse(text: str, name: str) -> object:
    """JSON by its ending, else YAML where a parser for it is installed."""
    if name.endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError as e:
        raise ValueError("YAML files need a YAML parser; give JSON") from e
    return yaml.safe_load(text)


def hex_rgb(text: str) -> tuple[int, int, int]:
    m = re.fullmatch(r"#?([0-9a-fA-F]{2})([0-9a-fA-F]{2})([0-9a-fA-F]{2})", text.strip())
    if not m:
        raise ValueError(f"no colour: {text}")
    return int(m[1], 16), int(m[2], 16), int(m[3], 16)


def palette(spark: SparkSession, entries: list[dict]) -> DataFrame:
    """(pos, label, pr, pg, pb) from entries with text and rgb or hex; a later entry of one colour renames it in place."""
    held: dict[tuple[int, int, int], str] = {}
    for e in entries:
        if "rgb" not in e and "hex" not in e:
            raise ValueError(f"an entry needs rgb or hex: {e}")
        held[tuple(e["rgb"]) if "rgb" in e else hex_rgb(e["hex"])] = e["text"]
    return spark.createDataFrame([(i, t, *c) for i, (c, t) in enumerate(held.items())], "pos int, label string, pr int, pg int, pb int")


def label_map(spark: SparkSession, folders: dict[str, list[str]]) -> DataFrame:
    """(alias, folder); a folder is its own alias, and the first folder that registers an alias has it."""
    seen: dict[str, str] = {}
    for folder, names in folders.items():
        for a in [folder, *(names or [])]:
            seen.setdefault(str(a).strip().lower(), folder)
    return spark.createDataFrame(list(seen.items()), "alias string, folder string")


RULES = "group_id int, pos int, pattern string, base string, template string, suffix int, groups array<struct<name:string,number:int>>"


def java_pattern(pattern: str) -> tuple[str, list[tuple[str, int]]]:
    """A pattern with named groups in Java's spelling, and their names and numbers."""
    return re.sub(r"\(\?P<", "(?<", pattern), sorted(re.compile(pattern).groupindex.items(), key=lambda x: x[1])


def directory_rules(spark: SparkSession, groups: dict[str, list[dict]]) -> DataFrame:
    """Each group's ordered rules (RULES): regex, base_dir, formatted_dir and subject_glob, the named group that a directory's name must end with."""
    rows = []
    for g, rules in groups.items():
        for i, r in enumerate(rules):
            pattern, names = java_pattern(r["regex"])
            rows.append((int(g), i, pattern, r["base_dir"], r.get("formatted_dir", ""), dict(names)[r["subject_glob"]] if r.get("subject_glob") else None, names))
    return spark.createDataFrame(rows, RULES)


def palette_of(entries: DataFrame) -> DataFrame:
    """(pos, label, pr, pg, pb) from a table of entries (pos, text, hex, rgb); a later entry of one colour renames it in place, an entry without a colour is an error.

    A palette has at most 2^24 colours, so its numbering is one task's.
    """
    digits = F.regexp_extract("hex", "^#?([0-9a-fA-F]{6})$", 1)
    channel = lambda k: F.coalesce(F.get("rgb", F.lit(k)), F.conv(F.substring(digits, 2 * k + 1, 2), 16, 10).cast("int"))
    known = F.col("rgb").isNotNull() | (F.length(digits) == 6)
    r = F.when(F.coalesce(known, F.lit(False)), channel(0)).otherwise(F.raise_error(F.concat(F.lit("an entry needs rgb or hex: "), F.coalesce("text", F.lit("")))))
    colours = entries.select("pos", "text", r.alias("pr"), channel(1).alias("pg"), channel(2).alias("pb"))
    held = colours.groupBy("pr", "pg", "pb").agg(F.min("pos").alias("first"), F.max_by("text", "pos").alias("label"))
    return held.select((F.row_number().over(W.orderBy("first")) - 1).alias("pos"), "label", "pr", "pg", "pb")


def label_map_of(entries: DataFrame) -> DataFrame:
    """(alias, folder) from a table of entries (pos, alias, folder); the first folder that registers an alias has it."""
    return entries.groupBy(F.lower(F.trim("alias")).alias("alias")).agg(F.min_by("folder", "pos").alias("folder"))

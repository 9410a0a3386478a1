"""Manifests: keyed, idempotent appends that keep the first row of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def content(columns: list[str]) -> Column:
    """All cells as one text; null and blank are the same."""
    return F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])


def row_key(keys: list[str], fallback: list[str]) -> Column:
    """One text for a row's key, null like blank; rows whose keys are all blank go by the fallback columns."""
    blank = F.length(F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in keys])) == 0
    own = F.concat(F.lit("k"), content(keys))
    return F.when(blank, F.concat(F.lit("f"), content(fallback))).otherwise(own) if fallback else own


def classify(incoming: DataFrame, existing: DataFrame, keys: list[str], columns: list[str], order: list[str], fallback: list[str] | None = None) -> DataFrame:
    """Adds status: appended (first of an unseen key), identical or conflicting with the row that holds the key.

    existing and incoming have keys and columns; order is a total order of the incoming rows. A key that is
    null is a blank one and equals it, so a row that is sent again is never appended again. fallback names the
    columns that stand for the key where it is blank.
    """
    held = existing.select(row_key(keys, fallback or []).alias("_key"), content(columns).alias("_held"))
    place = W.partitionBy("_key").orderBy(*order)
    rows = incoming.withColumn("_key", row_key(keys, fallback or [])).withColumn("_content", content(columns)).join(held, "_key", "left")
    rows = rows.withColumn("_n", F.row_number().over(place)).withColumn("_first", F.first("_content").over(place))
    base = F.coalesce("_held", "_first")
    status = F.when(F.col("_held").isNull() & (F.col("_n") == 1), "appended").when(F.col("_content") == base, "identical").otherwise("conflicting")
    return rows.withColumn("status", status).drop("_held", "_content", "_n", "_first", "_key")


def append(incoming: DataFrame, existing: DataFrame, keys: list[str], columns: list[str], order: list[str], fallback: list[str] | None = None) -> DataFrame:
    """The manifest after the append."""
    fresh = classify(incoming, existing, keys, columns, order, fallback).where("status = 'appended'")
    return existing.select(*keys, *columns).unionByName(fresh.select(*keys, *columns))

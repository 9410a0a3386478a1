"""The registered queries and their SQL twins, gathered from the modules of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import annotation_queries, manifest_queries, outline_queries, raster_queries, region_queries, rule_queries, source_queries, tile_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _module in (tile_queries, annotation_queries, raster_queries, manifest_queries, source_queries, rule_queries, region_queries, outline_queries):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
FLAGSHIP = "tiles_per_class"

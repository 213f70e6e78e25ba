
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import geometry_queries, metric_queries, pixel_queries, source_queries, tile_queries, vision_queries
from .views import sql

MODULES = (tile_queries, geometry_queries, pixel_queries, metric_queries, source_queries, vision_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql(text) for module in MODULES for name, text in module.SQL.items()}

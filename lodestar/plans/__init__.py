"""Registered queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestar.plans import check_queries, column_queries, composed_queries, gate_queries, layout_queries, model_queries, polygon_queries, raster_queries, record_queries, sheet_queries, spatial_queries, stat_queries, table_queries, text_queries  # noqa: F401
from lodestar.plans.registry import ORACLES, QUERIES, Query


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["e12_criteria_score"](spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)

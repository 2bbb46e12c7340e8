"""Canonical panels from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.functions.frames import positive
from panelmill.operators.versions import latest_version
from panelmill.session import table

PRICES = ["open", "high", "low", "close", "volume", "marketcap"]


def panel(spark: SparkSession, path: str) -> DataFrame:
    """(entity, date, prices, sector): one row per entity and date, the last version read; unusable numbers are null."""
    rows = latest_version(table(spark, path, "panel_clean"), ["entity", "date"], ["read_at", "row_id"], keep=[*PRICES, "sector"])
    return rows.select("entity", "date", *[positive(c).alias(c) for c in PRICES], "sector")


def risk_free(spark: SparkSession, path: str) -> DataFrame:
    """(date, rate_pct), one row per date, nulls kept."""
    return table(spark, path, "risk_free").groupBy("date").agg(F.max("rate_pct").alias("rate_pct"))


def estimation_panel(spark: SparkSession, path: str) -> DataFrame:
    return table(spark, path, "estimation_panel")

"""Market aggregates per date and the risk-free rate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.operators.clean import carry_forward
from panelmill.session import attach


def value_weighted(df: DataFrame, by: Sequence[str], value: str, weight: str = "marketcap", name: str | None = None) -> DataFrame:
    """Weighted mean per group over the rows that have both value and weight; null for a group of weight 0."""
    rows = df.filter(F.col(value).isNotNull() & F.col(weight).isNotNull())
    mean = F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight))
    return rows.groupBy(*by).agg(mean.alias(name or value))


def daily_rate(rates: DataFrame, days: int = 252) -> DataFrame:
    """(date, rf): annual percent to a rate per day, compounded."""
    return rates.select("date", (F.pow(1 + F.col("rate_pct") / 100, F.lit(1.0 / days)) - 1).alias("rf"))


def market_series(df: DataFrame, rates: DataFrame) -> DataFrame:
    """(date, mktret, rf, cmkt): value-weighted return of the dates in ``df``, the rate last known then, and the excess.

    Dates without a rate take the last one before; leading dates stay null.
    """
    market = value_weighted(df, ["date"], "ret", name="mktret")
    joined = market.join(daily_rate(rates), "date", "left")
    return carry_forward(joined, "rf").withColumn("cmkt", F.col("mktret") - F.col("rf"))


def with_market(df: DataFrame, rates: DataFrame) -> DataFrame:
    """Add mktret, rf, cmkt and ret_excess to every row."""
    return attach(df, market_series(df, rates), ["date"]).withColumn("ret_excess", F.col("ret") - F.col("rf"))

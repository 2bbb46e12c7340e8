"""Portfolios sorted by a signal and the factors made of them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelmill.functions.frames import along
from panelmill.operators.cross_section import buckets
from panelmill.operators.market import value_weighted


def _legs(df: DataFrame, bucket: str, n: int) -> DataFrame:
    """(date, Q1..Qn): value-weighted return of each bucket; a missing bucket is null."""
    legs = value_weighted(df, ["date", bucket], "ret", name="r")
    return legs.groupBy("date").agg(*[F.max(F.when(F.col(bucket) == q, F.col("r"))).alias(f"Q{q}") for q in range(1, n + 1)])


def sorted_factor(df: DataFrame, signal: str, name: str, n: int = 5, long: int | None = None, lagged: bool = True) -> DataFrame:
    """(date, name): return of bucket ``long`` (default the highest) less that at the other end.

    Buckets are n-tiles per date of the signal, by default the entity's previous one; weights are same-day caps. Signals are
    rounded to 9 decimals first, so that ties don't hang on the last bits. A missing end makes the factor null.
    """
    s = F.round(signal, 9)
    rows = df.withColumn("_signal", F.lag(s).over(along()) if lagged else s).filter(F.col("ret").isNotNull())
    long = long or n
    legs = _legs(buckets(rows, "_signal", n, "_q"), "_q", n)
    return legs.select("date", (F.col(f"Q{long}") - F.col(f"Q{n + 1 - long}")).alias(name))


def size_factor(df: DataFrame, lagged: bool = False) -> DataFrame:
    """(date, smb): smallest less largest quintile by market cap; the same day's cap unless ``lagged``."""
    return sorted_factor(df, "marketcap", "smb", 5, long=1, lagged=lagged)


def momentum_factor(df: DataFrame, signal: str = "r21_0", within_size: bool = False) -> DataFrame:
    """(date, cmom): high less low momentum, averaged over small and big entities.

    Rows without a signal are dropped, then the signal is lagged over the rows left. Entities are small up to the date's
    median cap, else big, and independently low, medium or high by decile (3, 7, 10) of the lagged signal; with
    ``within_size`` the deciles are taken within small and big.
    """
    rows = df.filter(F.col(signal).isNotNull() & F.col("ret").isNotNull()).withColumn("_signal", F.lag(F.round(signal, 9)).over(along()))
    rows = rows.filter(F.col("_signal").isNotNull())
    middle = F.percentile("marketcap", F.lit(0.5)).over(Window.partitionBy("date"))
    rows = rows.withColumn("_size", F.when(F.col("marketcap") <= middle, "small").otherwise("big"))
    by = ["date", "_size"] if within_size else ["date"]
    decile = F.ntile(10).over(Window.partitionBy(*by).orderBy("_signal", "entity"))
    kind = F.when(decile <= 3, "low").when(decile <= 7, "medium").otherwise("high")
    legs = value_weighted(rows.withColumn("_leg", F.concat_ws("_", "_size", kind)), ["date", "_leg"], "ret", name="r")
    leg = lambda k: F.max(F.when(F.col("_leg") == k, F.col("r")))
    high, low = (leg("small_high") + leg("big_high")) / 2, (leg("small_low") + leg("big_low")) / 2
    return legs.groupBy("date").agg((high - low).alias("cmom"))


def liquidity_factor(df: DataFrame) -> DataFrame:
    """(date, liq): most less least illiquid quintile, by yesterday's absolute return per million traded."""
    ratio = F.try_divide(F.abs("ret"), F.col("volume") / 1e6)
    return sorted_factor(df.withColumn("_illiq", ratio), "_illiq", "liq")


def volatility_factor(df: DataFrame, signal: str = "rvol_30d") -> DataFrame:
    """(date, vol): most less least volatile quintile, by yesterday's volatility."""
    return sorted_factor(df, signal, "vol")


def merge(factors: Sequence[DataFrame], since: str | None = None) -> DataFrame:
    """The dates that all factors have, side by side."""
    out = reduce(lambda a, b: a.join(b, "date"), factors)
    return out.filter(F.col("date") >= F.to_date(F.lit(since))) if since else out


def leg_returns(df: DataFrame, signal: Column, n: int) -> DataFrame:
    """(date, Q1..Qn) for any signal, e.g. to look at all portfolios and not at the ends alone."""
    return _legs(buckets(df.withColumn("_signal", signal).filter(F.col("ret").isNotNull()), "_signal", n, "_q"), "_q", n)

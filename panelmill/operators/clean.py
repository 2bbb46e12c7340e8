"""Filters, de-duplication and returns of the cleaning stage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelmill.functions.frames import along
from panelmill.operators.describe import numbered
from panelmill.session import attach


def positive_filter(df: DataFrame, cols: Sequence[str] = ("close", "volume", "marketcap")) -> DataFrame:
    """Rows whose columns are all above 0; nulls drop the row."""
    cond = F.lit(True)
    for c in cols:
        cond = cond & (F.col(c) > 0)
    return df.filter(cond)


def size_floor(df: DataFrame, least: float = 1e6) -> DataFrame:
    """Rows with a market cap of at least ``least``."""
    return df.filter(F.col("marketcap") >= least)


def ratio_filter(df: DataFrame, most: float = 1.0) -> DataFrame:
    """Rows whose volume is at most ``most`` market caps; a ratio that doesn't exist drops the row."""
    return df.filter(F.try_divide("volume", "marketcap") <= most)


def benchmark_filter(df: DataFrame, benchmark: str) -> DataFrame:
    """Drop rows with a larger cap than the benchmark entity's on that date. Dates without a benchmark row are kept."""
    caps = df.filter(F.col("entity") == benchmark).groupBy("date").agg(F.max("marketcap").alias("_bench"))
    over = F.coalesce(F.col("marketcap") > F.col("_bench"), F.lit(False)) & (F.coalesce(F.col("entity"), F.lit("")) != benchmark)
    return attach(df, caps, ["date"]).filter(~over).drop("_bench")


def exclude(df: DataFrame, names: DataFrame, col: str = "entity") -> DataFrame:
    """Rows whose entity isn't in the list. Null-safe: a null entity is in no list, a null in the list excludes nothing."""
    listed = names.select(F.col(names.columns[0]).alias(col)).filter(F.col(col).isNotNull()).distinct()
    return df.join(listed, col, "left_anti")


def min_observations(df: DataFrame, least: int = 730) -> DataFrame:
    """Rows of the entities with at least ``least`` rows. A null entity is dropped."""
    enough = df.groupBy("entity").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    return df.join(enough, "entity", "left_semi")


def min_cross_section(df: DataFrame, least: int = 100) -> DataFrame:
    """Rows of the dates with at least ``least`` rows."""
    enough = df.groupBy("date").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    return df.join(enough, "date", "left_semi")


def longest_streak(df: DataFrame, step_days: int = 1) -> DataFrame:
    """(entity, streak): the longest run of dates without a gap. Repeated dates count once."""
    dates = df.filter("date is not null").select("entity", "date").distinct()
    place = F.row_number().over(along())
    runs = dates.withColumn("_run", F.floor(F.datediff("date", F.lit("1970-01-01")) / step_days) - place)
    return runs.groupBy("entity", "_run").agg(F.count(F.lit(1)).alias("n")).groupBy("entity").agg(F.max("n").alias("streak"))


def streak_filter(df: DataFrame, least: int = 365, step_days: int = 1) -> DataFrame:
    """Rows of the entities that have ``least`` dates in a row."""
    return df.join(longest_streak(df, step_days).filter(F.col("streak") >= least), "entity", "left_semi")


def simple_return(df: DataFrame, name: str = "ret") -> DataFrame:
    """Return over the entity's previous row; date gaps are bridged. Null on the first row and where a price is missing."""
    return df.withColumn(name, F.try_divide("close", F.lag("close").over(along())) - 1)


def clip(df: DataFrame, col: str = "ret", low: float = -0.99, high: float = 5.0) -> DataFrame:
    """Clamp to [low, high]; null stays null."""
    return df.withColumn(col, F.when(F.col(col).isNotNull(), F.least(F.greatest(F.col(col), F.lit(low)), F.lit(high))))


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in the given order. An aggregate with map-side combine; null keys form one key."""
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_f"))
    return first.select(*keys, *[F.col("_f")[c].alias(c) for c in rest]).select(*df.columns)


def dense_ids(df: DataFrame, col: str = "entity", name: str = "entity_id") -> DataFrame:
    """(col, name): ids 1, 2, ... of the distinct non-null values in ascending order.

    Numbered within sorted shards, so no task sees all values.
    """
    return numbered(df.select(col).filter(F.col(col).isNotNull()).distinct(), [col], name)


def carry_forward(df: DataFrame, col: str, by: str = "date") -> DataFrame:
    """Fill nulls with the last value before, along one series of one row per date. Leading nulls stay."""
    return df.withColumn(col, F.last(col, ignorenulls=True).over(Window.orderBy(by).rowsBetween(Window.unboundedPreceding, 0)))

"""Descriptive tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelmill.operators.order_stats import IN_SHARD, quantiles
from panelmill.operators.shards import PART, sorted_shards


def observations(df: DataFrame, by: str) -> DataFrame:
    """(by, n): rows per entity or date."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def entities_per(df: DataFrame, period: Column) -> DataFrame:
    """Distinct entities per period."""
    return df.groupBy(period).agg(F.count_distinct("entity").alias("entities"))


def least_cross_section(df: DataFrame) -> DataFrame:
    """(year, least): the smallest number of entities of a date, per year."""
    daily = df.groupBy(F.year("date").alias("year"), "date").agg(F.count_distinct("entity").alias("n"))
    return daily.groupBy("year").agg(F.min("n").alias("least"))


def patch_date(per_date: DataFrame, col: str, date: str) -> DataFrame:
    """Replace one date's value by that of the date before. The table has one row per date."""
    before = F.lag(col).over(Window.orderBy("date"))
    return per_date.withColumn(col, F.when(F.col("date") == F.to_date(F.lit(date)), before).otherwise(F.col(col)))


def largest(df: DataFrame, k: int) -> DataFrame:
    """The k rows with the highest market cap on the last date; equal caps in ascending order of entity."""
    last = df.agg(F.max("date").alias("date"))
    return df.join(F.broadcast(last), "date", "left_semi").orderBy(F.desc("marketcap"), "entity").limit(k)


def summary(df: DataFrame, col: str, tops: Sequence[int], names: Sequence[str]) -> DataFrame:
    """One row of statistics of ``col`` (nulls left out) for all, for the largest entities of the last date and for some by name."""
    rows = df.filter(F.col(col).isNotNull()).select("entity", "date", col)
    parts = [rows.withColumn("sample", F.lit("all"))]
    parts += [rows.join(F.broadcast(largest(df, k).select("entity")), "entity", "left_semi").withColumn("sample", F.lit(f"top {k}")) for k in tops]
    parts.append(rows.filter(F.col("entity").isin(list(names))).withColumn("sample", F.col("entity")))
    every = reduce(DataFrame.unionByName, parts)
    out = every.groupBy("sample").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("entity").alias("entities"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("sd")
    )
    points = (10, 25, 50, 75, 90)
    wide = _wide(quantiles(every, ["sample"], col, [p / 100 for p in points]), "sample", {p / 100: f"p{p}" for p in points})
    return out.join(wide, "sample", "left")


def _wide(rows: DataFrame, key: str, names: dict[float, str]) -> DataFrame:
    return rows.groupBy(key).agg(*[F.max(F.when(F.abs(F.col("p") - p) < 1e-9, F.col("value"))).alias(n) for p, n in names.items()])


def numbered(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """All rows numbered from 1 in the given order, by sorted shards and the counts of the shards before."""
    shards = sorted_shards(df, list(order), lambda d: d.withColumn("_i", F.monotonically_increasing_id().bitwiseAND(F.lit(IN_SHARD))))
    counts = shards.groupBy(PART).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row per shard
    offsets = counts.select(F.col(PART).alias("_p"), before.alias("_o"))
    both = shards.join(F.broadcast(offsets), F.col(PART) == F.col("_p"))
    return both.withColumn(name, (F.col("_i") + F.col("_o") + 1).cast("long")).drop(PART, "_i", "_p", "_o")


def column_summary(df: DataFrame, col: str) -> DataFrame:
    """n, missing, min, quartiles, mean and max of a column; one row, also for an empty table."""
    sums = df.agg(
        F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) - F.count(col)).alias("missing"), F.min(col).alias("min"), F.avg(col).alias("mean"), F.max(col).alias("max")
    )
    rows = quantiles(df.withColumn("_all", F.lit(1)), ["_all"], col, [0.25, 0.5, 0.75])
    wide = _wide(rows, "_all", {0.25: "q1", 0.5: "median", 0.75: "q3"})
    return sums.withColumn("_all", F.lit(1)).join(F.broadcast(wide), "_all", "left").drop("_all")

"""Operators across the entities of a date."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelmill.functions.frames import along


def rank_scale(df: DataFrame, cols: Sequence[str], by: str = "date", wide: bool = False) -> DataFrame:
    """Replace each column by its average rank per date, scaled to [-0.5, 0.5] (``wide``: [-1, 1]).

    (r - 1) / (max r - 1) - 0.5 over average ranks r: equal values get equal ranks. A date with one value gives null; a date
    with all values equal gives 0.5. Null and NaN stay null and aren't ranked. All columns share one shuffle by date. A task
    sorts one date's cross-section at a time and spills beyond its memory, so that is bounded by the number of entities.
    """
    df = df.withColumns({c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c)) for c in cols})
    date = Window.partitionBy(by)
    ranks = {}
    for c in cols:
        # The first and the last place of equal values; nulls come before all and are taken off. One sort a column serves.
        along_c = date.orderBy(F.col(c).asc_nulls_first())
        nulls = F.count(F.lit(1)).over(date) - F.count(c).over(date)
        ranks[f"_r_{c}"] = F.when(F.col(c).isNotNull(), (F.rank().over(along_c) + F.count(F.lit(1)).over(along_c)) / 2 - nulls)
    df = df.withColumns(ranks)
    scaled = {}
    for c in cols:
        z = F.try_divide(F.col(f"_r_{c}") - 1, F.max(f"_r_{c}").over(date) - 1) - 0.5
        scaled[c] = 2 * z if wide else z
    return df.withColumns(scaled).drop(*ranks)


def buckets(df: DataFrame, col: str, n: int, name: str = "bucket", by: str = "date", tie: str = "entity") -> DataFrame:
    """Rows with a value of ``col``, with their n-tile per date; equal values in ascending order of ``tie``."""
    rows = df.filter(F.col(col).isNotNull())
    return rows.withColumn(name, F.ntile(n).over(Window.partitionBy(by).orderBy(col, tie)))


def lag_all(df: DataFrame, cols: Sequence[str], rename: dict[str, str] | None = None) -> DataFrame:
    """Shift the columns one row down within each entity. ``rename`` is applied to the shifted columns."""
    rename = rename or {}
    keep = [c for c in df.columns if c not in cols]
    return df.select(*keep, *[F.lag(c, 1).over(along()).alias(rename.get(c, c)) for c in cols])


def correlations(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(a, b, r): Pearson correlation of each pair of columns in either order, over the rows that have both.

    One aggregation of sums for all pairs; null where a column is constant.
    """
    pairs = list(combinations(cols, 2))

    def r(a: str, b: str) -> Column:
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
        scale = F.sqrt(F.var_pop(x) * F.var_pop(y))
        return F.when(scale > 0, F.try_divide(F.covar_pop(x, y), scale))

    sums = df.agg(*[r(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(p).alias("a"), F.lit(q).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs) for p, q in ((a, b), (b, a))])
    return sums.select(F.explode(rows).alias("x")).select("x.a", "x.b", "x.r")


def close_pairs(df: DataFrame, cols: Sequence[str], over: float = 0.85) -> DataFrame:
    """The pairs whose correlation is above ``over`` and below 1 in absolute value."""
    return correlations(df, cols).filter((F.abs("r") > over) & (F.abs("r") < 1))


def wide_by(df: DataFrame, row: str, col: str, values: Sequence, value: str, prefix: str = "") -> DataFrame:
    """Long to wide: one column per value of ``col``, the mean of ``value``; null where there is none."""
    out = df.groupBy(row).pivot(col, list(values)).agg(F.avg(value))
    return out.select(row, *[F.col(f"`{v}`").alias(f"{prefix}{v}") for v in values])


def order_by_list(df: DataFrame, col: str, order: Sequence[str]) -> DataFrame:
    """Add ``place``, the position in a given order; null for values that are not in it."""
    return df.withColumn("place", F.nullif(F.array_position(F.array(*[F.lit(x) for x in order]), F.col(col)), F.lit(0)))


def significance(p: Column) -> Column:
    """3, 2 or 1 for p-values below 1, 5 and 10 percent, else 0, also where there is none."""
    return F.when(p < 0.01, 3).when(p < 0.05, 2).when(p < 0.10, 1).otherwise(0)


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p-value of a correlation of ``n`` pairs, by its t statistic and a logistic form of the normal distribution.

    Off by less than 3e-4 for large n; 0 for a correlation of 1, null where there is none or fewer than three pairs.
    """
    t = F.abs(r) * F.sqrt((n - 2) / (1 - r * r))
    # The coefficients of the published approximation.
    p = F.lit(2.0) / (F.exp(0.07056 * t * t * t + 1.5976 * t) + 1)
    return F.when((n > 2) & (F.abs(r) < 1), p).when((n > 2) & r.isNotNull(), 0.0)

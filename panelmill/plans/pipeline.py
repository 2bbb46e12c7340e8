"""The two composite pipelines: raw history to characteristics, and characteristics to an estimation sample."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.operators import characteristics, clean
from panelmill.operators.cross_section import lag_all, rank_scale
from panelmill.operators.market import with_market

# Columns of the characteristics panel that the estimation sample leaves out.
UNNEEDED = ["mcap", "open", "close", "high", "low", "mktret", "rf", "cmkt"]


def clean_panel(raw: DataFrame, exclusions: DataFrame, benchmark: str, least_cap: float = 1e6, most_ratio: float = 1.0, streak: int = 365, step_days: int = 1) -> DataFrame:
    """Cleaned panel with clipped returns: positive sizes, no cap above the benchmark's, no excluded entities, a size floor, a
    ratio of volume to cap, and entities with a long enough run of dates only."""
    df = clean.benchmark_filter(clean.positive_filter(raw), benchmark)
    df = clean.ratio_filter(clean.size_floor(clean.exclude(df, exclusions), least_cap), most_ratio)
    return clean.clip(clean.simple_return(clean.streak_filter(df, streak, step_days)))


def characteristics_panel(cleaned: DataFrame, rates: DataFrame, groups: list[str] | None = None, by_date: Sequence[DataFrame] = ()) -> DataFrame:
    """The panel with market returns, characteristics and, from the tables ``by_date``, series joined by date."""
    df = characteristics.build(with_market(cleaned, rates), groups)
    for series in by_date:
        df = df.join(series, "date", "left")
    return df


def weekly(df: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """The last row of each entity and calendar week (Monday to Sunday), dated by the week's Monday; ``order`` breaks ties of a date.

    An aggregate with map-side combine. Rows without a date form a week of their own.
    """
    rest = [c for c in df.columns if c != "entity"]
    last = df.groupBy("entity", F.trunc("date", "week").alias("_week")).agg(F.max_by(F.struct(*rest), F.struct("date", *order)).alias("_l"))
    return last.select(*[F.col("entity") if c == "entity" else F.col("_week").alias("date") if c == "date" else F.col("_l")[c].alias(c) for c in df.columns])


def load_panel(
    df: DataFrame, ret: str = "ret_excess", ignore: Sequence[str] = (), cache: str | None = None, spark: SparkSession | None = None, freq: str = "daily"
) -> DataFrame:
    """The estimation panel: dense entity ids, one row per (date, entity), unneeded columns dropped, all characteristics one row
    later, rows with a missing value dropped. ``cache``: a folder that is read if it is there and written if not. ``freq``:
    ``daily`` takes the rows as they are, ``weekly`` the last one of each week."""
    if freq not in ("daily", "weekly"):
        raise ValueError(f"unknown frequency {freq!r}")
    spark = spark or df.sparkSession
    if cache:
        try:
            return spark.read.parquet(cache)
        except AnalysisException:
            pass  # not there yet
    df = clean.keep_first(df, ["date", "entity"], [c for c in df.columns if c not in ("date", "entity")]).drop(*UNNEEDED, *ignore)
    df = weekly(df) if freq == "weekly" else df
    chars = [c for c in df.columns if c not in ("date", "entity", ret)]
    lagged = lag_all(df, chars, {"ret": "r2_1"})
    ids = clean.dense_ids(lagged)
    out = lagged.join(ids, "entity").drop("entity").withColumnRenamed("entity_id", "entity")
    out = out.replace(float("nan"), None).dropna("any")
    out = out.select("date", "entity", *[c for c in out.columns if c not in ("date", "entity")])
    if cache:
        out.write.parquet(cache)
        return spark.read.parquet(cache)
    return out


def estimation_sample(panel: DataFrame, since: str, until: str, least_rows: int = 730, least_entities: int = 100, drop: Sequence[str] = (), ret: str = "ret_excess") -> DataFrame:
    """Dates in range, entities with enough rows, then dates with enough entities; characteristics ranked and scaled per date."""
    df = clean.min_observations(panel.filter(F.col("date").between(since, until)), least_rows)
    df = clean.min_cross_section(df, least_entities).drop(*drop)
    return rank_scale(df, [c for c in df.columns if c not in ("date", "entity", ret)])

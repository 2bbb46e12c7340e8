"""Event-time bars: the daily panel from a stream of readings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_bars(readings: DataFrame, at: str = "snapped_at", source: str = "entity", value: str = "marketcap", late: str = "2 days", width: str = "1 day") -> DataFrame:
    """(entity, start, open, high, low, close, readings): bars per source and period, from a stream or a table.

    A period is emitted for good once the watermark, ``late`` behind the newest reading, has passed its end; later readings are
    dropped. Open and close are the values at the earliest and latest time, the smaller value where several share it. Nulls, NaN
    and rows without a time are no readings. The state is one row per source and open period.
    """
    v = F.col(value).cast("double")
    rows = readings.filter(F.col(at).isNotNull() & v.isNotNull() & ~F.isnan(v))
    bars = rows.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), F.col(source))
    first, last = F.min_by(v, F.struct(F.col(at), v)), F.max_by(v, F.struct(F.col(at), -v))
    out = bars.agg(first.alias("open"), F.max(v).alias("high"), F.min(v).alias("low"), last.alias("close"), F.count(F.lit(1)).alias("readings"))
    return out.select(source, F.col("w.start").alias("start"), "open", "high", "low", "close", "readings")

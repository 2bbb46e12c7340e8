"""Rolling totals over trailing periods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelmill.operators.versions import latest_version


def binary_parts(days: int) -> list[tuple[int, int]]:
    """A window of ``days`` as blocks (shift, length) of lengths that are powers of two: 7 = 4 + 2 + 1."""
    parts, shift = [], 0
    for bit in reversed(range(days.bit_length())):
        if days >> bit & 1:
            parts.append((shift, 1 << bit))
            shift += 1 << bit
    return parts


def trailing_totals(
    df: DataFrame,
    entity: str,
    date: str,
    measures: Sequence[str],
    version: Sequence[str],
    windows: Sequence[int] = (7, 30),
) -> DataFrame:
    """Totals and averages of each entity over the trailing ``windows`` days, for every calendar day it spans.

    Returns (entity, date, age, active, ``<measure>_sum_<w>``, ``<measure>_avg_<w>``): ``age`` is the number of days since the
    entity's first date, ``active`` whether the day had a row. The average is the total divided by the window's length.

    Method: binary doubling. Sums over 1, 2, 4, 8, ... days come from one another by adding the block that lies as far back
    as the block is long; a window is the sum of the blocks of its binary digits. All steps use one partitioning and sort.

    Versions of an (entity, date) are reduced first, by an aggregate with map-side combine, to the one that is last by
    ``version``; after that an entity has one row per calendar day, so no entity is larger than the calendar. Nulls, NaN and
    days without a row count as 0; days before the first date do too. Rows without a date are ignored, a null entity is an
    entity of its own, an empty table gives an empty result. Infinite values stay what they are.
    """
    daily = latest_version(df.filter(F.col(date).isNotNull()), [entity, date], version, keep=list(measures))
    along = Window.partitionBy("_e").orderBy("_d")
    zero = lambda c: F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double")), 0.0).otherwise(F.col(c).cast("double"))
    rows = daily.select(
        F.col(entity).alias("_e"), F.col(date).alias("_d"), *[zero(m).alias(f"_{i}_1") for i, m in enumerate(measures)]
    )
    rows = rows.select(
        "*", F.lead("_d").over(along).alias("_next"), F.min("_d").over(Window.partitionBy("_e")).alias("_first")
    )
    day = F.explode(F.sequence("_d", F.greatest(F.col("_d"), F.coalesce(F.date_sub("_next", 1), F.col("_d")))))
    grid = rows.select("_e", day.alias("_g"), "_d", "_first", *[f"_{i}_1" for i in range(len(measures))])
    active = F.col("_g") == F.col("_d")
    grid = grid.select(
        "_e", F.col("_g").alias("_d"), F.datediff("_g", "_first").alias("age"), active.alias("active"),
        *[F.when(active, F.col(f"_{i}_1")).otherwise(0.0).alias(f"_{i}_1") for i in range(len(measures))],
    )

    def back(name: str, shift: int):
        return F.lag(name, shift, 0.0).over(along) if shift else F.col(name)

    block = 1
    while block * 2 <= max(windows):
        grid = grid.withColumns({f"_{i}_{block * 2}": F.col(f"_{i}_{block}") + back(f"_{i}_{block}", block) for i in range(len(measures))})
        block *= 2
    out = [F.col("_e").alias(entity), F.col("_d").alias(date), "age", "active"]
    for w in windows:
        for i, m in enumerate(measures):
            total = sum((back(f"_{i}_{size}", shift) for shift, size in binary_parts(w)), F.lit(0.0))
            out += [total.alias(f"{m}_sum_{w}"), (total / w).alias(f"{m}_avg_{w}")]
    return grid.select(*out)

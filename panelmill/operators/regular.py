"""Irregular readings onto a regular grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelmill.operators.versions import latest_version
from panelmill.session import pinned

EPOCH = "1970-01-01"


def regular_grid(
    df: DataFrame,
    source: str,
    date: str,
    value: str,
    version: list[str],
    step_days: int = 1,
    fill: str = "last",
    shard_steps: int = 32,
) -> DataFrame:
    """One row per source and period from the source's first to its last reading.

    Returns (source, date, value, read_date, observed): ``date`` is the first day of the period, ``observed`` marks the
    periods that had a reading, ``read_date`` is the period the value was taken from.

    Method: time-sharded fill. Readings are reduced to one per period (the last by ``version``), each source is cut into
    shards of ``shard_steps`` periods, each shard is summarised by its first and last reading, a prefix scan over the
    summaries tells each shard the reading before it and the reading after it, and each shard then fills its own periods.
    A source has one summary per shard that has readings, so the scan is bounded by the calendar, not by the readings, and
    the readings themselves take no part in it.

    ``fill``: ``last`` carries the last reading forward, ``linear`` interpolates between the neighbours, ``none`` leaves null.
    A reading counts if its value is neither null nor NaN and its date not null; filter stricter rules beforehand. Sources
    without one have no rows; a null source is a source of its own. Several readings in a period: the last by ``version``
    counts. An empty table gives an empty result. Other columns, whatever their names, are ignored.
    """
    if fill not in ("last", "linear", "none"):
        raise ValueError(f"unknown fill {fill!r}")
    step = F.floor(F.datediff(F.col(date), F.lit(EPOCH)) / step_days).cast("long")
    used = df.select(F.col(source).alias("_s"), step.alias("_t"), F.col(value).cast("double").alias("_v"), F.struct(*version).alias("_by"))
    used = used.filter(F.col("_t").isNotNull() & F.col("_v").isNotNull() & ~F.isnan("_v"))
    daily = latest_version(used, ["_s", "_t"], ["_by", "_v"], keep=["_v"])

    shard = F.floor(F.col("_t") / shard_steps).cast("long")
    reading = F.struct(F.col("_t").alias("t"), F.col("_v").alias("v"))
    shards = pinned(daily.groupBy("_s", shard.alias("_shard")).agg(F.array_sort(F.collect_list(reading)).alias("own")))
    # The scan sees the shards' first and last readings alone.
    edges = shards.select("_s", "_shard", F.element_at("own", 1).alias("first"), F.element_at("own", -1).alias("last"))
    along = Window.partitionBy("_s").orderBy("_shard")
    carried = pinned(
        edges.select(
            "_s", "_shard", "last", F.lag("last").over(along).alias("before"), F.lead("first").over(along).alias("after"), F.lead("_shard").over(along).alias("next")
        )
    )
    # As many rows as there are shards, so never broadcast.
    around = carried.select(F.col("_s").alias("_of"), F.col("_shard").alias("_at"), "before", "after")
    shards = shards.join(around, shards["_s"].eqNullSafe(around["_of"]) & (F.col("_shard") == F.col("_at"))).drop("_of", "_at")
    # Shards without any reading lie between two that have some; both their neighbours are known.
    empty = carried.filter(F.col("next") > F.col("_shard") + 1).select(
        "_s",
        F.explode(F.sequence(F.col("_shard") + 1, F.col("next") - 1)).alias("_shard"),
        F.col("last").alias("before"),
        F.array().cast("array<struct<t:bigint,v:double>>").alias("own"),
        "after",
    )
    cut = shards.select("_s", "_shard", "before", "own", "after").unionByName(empty)

    low, high = F.col("_shard") * shard_steps, F.col("_shard") * shard_steps + shard_steps - 1
    first = F.when(F.col("before").isNull(), F.element_at("own", 1)["t"]).otherwise(low)
    last = F.when(F.col("after").isNull(), F.element_at("own", -1)["t"]).otherwise(high)
    known = F.concat(
        F.when(F.col("before").isNull(), F.array().cast("array<struct<t:bigint,v:double>>")).otherwise(F.array("before")), F.col("own")
    )
    # Segments [reading, next reading): each is filled on its own, within the shard's bounds.
    nexts = F.concat(F.slice("known", 2, F.greatest(F.size("known") - 1, F.lit(0))), F.array(F.col("after")))
    segments = (
        cut.select("_s", first.alias("first"), last.alias("last"), "after", known.alias("known"))
        .select("_s", "first", "last", F.explode(F.arrays_zip(F.col("known").alias("a"), nexts.alias("b"))).alias("z"))
        .select("_s", F.col("z.a").alias("a"), F.col("z.b").alias("b"), "first", "last")
    )
    since = F.greatest(F.col("a.t"), F.col("first"))
    until = F.least(F.coalesce(F.col("b.t") - 1, F.col("last")), F.col("last"))
    days = segments.filter(until >= since).select("_s", "a", "b", F.explode(F.sequence(since, until)).alias("t"))
    observed = F.col("t") == F.col("a.t")
    filled = {
        "last": F.col("a.v"),
        "none": F.when(observed, F.col("a.v")),
        "linear": F.when(observed, F.col("a.v")).otherwise(
            F.col("a.v") + (F.col("b.v") - F.col("a.v")) * (F.col("t") - F.col("a.t")) / (F.col("b.t") - F.col("a.t"))
        ),
    }[fill]
    day = lambda t: F.date_add(F.lit(EPOCH).cast("date"), (t * step_days).cast("int"))
    return days.select(
        F.col("_s").alias(source),
        day(F.col("t")).alias(date),
        filled.alias(value),
        day(F.col("a.t")).alias("read_date"),
        observed.alias("observed"),
    )

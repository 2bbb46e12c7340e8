"""Exact quantiles by a distributed sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelmill.operators.shards import PART, sorted_shards
from panelmill.session import attach

IN_SHARD = (1 << 33) - 1  # the part of monotonically_increasing_id that counts rows within a partition


def quantiles(df: DataFrame, groups: Sequence[str], col: str, probs: Sequence[float]) -> DataFrame:
    """(groups, p, value): linear quantiles of each group. Null and NaN are no values; groups without any have no row.

    Values are sorted over shards, equal ones spread by a hash; a group's rows are counted per shard, so the positions asked for
    are known by shard and place, and only they are picked out. No task gets a whole group.
    """
    spread = [c for c in df.columns if c not in (*groups, col)]
    rows = df.filter(F.col(col).isNotNull() & ~F.isnan(F.col(col).cast("double")))
    rows = rows.select(*groups, F.col(col).cast("double").alias("_v"), F.xxhash64(*spread).alias("_h") if spread else F.lit(0).cast("long").alias("_h"))
    place = F.monotonically_increasing_id().bitwiseAND(F.lit(IN_SHARD))
    shards = sorted_shards(rows, [*groups, "_v", "_h"], lambda d: d.select(*groups, "_v", PART, place.alias("_i")))
    counts = shards.groupBy(PART, *groups).agg(F.count(F.lit(1)).alias("own"), F.min("_i").alias("first"))
    group = Window.partitionBy(*groups)
    before = F.coalesce(F.sum("own").over(group.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = counts.select("*", before.alias("offset"), F.sum("own").over(group).alias("total"))
    at = F.explode(F.array(*[F.struct(F.lit(float(p)).alias("p"), F.lit(h).alias("high")) for p in probs for h in (False, True)]))
    wanted = sizes.select("*", at.alias("t")).withColumn("x", (F.col("total") - 1) * F.col("t.p"))
    k = F.when(F.col("t.high"), F.ceil("x")).otherwise(F.floor("x"))
    wanted = wanted.withColumn("k", k).filter((F.col("k") >= F.col("offset")) & (F.col("k") < F.col("offset") + F.col("own")))
    share = (F.col("x") - F.floor("x")).alias("share")
    wanted = wanted.groupBy(PART, *groups, (F.col("first") + F.col("k") - F.col("offset")).alias("_i")).agg(F.collect_list(F.struct("t.p", "t.high", share)).alias("w"))
    hit = attach(shards, wanted, [PART, *groups, "_i"], "inner").select(*groups, "_v", F.explode("w").alias("w"))
    lo, hi = (F.max(F.when(F.col("w.high") == F.lit(h), F.col("_v"))) for h in (False, True))
    both = hit.groupBy(*groups, "w.p").agg(lo.alias("lo"), hi.alias("hi"), F.max("w.share").alias("share"))
    value = F.when((F.col("lo") == F.col("hi")) | (F.col("share") == 0), F.col("lo")).otherwise(F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("share"))
    return both.select(*groups, "p", value.alias("value"))

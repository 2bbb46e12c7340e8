"""Mixing sources to target weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelmill.session import pinned, within

#: Most sources of a mix. Their targets are worked out in one place and broadcast.
MOST_SOURCES = 10_000
LEVEL = 4096  # places per refinement of the sampling threshold


def water_fill(weights: Sequence[float], caps: Sequence[float], total: float) -> list[float]:
    """Amount of each source: its weight's part of ``total``, at most its cap.

    What capped sources cannot give is redistributed over the others in proportion to their weights until no cap is
    exceeded; if all are capped, less than ``total`` is reached.
    """
    amounts = [0.0] * len(weights)
    free = [i for i, w in enumerate(weights) if w > 0]
    left = float(total)
    while free and left > 0:
        whole = sum(weights[i] for i in free)
        over = [i for i in free if left * (weights[i] / whole) >= caps[i]]
        if not over:
            for i in free:
                amounts[i] = left * (weights[i] / whole)
            break
        for i in over:
            amounts[i] = float(caps[i])
            left -= amounts[i]
        free = [i for i in free if i not in set(over)]
    return amounts


def mix(df: DataFrame, key: str, source: str, size: Column, targets: DataFrame, total: int | None = None, seed: int = 0, keep_weights: bool = False) -> tuple[DataFrame, DataFrame]:
    """A selection with target shares: (selection, report).

    ``targets`` has (source, weight, max_repeats). ``total`` is the size of the mix, by default that of all rows of ``df``.
    ``keep_weights``: rather than redistribute what a source cannot give, make the mix as small as it has to be for every
    source to reach its weight; a source with a weight and no rows then leaves an empty mix. ``short`` still refers to ``total``.
    selection: (key, source, size, copies), one row per item used, ``copies`` at most the source's ``max_repeats``.
    report: (source, weight, max_repeats, available, wanted, target, reached, share, short), one row per source; ``wanted`` is
    weight x total, ``target`` the amount after water filling, ``reached`` and ``share`` what the selection has, ``short`` whether
    the source cannot give what is wanted of it.

    Method: capped water filling over the sources' sizes, then per source ``floor(target / available)`` copies of every item
    and one more of a seeded sample. The sample is the items whose hash lies below a threshold; the threshold comes from two
    histograms of sizes over hashes, made with map-side combine, so a source of any size is met without sorting or
    collecting it. A second draw among small items fills up what the first leaves before an item that is too large. The same seed gives the same selection on any cluster.

    Rows whose source is null or not in ``targets`` aren't selected but count in the default total. Weights that are null or
    below 0 count as 0 and max_repeats that are null as 0; weights are scaled to a sum of 1. Several rows of a source in
    ``targets`` raise, and so do more than ``MOST_SOURCES`` sources: targets are what a person states, and 10,000 rows of them are
    less than a megabyte on the driver; the sources of ``df`` may be any number. Items of size 0 or null get the copies of their source but weigh nothing.
    """
    if not within(targets, MOST_SOURCES):
        raise ValueError(f"more than {MOST_SOURCES} sources")
    goals = targets.select(source, F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)).alias("weight"), F.coalesce("max_repeats", F.lit(0)).alias("max_repeats"))
    goals = goals.filter(F.col(source).isNotNull()).orderBy(source)
    given = goals.collect()
    if len({r[0] for r in given}) < len(given):
        raise ValueError("a source has several targets")
    place = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(key)), 40)  # 24 bits
    items = df.select(F.col(key), F.col(source), F.coalesce(size.cast("long"), F.lit(0).cast("long")).alias("size"))
    items = pinned(items.withColumn("_h", place.cast("int")))

    sums = items.groupBy(source).agg(F.sum("size").alias("s"))
    whole = sums.agg(F.sum("s")).first()[0] or 0
    known = {r[0]: r[1] for r in sums.join(F.broadcast(goals.select(source)), source, "left_semi").collect()}
    total = whole if total is None else total
    scale = sum(r["weight"] for r in given) or 1.0
    weights = [r["weight"] / scale for r in given]
    have = [known.get(r[0]) or 0 for r in given]
    caps = [n * r["max_repeats"] for n, r in zip(have, given)]
    feasible = min([c / w for c, w in zip(caps, weights) if w > 0], default=0.0) if keep_weights else total
    amounts = water_fill(weights, caps, min(total, feasible))
    plan = []
    for r, w, n, cap, amount in zip(given, weights, have, caps, amounts):
        copies = int(min(amount // n, r["max_repeats"])) if n else 0
        extra = amount - copies * n if copies < r["max_repeats"] else 0.0
        plan.append((r[0], w, r["max_repeats"], n, w * total, amount, cap < w * total, copies, float(extra)))
    named = "weight double, max_repeats int, available long, wanted double, target double, short boolean, _copies int, _extra double"
    kind = f"{source} {goals.schema[source].dataType.simpleString()}, {named}"
    plan = df.sparkSession.createDataFrame(plan, kind)

    rated = items.join(F.broadcast(plan.select(source, "_copies", F.col("_extra").alias("_left"))), source).withColumn("_more", F.lit(False))
    # First any item may be drawn; what is then left, less than the next item's size, is filled up with items much smaller.
    for fits in (F.lit(True), (F.col("size") > 0) & (F.col("size") <= F.col("_left") / 16)):
        rated = _draw(rated, source, ~F.col("_more") & fits)
    selection = rated.select(key, source, "size", (F.col("_copies") + F.col("_more").cast("int")).alias("copies")).filter("copies > 0")

    got = selection.groupBy(source).agg(F.sum(F.col("size") * F.col("copies")).alias("reached"))
    report = plan.drop("_copies", "_extra").join(got, source, "left").withColumn("reached", F.coalesce("reached", F.lit(0)))
    report = report.withColumn("_all", F.sum("reached").over(Window.partitionBy(F.lit(0))))  # one row per source
    share = F.coalesce(F.try_divide(F.col("reached"), F.col("_all")), F.lit(0.0))
    return selection, report.select(source, "weight", "max_repeats", "available", "wanted", "target", "reached", share.alias("share"), "short")


def _draw(items: DataFrame, source: str, candidate: Column) -> DataFrame:
    """Mark further candidates in order of hash until their sizes come to ``_left``; what is still left replaces it."""
    upper, lower = F.floor(F.col("_h") / LEVEL).cast("int"), F.pmod("_h", F.lit(LEVEL))
    items = items.withColumn("_can", candidate)
    high = _threshold(items.filter("_can"), source, upper, F.col("_left"), "_cut", "_rest")
    near = items.filter("_can").join(F.broadcast(high), source).filter(upper == F.col("_cut"))
    low = _threshold(near, source, lower, F.col("_rest"), "_fine", "_rest2")
    cuts = high.join(low, source, "left")  # one row per source
    items = items.join(F.broadcast(cuts), source, "left")
    taken = F.col("_can") & ((upper < F.col("_cut")) | ((upper == F.col("_cut")) & (lower < F.coalesce("_fine", F.lit(0)))))
    items = items.withColumns({"_more": F.col("_more") | F.coalesce(taken, F.lit(False)), "_left": F.coalesce("_rest2", "_left")})
    return items.drop("_can", "_cut", "_rest", "_fine", "_rest2")


def _threshold(items: DataFrame, source: str, place: Column, amount: Column, cut: str, rest: str) -> DataFrame:
    """Per source the first place at which the sizes up to and with it exceed the amount, and what is left for that place."""
    sums = items.groupBy(source, place.alias("_at")).agg(F.sum("size").alias("s"), F.max(amount).alias("_amount"))
    upto = F.sum("s").over(Window.partitionBy(source).orderBy("_at"))  # at most LEVEL rows a source
    sums = sums.withColumn("_upto", upto).filter(F.col("_upto") > F.col("_amount"))
    first = sums.groupBy(source).agg(F.min_by(F.struct("_at", (F.col("_amount") - F.col("_upto") + F.col("s")).alias("_rest")), "_at").alias("f"))
    all_of = items.select(source).distinct().join(first, source, "left")
    return pinned(all_of.select(source, F.coalesce("f._at", F.lit(LEVEL)).alias(cut), F.coalesce("f._rest", F.lit(0.0)).alias(rest)))

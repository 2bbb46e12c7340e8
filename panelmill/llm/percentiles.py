"""Exact percentiles per group of very large numeric columns."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelmill.operators.shards import PART, last_key, sorted_shards, starts
from panelmill.session import attach


def value_runs(df: DataFrame, groups: Sequence[str], measures: Sequence[str], compact: bool = False) -> DataFrame:
    """Partial result of a day, a file or a table: (groups, measure, value, n), values with their counts.

    Partial results are combined by ``union``; ``percentiles`` then gives what it would give on all rows at once, without
    any error. Equal values are counted batch by batch where they are read, without a shuffle, so a value may come
    several times but one that a third of the rows have comes in few rows. ``compact``: one row per value, at the price of a
    shuffle, for partial results that are to be kept. Nulls and NaN are no values; infinities are, in order. A null group is
    a group of its own. -0.0 counts as 0.0.
    """
    named = [f"_m{i}" for i in range(len(measures))]
    wide = df.select(*groups, *[(F.col(m).cast("double") + F.lit(0.0)).alias(n) for m, n in zip(measures, named)])
    schema = wide.select(*groups, F.lit("").alias("measure"), F.lit(0.0).alias("value"), F.lit(0).cast("long").alias("n")).schema
    runs = wide.mapInArrow(partial(_count, groups=list(groups), measures=dict(zip(named, measures))), schema)
    return runs.groupBy(*groups, "measure", "value").agg(F.sum("n").alias("n")) if compact else runs


def _count(batches: Iterator[pa.RecordBatch], groups: list[str], measures: dict[str, str]) -> Iterator[pa.RecordBatch]:
    """The distinct values of each batch, group and measure with their counts."""
    names = [f"g{i}" for i in range(len(groups))]
    for batch in batches:
        keys = [batch.column(i) for i in range(len(groups))]
        for i, measure in enumerate(measures.values(), len(groups)):
            value = batch.column(i)
            usable = pc.and_(pc.is_valid(value), pc.invert(pc.fill_null(pc.is_nan(value), True)))
            own = pa.table([*keys, value], names=[*names, "v"]).filter(usable)
            if not own.num_rows:
                continue
            if not any(pa.types.is_nested(k.type) for k in keys):
                own = own.group_by([*names, "v"]).aggregate([([], "count_all")])
                n = own.column("count_all").cast(pa.int64())
            else:
                n = pa.array(np.ones(own.num_rows, dtype=np.int64))
            columns = [*[own.column(k) for k in names], pa.array([measure] * own.num_rows), own.column("v"), n]
            yield from pa.table(columns, names=[*groups, "measure", "value", "n"]).to_batches()


def percentiles(runs: DataFrame, groups: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Percentiles of every (group, measure): (groups, measure, p, n, value); ``n`` is the number of values.

    ``value`` is linear between the neighbouring order statistics: position (n - 1) * p. It is exact: the stated error is 0.
    Between infinities of either sign there is no middle; the result is then NaN. Groups without a value have no row.

    Method: full distributed sort with per-partition counts. The runs are range-partitioned and sorted by (group, measure,
    value) and numbered within their shard; the counts per (shard, group), summed up over the shards, are each shard's
    offset in the group; every target position thereby belongs to one shard, where it is picked out. Only runs at target
    positions leave their shard.
    """
    keys = [*groups, "measure"]
    # Partial results may hold a value several times; their counts simply follow one another in the order.
    schema = runs.select(*keys, "value", "n", F.lit(0).alias(PART), F.lit(0).cast("long").alias("upto")).schema
    number = lambda batches: _number(batches, keys)
    # Runs of one value that many batches have are spread by their place, so that they can fill several shards.
    runs = runs.withColumn("_spread", F.when(F.col("n") > 1, F.monotonically_increasing_id()))
    shards = sorted_shards(runs, [*keys, "value", "_spread"], lambda d: d.select(*keys, "value", F.col("n").cast("long").alias("n"), PART).mapInArrow(number, schema))
    counts = shards.groupBy(PART, *keys).agg(F.sum("n").alias("own"))
    group = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("own").over(group.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(PART, *keys, "own", before.alias("offset"), F.sum("own").over(group).alias("total"))
    at = [((F.col("total") - 1) * F.lit(float(p)), float(p)) for p in probs]
    targets = F.array(*[
        F.struct(F.lit(p).alias("p"), place.cast("long").alias("k"), side.alias("high"), (place - F.floor(place)).alias("share"))
        for pos, p in at
        for place, side in ((pos, F.lit(False)), (pos, F.lit(True)))
    ])
    wanted = offsets.select(PART, *keys, "own", "offset", "total", F.explode(targets).alias("t")).select(
        PART, *keys, "own", "offset", "total", "t.p", "t.high", "t.share",
        F.when(F.col("t.high"), F.least(F.col("t.k") + 1, F.col("total") - 1)).otherwise(F.col("t.k")).alias("k"),
    )
    wanted = wanted.filter((F.col("k") >= F.col("offset")) & (F.col("k") < F.col("offset") + F.col("own")))
    wanted = wanted.groupBy(PART, *keys).agg(F.collect_list(F.struct("p", "high", "share", "total", (F.col("k") - F.col("offset")).alias("k"))).alias("_want"))
    # One row per group and shard that holds a target of it: at most 2 * len(probs) shards a group.
    hit = attach(shards, wanted, [PART, *keys], "inner").select(*keys, "value", "n", "upto", F.explode("_want").alias("w"))
    hit = hit.filter((F.col("w.k") < F.col("upto")) & (F.col("w.k") >= F.col("upto") - F.col("n")))
    both = hit.groupBy(*keys, "w.p").agg(
        F.max("w.total").alias("n"), F.max("w.share").alias("share"),
        F.max(F.when(~F.col("w.high"), F.col("value"))).alias("lo"), F.max(F.when(F.col("w.high"), F.col("value"))).alias("hi"),
    )
    value = F.when((F.col("lo") == F.col("hi")) | (F.col("share") == 0), F.col("lo")).otherwise(F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("share"))
    return both.select(*keys, "p", "n", value.alias("value"))


def _number(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """Add the number of values up to and with each run, counted from the group's first run in the shard."""
    held: tuple[tuple, int] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = starts(batch, keys)
        n = batch.column("n").to_numpy(zero_copy_only=False).astype(np.int64)
        total = np.cumsum(n)
        at = np.flatnonzero(new)
        base = np.repeat(np.concatenate([[0], total])[at], np.diff(np.append(at, len(n))))
        upto = total - base
        if held is not None and held[0] == last_key(batch, keys, 0):
            upto[: at[1] if len(at) > 1 else len(n)] += held[1]
        held = (last_key(batch, keys), int(upto[-1]))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(upto)], names=[*batch.schema.names, "upto"])

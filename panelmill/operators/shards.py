"""Sorted shards: the common ground of the operators that look along an order.

A table is range-partitioned on (group, order, tie-break) and sorted. Range partitioning cuts a hot group into as many
pieces as its rows call for, so no task ever gets a whole group. What a piece must know of the pieces before it comes
from a prefix scan over one summary per (shard, group); only groups that continue from one shard to another have such a
summary, so there are fewer than two per shard whatever the data.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelmill.session import pinned

PART = "_part"


def sorted_shards(df: DataFrame, order: Sequence[str | Column], then: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    """``df`` range-partitioned and sorted by ``order``, with the shard's number in ``_part``, pinned.

    ``then`` is applied to the sorted shards before they are pinned; it must keep their rows in place.
    """
    out = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(PART, F.spark_partition_id())
    return pinned(then(out))


def carried(shards: DataFrame, keys: Sequence[str], summary: Column, combine: Callable[[Column], Column]) -> DataFrame:
    """What each shard has to know of the shards before it: (``_part``, keys, ``carry``).

    ``summary`` is the aggregate of a group's rows in one shard and ``combine`` the aggregate that merges summaries in
    shard order. Groups that lie in one shard have no row here, so the result has fewer than two rows per shard.
    """
    per = shards.groupBy(PART, *keys).agg(summary.alias("_sum"))
    group = Window.partitionBy(*keys)
    before = group.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    return (
        per.withColumn("_n", F.count(F.lit(1)).over(group))
        .filter("_n > 1")
        .select(PART, *keys, combine(F.col("_sum")).over(before).alias("carry"))
        .filter("carry is not null")
    )


def with_carry(shards: DataFrame, carry: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add ``carry`` to the rows of the groups that began in an earlier shard. The rows keep their order."""
    names = {c: f"_{c}_c" for c in (PART, *keys)}
    right = F.broadcast(carry.withColumnsRenamed(names))  # fewer than two rows per shard
    cond = F.lit(True)
    for c, k in names.items():
        cond = cond & shards[c].eqNullSafe(right[k])
    return shards.join(right, cond, "left").drop(*names.values())


def starts(batch: pa.RecordBatch | pa.Table, keys: Sequence[str]) -> np.ndarray:
    """True at the rows whose key differs from the row before; the first row is True. Nulls equal nulls, NaN equals NaN."""
    new = np.zeros(batch.num_rows, dtype=bool)
    if not batch.num_rows:
        return new
    new[0] = True
    for k in keys:
        col = batch.column(k)
        if isinstance(col, pa.ChunkedArray):
            col = col.combine_chunks()
        a, b = col[1:], col[:-1]
        differ = pc.fill_null(pc.not_equal(a, b), False)
        if pa.types.is_floating(col.type):
            differ = pc.and_(differ, pc.invert(pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False)))
        differ = pc.or_(differ, pc.xor(pc.is_null(a), pc.is_null(b)))
        new[1:] |= differ.to_numpy(zero_copy_only=False)
    return new


def last_key(batch: pa.RecordBatch | pa.Table, keys: Sequence[str], row: int = -1) -> tuple:
    """The key of one row as a tuple that compares equal for equal keys, NaN included."""
    out = []
    for k in keys:
        v = batch.column(k)[row % batch.num_rows].as_py()
        out.append("NaN" if isinstance(v, float) and v != v else v)
    return tuple(out)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """Regroup sorted batches so that each table holds whole groups. Groups must be bounded; at most one is held back."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.flatnonzero(starts(batch, keys))
        cut = int(new[-1])
        if cut == 0:
            if held and last_key(held[-1], keys) != last_key(batch, keys, 0):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch)
            continue
        yield pa.Table.from_batches([*held, batch.slice(0, cut)])
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)

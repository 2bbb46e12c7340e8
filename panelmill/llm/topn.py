"""Top N items within every group."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.operators.shards import last_key, starts


def top_n(df: DataFrame, groups: Sequence[str], score: str, ties: Sequence[str], n: int) -> DataFrame:
    """The ``n`` rows of each group with the highest ``score``; equal scores in ascending order of ``ties``.

    All columns come back, with ``rank`` (1 to n) added, which replaces a column of that name.

    Method: secondary sort, twice. Each input partition sorts its rows by (group, score, ties) and streams them, keeping n
    a group: that is the pre-aggregation, so at most n rows per group and partition are shuffled, however hot the group.
    Then the kept rows are hash-partitioned by group, sorted and streamed in the same way. A stream remembers only the
    group it is in and how many rows of it went out.

    Rows with a null or NaN score are no candidates. Null groups form one group, NaN groups too. Null ties come first. Rows
    equal in score and ties are interchangeable; end ``ties`` with a unique column for a fixed choice. n below 1 raises.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    df = df.drop("rank")
    ranked = df.filter(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    order = [*[F.col(g) for g in groups], F.col(score).desc(), *[F.col(t).asc() for t in ties]]
    schema = ranked.withColumn("rank", F.lit(0)).schema

    def first_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _first_rows(batches, groups, n)

    local = ranked.sortWithinPartitions(*order).mapInArrow(first_rows, schema)
    final = local.drop("rank").repartition(*[F.col(g) for g in groups]).sortWithinPartitions(*order)
    return final.mapInArrow(first_rows, schema)


def _first_rows(batches: Iterator[pa.RecordBatch], groups: Sequence[str], n: int) -> Iterator[pa.RecordBatch]:
    held: tuple[tuple, int] | None = None
    for batch in batches:
        rows = batch.num_rows
        if not rows:
            continue
        at = np.flatnonzero(starts(batch, groups))
        sizes = np.diff(np.append(at, rows))
        place = np.arange(rows) - np.repeat(at, sizes)
        if held is not None and held[0] == last_key(batch, groups, 0):
            place[: sizes[0]] += held[1]
        held = (last_key(batch, groups), int(place[-1]) + 1)
        keep = place < n
        if keep.any():
            out = batch.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array((place[keep] + 1).astype(np.int32))], names=[*out.schema.names, "rank"])

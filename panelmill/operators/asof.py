"""Attributes as known at event time."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmill.operators.shards import carried, sorted_shards, starts, with_carry
from panelmill.session import attach, pinned


def known_at(
    events: DataFrame,
    attributes: DataFrame,
    entity: str,
    event_time: Column,
    available_at: Column,
    newest: Sequence[str],
    event_cols: Sequence[str],
    take: Sequence[str],
) -> DataFrame:
    """Each event with the newest attributes of its entity that were available by then.

    Returns the events' ``event_cols``, and ``take`` of the matched attribute row under ``known`` (a struct, null
    where nothing was known). ``newest`` are the attribute columns that rank available rows; end it with a unique column.

    Method: events and attribute rows are put into one table and sorted by (entity, time, priority, id); at equal times
    attributes come before events, so a row available at the very instant counts. The best row so far is carried forward
    along that order. The table is range-partitioned, so a hot entity lies in many shards; the best row of the shards
    before comes from a prefix scan over fewer than two summaries a shard. Since the carried value is a maximum by
    ``newest``, a row that became available late never replaces a newer one.

    Rows with a null entity match rows with a null entity. Events with a null time know nothing; attribute rows with a
    null availability never count. Repeated events give as many rows. An empty side gives events without attributes, or
    no rows. Columns of the two sides may have the same names.
    """
    rank = F.struct(*[F.col(c) for c in newest])
    none_a = F.lit(None).cast(attributes.select(F.struct(rank.alias("by"), F.struct(*take).alias("take")).alias("x")).schema["x"].dataType)
    none_e = F.lit(None).cast(events.select(F.struct(*event_cols).alias("x")).schema["x"].dataType)
    a = attributes.select(
        F.col(entity).alias("_e"), available_at.cast("timestamp").alias("_at"), F.lit(0).alias("_kind"),
        F.struct(rank.alias("by"), F.struct(*take).alias("take")).alias("_a"), none_e.alias("_ev"),
    ).filter("_at is not null")
    e = events.select(
        F.col(entity).alias("_e"), event_time.cast("timestamp").alias("_at"), F.lit(1).alias("_kind"),
        none_a.alias("_a"), F.struct(*event_cols).alias("_ev"),
    )
    both = a.unionByName(e)
    # The last two only spread copies of one instant over shards; the maximum doesn't depend on their order.
    order = ["_e", "_at", "_kind", F.xxhash64("_a", "_ev")]
    shards = sorted_shards(both, order)
    carry = carried(shards, ["_e"], F.max("_a"), F.max)
    rows = with_carry(shards, carry, ["_e"]).select("_e", "_at", "_kind", "_a", "_ev", "carry")
    # Python sees the ranks of the rows and says which row each event gets; values travel as they are.
    out = rows.mapInArrow(_carry_forward, rows.select("_ev", "_a", "_at", "_kind").schema)
    matched = out.filter("_kind = 1").select("_ev.*", F.when(F.col("_at").isNotNull(), F.col("_a.take")).alias("known"))
    return matched


def known_before(
    events: DataFrame,
    attributes: DataFrame,
    entity: str,
    event_time: Column,
    available_at: Column,
    event_day: Column,
    day: Column,
    newest: Sequence[str],
    event_cols: Sequence[str],
    take: Sequence[str],
) -> DataFrame:
    """``known_at`` where an attribute row must also be of a day before ``event_day``: both conditions are kept apart.

    Where an event lies within its own day, a row is available from the later of its time and the end of its day, and one
    pass of ``known_at`` serves. For other events (``event_time`` before or after ``event_day``) the days before
    ``event_day`` are cut into dyadic blocks, one for each binary digit; ``known_at`` finds the newest row of each (entity,
    block) and the newest of these counts. For that the rows of those events' entities are repeated once a digit of the
    span of days. No such event, no such pass.

    ``newest`` must begin with the day. Events without a day or a time know nothing, rows without a day or an availability
    don't count.
    """
    utc = lambda d: F.timestamp_seconds((F.unix_date(d).cast("long")) * 86_400)  # noqa: E731  midnight in UTC, whatever the session's time zone
    rows = attributes.withColumns({"_day": F.unix_date(day.cast("date")), "_since": available_at.cast("timestamp")}).filter("_day is not null and _since is not null")
    events = events.withColumns({"_time": event_time.cast("timestamp"), "_before": F.unix_date(event_day.cast("date"))})
    own = F.floor(F.unix_seconds("_time") / 86_400) == F.col("_before")
    within_day = events.filter(F.coalesce(own, F.lit(True)))
    over = F.greatest(F.col("_since"), utc(F.date_add(F.date_from_unix_date("_day"), 1)))
    time = F.when(F.col("_before").isNotNull(), F.col("_time"))
    found = known_at(within_day, rows, entity, time, over, newest, event_cols, take)

    others = events.filter(~F.coalesce(own, F.lit(True)))
    if others.isEmpty():
        return found
    others = pinned(others.select(F.monotonically_increasing_id().alias("_id"), F.col(entity).alias("_entity"), "_time", "_before", F.struct(*event_cols).alias("_ev")))
    whose = others.select("_entity").distinct()
    near = attach(rows.withColumn("_entity", F.col(entity)), whose, ["_entity"], "left_semi")
    low, high = near.agg(F.min("_day"), F.max("_day")).first()
    low, digits = low or 0, max(1, ((high or 0) - (low or 0) + 1).bit_length())
    block = lambda level, at: F.to_json(F.struct(F.col("_entity"), F.lit(level).alias("level"), at.alias("block")))
    offset = F.col("_day") - low
    parts = near.withColumn("_block", F.explode(F.array(*[block(n, F.shiftright(offset, n)) for n in range(digits)])))
    upto = F.least(F.greatest(F.col("_before") - low, F.lit(0)), F.lit((1 << digits) - 1))
    blocks = F.array_compact(F.array(*[F.when(F.shiftright(upto, n) % 2 == 1, block(n, F.shiftright(upto, n) - 1)) for n in range(digits)]))
    asked = others.select("_id", "_time", F.explode(blocks).alias("_block"))
    got = known_at(asked, parts.withColumn("_by", F.struct(*newest)), "_block", F.col("_time"), F.col("_since"), newest, ["_id"], ["_by", *[c for c in take if c != "_by"]])
    best = got.filter("known is not null").groupBy("_id").agg(F.max_by("known", F.col("known._by")).alias("_best"))
    joined = others.join(best.withColumnRenamed("_id", "_key"), F.col("_id") == F.col("_key"), "left")
    known = F.when(F.col("_best").isNotNull(), F.struct(*[F.col("_best")[c].alias(c) for c in take]))
    return found.unionByName(joined.select("_ev.*", known.alias("known")))


def _carry_forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    state: tuple[object, pa.Scalar] | None = None  # entity and best row so far
    first = True
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        new = starts(batch, ["_e"])
        attrs, carry, kind = batch.column("_a"), batch.column("carry"), batch.column("_kind").to_numpy(zero_copy_only=False)
        entity = batch.column("_e")
        # Candidates: the best row from before (of the batch, else of the shards before), then the batch's own rows.
        start_with = attrs.slice(0, 0)
        key0 = entity[0].as_py()
        if state is not None and state[0] == key0:
            start_with = pa.array([state[1].as_py()], type=attrs.type)
        elif first and carry[0].is_valid:
            start_with = pa.array([carry[0].as_py()], type=attrs.type)
        first = False
        extra = len(start_with)
        pool = pa.concat_arrays([start_with, attrs]) if extra else attrs
        group = np.concatenate([np.zeros(extra, dtype=np.int64), np.cumsum(new) - 1])
        valid = np.concatenate([np.ones(extra, dtype=bool), kind == 0])
        best = _running_best(pool, group, valid)[extra:]
        taken = pool.take(pa.array(best, mask=best < 0))
        yield pa.RecordBatch.from_arrays([batch.column("_ev"), taken, batch.column("_at"), batch.column("_kind")], names=["_ev", "_a", "_at", "_kind"])
        last = int(best[-1])
        state = (entity[n - 1].as_py(), pool[last]) if last >= 0 else None


def _running_best(pool: pa.Array, group: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Per position the index of the group's highest valid row so far, -1 where there is none yet."""
    by = pool.field("by") if not pool.null_count else pa.compute.struct_field(pool, "by")
    at = np.flatnonzero(valid)
    rank = np.zeros(len(valid), dtype=np.int64)
    if len(at):
        rows = by.take(pa.array(at))
        keys = pa.table({str(i): pa.compute.struct_field(rows, [i]) for i in range(by.type.num_fields)})
        order = pa.compute.sort_indices(keys, sort_keys=[(c, "ascending") for c in keys.column_names], null_placement="at_start").to_numpy()
        of_rank = at[order]
        rank[of_rank] = np.arange(1, len(at) + 1)
    size = len(at) + 1
    running = np.maximum.accumulate(group * size + rank) - group * size
    lookup = np.concatenate([[-1], of_rank]) if len(at) else np.array([-1])
    return lookup[running]

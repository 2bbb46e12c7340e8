"""Implausible spikes in measurements."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import partial
from statistics import median

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmill.operators.shards import carried, last_key, sorted_shards, starts, whole_groups, with_carry
from panelmill.session import attach, pinned

CHUNK = 4096  # readings of a source that are held against their level in one go
HALF = 15  # readings on either side that make up a reading's level
RUN = 5  # equal readings in a row that mean the instrument is stuck
LIMIT = 8.0  # median distances from the level that mean a spike


@dataclass(frozen=True)
class Field:
    """What holds for a measurement: its least value, whether that itself is possible, and how its level is taken.

    ``log``: work with natural logarithms. ``local``: the level is the median of the readings around, else that of the source.
    """

    least: float
    least_possible: bool
    log: bool
    local: bool


def impossible(field: Field, value: Column) -> Column:
    """Not finite, or beyond the physical limit. Null is no reading and thus not impossible."""
    low = value < field.least if field.least_possible else value <= field.least
    return F.isnan(value) | (F.abs(value) == float("inf")) | low


def spikes(df: DataFrame, field: str, source: str, at: str, value: str, key: str, fields: Mapping[str, Field]) -> DataFrame:
    """The implausible rows: (field, key, kind), ``kind`` one of impossible, stuck, spike (in this order of precedence).

    ``df`` has one row per reading and field. Rows of a (field, source) at the same instant are one reading, of which the
    greatest value counts, and all of them are returned if it is implausible. Impossible readings are set aside before the rest.

    Method: physical limits, run-length counters, and the distance of every reading from its level: it is a spike if that exceeds
    ``LIMIT`` times the source's median distance. No control chart goes before that: the median distance takes all distances, so
    a chart could spare none of them, and may only clear what is within the limit anyway. (The median distance and a source's
    level come from mergeable quantile summaries, of rank error 1e-4.)

    Readings are numbered along (source, time) in sorted shards and cut into chunks of ``CHUNK`` readings that bring along the
    ``HALF`` readings before and after them; so a source with a third of all readings is as many tasks as it needs.

    Null values are no readings. A reading without a time can be impossible but has no place in the order. A null source is a source. An empty table gives an empty result.
    """
    names = sorted(fields)
    code = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i).cast("byte"))])
    rows = df.filter(F.col(field).isin(names)).select(
        code[F.col(field)].alias("_f"), F.col(source).alias("_s"), F.col(at).alias("_t"), F.col(value).cast("double").alias("_v"), F.col(key)
    )
    rows = rows.filter(F.col("_v").isNotNull())
    bad = F.lit(False)
    for i, n in enumerate(names):
        bad = bad | ((F.col("_f") == i) & impossible(fields[n], F.col("_v")))
    good = rows.filter(~bad & F.col("_t").isNotNull())
    logs = [i for i, n in enumerate(names) if fields[n].log]
    x = F.when(F.col("_f").isin(logs), F.ln("_v")).otherwise(F.col("_v"))
    readings = good.groupBy("_f", "_s", "_t").agg(F.max("_v").alias("_v"), F.min(key).alias("_k"), F.count(F.lit(1)).alias("_n"))

    # At the instants that several rows share, the key is left out and the rows are looked up in the end.
    readings = readings.select("_f", "_s", "_t", "_v", F.when(F.col("_n") == 1, F.col("_k")).alias("_k"))
    schema = readings.select("*", F.lit(0).alias("_part"), F.lit(0).cast("long").alias("_i")).schema
    shards = sorted_shards(readings, ["_f", "_s", "_t"], lambda d: d.mapInArrow(_number, schema))
    placed = with_carry(shards, carried(shards, ["_f", "_s"], F.count(F.lit(1)), F.sum), ["_f", "_s"])
    placed = placed.select("_f", "_s", "_t", "_k", x.alias("_x"), (F.col("_i") + F.coalesce("carry", F.lit(0))).alias("_i"))
    own = F.floor(F.col("_i") / CHUNK)
    inside = F.col("_i") - own * CHUNK
    to = F.array_compact(
        F.array(own, F.when(inside >= CHUNK - HALF, own + 1), F.when((inside < HALF) & (own > 0), own - 1))
    )
    chunks = placed.withColumn("_c", F.explode(to)).repartition("_f", "_s", "_c").sortWithinPartitions("_f", "_s", "_c", "_i")
    local = [i for i, n in enumerate(names) if fields[n].local]
    kinds = dict(readings.dtypes)
    schema = f"_f byte, _s {kinds['_s']}, _t {kinds['_t']}, _k {kinds['_k']}, _d double, stuck boolean"
    scanned = pinned(chunks.mapInArrow(partial(_scan_chunks, local=frozenset(local)), schema))

    whole = [i for i in range(len(names)) if i not in local]
    if whole:  # their _d is still the value itself
        levels = scanned.filter(F.col("_f").isin(whole)).groupBy("_f", "_s").agg(_median("_d").alias("_level"))
        scanned = attach(scanned, levels, ["_f", "_s"])
        scanned = scanned.withColumn("_d", F.when(F.col("_f").isin(whole), F.abs(F.col("_d") - F.col("_level"))).otherwise(F.col("_d")))
    cases = attach(scanned, scanned.groupBy("_f", "_s").agg(_median("_d").alias("_scale")), ["_f", "_s"])
    kind = F.when(F.col("stuck"), "stuck").when(F.col("_d") > LIMIT * F.col("_scale"), "spike")
    cases = pinned(cases.select("_f", "_s", "_t", "_k", kind.alias("kind")).filter("kind is not null"))

    name = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("_f") + 1).alias(field)
    one = cases.filter("_k is not null").select(name, F.col("_k").alias(key), "kind")
    several = attach(good, cases.filter("_k is null").drop("_k"), ["_f", "_s", "_t"], "inner").select(name, key, "kind")
    return rows.filter(bad).select(name, key, F.lit("impossible").alias("kind")).unionByName(one).unionByName(several)


def _median(x: str) -> Column:
    """Median by quantile summaries: halfway between the lower and the upper one of an even number of values."""
    return (F.percentile_approx(x, 0.5, 10_000) - F.percentile_approx(-F.col(x), 0.5, 10_000)) / 2


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add the place of each row in its (field, source) within the shard."""
    keys = ["_f", "_s"]
    held: tuple[tuple, int] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        first = np.flatnonzero(starts(batch, keys))
        sizes = np.diff(np.append(first, batch.num_rows))
        place = np.arange(batch.num_rows) - np.repeat(first, sizes)
        if held is not None and held[0] == last_key(batch, keys, 0):
            place[: sizes[0]] += held[1]
        held = (last_key(batch, keys), int(place[-1]) + 1)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place)], names=[*batch.schema.names, "_i"])


def _scan_chunks(batches: Iterator[pa.RecordBatch], local: frozenset[int]) -> Iterator[pa.RecordBatch]:
    """Each chunk's own readings: the distance from the level, the value where the level isn't known here, and whether it is stuck."""
    keys = ["_f", "_s", "_c"]
    for table in whole_groups(batches, keys):
        table = table.combine_chunks()
        first = np.append(np.flatnonzero(starts(table, keys)), table.num_rows)
        x = table.column("_x").to_numpy()
        f, c, i = (table.column(k).to_numpy() for k in ("_f", "_c", "_i"))
        stuck, away = np.zeros(len(x), dtype=bool), x.copy()
        for a, b in zip(first[:-1], first[1:]):
            stuck[a:b] = stuck_runs(x[a:b], RUN)
            if int(f[a]) in local:
                away[a:b] = np.abs(x[a:b] - rolling_median(x[a:b], HALF))
        mine = i // CHUNK == c
        out = table.filter(pa.array(mine))
        columns = {c: out.column(c) for c in ("_f", "_s", "_k")}
        # The time is needed where the key is not there.
        columns["_t"] = pc.if_else(pc.is_valid(out.column("_k")), pa.scalar(None, out.schema.field("_t").type), out.column("_t"))
        columns |= {"_d": pa.array(away[mine]), "stuck": pa.array(stuck[mine])}
        yield from pa.table({c: columns[c] for c in ("_f", "_s", "_t", "_k", "_d", "stuck")}).to_batches()


# A control chart, for series that are judged reading by reading; ``spikes`` sees all readings and doesn't need it.


def bands(x: Sequence[float], weight: float = 0.1, scale_weight: float = 0.05, width: float = 2.0, settle: int = 2 * HALF + 1, shift: int = 8) -> tuple[list[float], list[float]]:
    """Centre and band of a robust exponentially weighted control chart, each as it was before the reading was taken up.

    The centre is a weighted mean that starts from the median of the first ``settle`` readings, the band is ``width`` times a
    weighted mean absolute deviation. A reading beyond the band is suspected and clipped to the band's edge before it moves
    either. After ``shift`` suspects in a row on one side the centre moves to their median and the band is that of before.
    """
    if not x:
        return [], []
    head = x[:settle]
    mean = median(head)
    scale = median([abs(v - mean) for v in head]) * 1.2
    centres, bands = [], []
    streak, side, before = 0, 0, scale
    for k, v in enumerate(x):
        bound = width * scale
        off = v - mean
        centres.append(mean)
        bands.append(bound)
        if -bound <= off <= bound:
            streak = 0
            mean += weight * off
            scale += scale_weight * (abs(off) - scale)
            continue
        now = 1 if off > 0 else -1
        if streak and now == side:
            streak += 1
        else:
            streak, side, before = 1, now, scale
        if streak >= shift:
            mean, scale, streak = median(x[k - shift + 1 : k + 1]), before, 0
        else:
            mean += weight * now * bound
            # A band of nothing, after equal readings, opens again by a small part of the distance.
            scale = scale + scale_weight * (bound - scale) or abs(off) * scale_weight * scale_weight
    return centres, bands


def chart(x: Sequence[float]) -> list[bool]:
    """Which readings the chart suspects."""
    return [abs(v - c) > b for v, c, b in zip(x, *bands(x))]


def stuck_runs(x: np.ndarray, run: int) -> np.ndarray:
    """True for each reading after the first in a run of ``run`` or more equal ones."""
    same = np.concatenate([[False], x[1:] == x[:-1]])
    begin = np.flatnonzero(~same)
    length = np.diff(np.append(begin, len(x)))
    return same & np.repeat(length >= run, length)


def rolling_median(x: np.ndarray, half: int) -> np.ndarray:
    """Median of each value and of up to ``half`` values on either side."""
    n = len(x)
    padded = np.concatenate([np.full(half, np.nan), x, np.full(half, np.nan)])
    windows = np.sort(np.lib.stride_tricks.sliding_window_view(padded, 2 * half + 1), axis=1)  # NaN last
    at = np.arange(n)
    count = np.minimum(at, half) + np.minimum(n - 1 - at, half) + 1
    return (windows[at, (count - 1) // 2] + windows[at, count // 2]) / 2


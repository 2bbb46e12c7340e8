"""Filling fixed-capacity containers with items."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmill.operators.shards import starts, whole_groups
from panelmill.session import pinned

LENGTHS = (256, 512, 1024, 2048)
SHARD_ITEMS = 50_000
MOST_TASKS = 10_000
MOST_CHOICES = 16  # choices of lengths to open that are tried in full; with more lengths only all of them and each alone
#: What opening a container costs besides its length, in tokens. It makes few containers better than many small ones.
OVERHEAD = 64


def pack(
    df: DataFrame,
    key: str,
    size: Column,
    lengths: Sequence[int] = LENGTHS,
    overhead: int = OVERHEAD,
    shard_items: int = SHARD_ITEMS,
) -> DataFrame:
    """Every item placed in a container: (key, piece, first, size, container, capacity, offset).

    ``lengths`` are the permitted container lengths. An item is split only if it is longer than the largest; its pieces are as
    long as that but for the last, ``first`` is a piece's place in the item and ``offset`` its place in the container. Items of
    size 0, or null, are placed too. Every container's ``capacity`` is the smallest permitted length that holds its contents.

    Method: variable-capacity best fit. Pieces are spread over shards by a hash of their key, about ``shard_items`` to a shard
    whatever their source or size, and each task packs its shard, longest first: into the open container with the least
    room that holds the piece, else into a new one. Which length that has is decided by what the pieces still to come would
    put into each (a count of them by size tells): the one with the least ``length + overhead`` per token filled in, each
    reduced to its contents. A shard is packed once for every choice of lengths to open, up to ``MOST_CHOICES``, and the
    cheapest packing is taken, so it costs no more than any single length would. In the end each container is reduced to its
    contents. A shard leaves some room in its last containers only, thus the loss to sharding is below ``max(lengths)``
    tokens in ``shard_items`` pieces.

    The result doesn't depend on partitioning. Rows of equal key are items of their own.
    """
    lengths = sorted({int(x) for x in lengths})
    if not lengths or lengths[0] < 1:
        raise ValueError("lengths must be positive")
    most = lengths[-1]
    items = df.select(F.col(key).alias("_k"), F.greatest(F.coalesce(size.cast("long"), F.lit(0)), F.lit(0)).alias("_n"))
    last = F.greatest(F.floor((F.col("_n") - 1) / most), F.lit(0))
    pieces = items.select("_k", "_n", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("_p"))
    pieces = pinned(pieces.select("_k", "_p", F.least(F.col("_n") - F.col("_p") * most, F.lit(most)).alias("_n")))
    shards = max(1, -(-pieces.count() // shard_items))
    shard = F.pmod(F.xxhash64("_k", "_p"), F.lit(shards)).cast("int")
    # A number of its own: shards are heavy for their bytes, so small ones must not be merged into few tasks.
    ready = pieces.withColumn("_shard", shard).repartition(min(shards, MOST_TASKS), "_shard")
    ready = ready.sortWithinPartitions("_shard", F.desc("_n"), "_k", "_p")
    schema = ready.select("_k", "_p", "_n", "_shard", F.lit(0).cast("long").alias("box"), F.lit(0).alias("capacity"), F.lit(0).alias("offset")).schema
    placed = ready.mapInArrow(partial(_pack_shards, lengths=lengths, overhead=overhead), schema)
    return placed.select(
        F.col("_k").alias(key), F.col("_p").alias("piece"), (F.col("_p") * most).alias("first"), F.col("_n").alias("size"),
        (F.col("_shard").cast("long") * (1 << 32) + F.col("box")).alias("container"), "capacity", "offset",
    )


def _pack_shards(batches: Iterator[pa.RecordBatch], lengths: Sequence[int], overhead: int) -> Iterator[pa.RecordBatch]:
    for table in whole_groups(batches, ["_shard"]):
        at = np.append(np.flatnonzero(starts(table, ["_shard"])), table.num_rows)
        for a, b in zip(at[:-1], at[1:]):
            own = table.slice(a, b - a).combine_chunks()
            box, capacity, offset = best_fit(own.column("_n").to_numpy().tolist(), lengths, overhead)
            out = own.append_column("box", pa.array(box, pa.int64())).append_column("capacity", pa.array(capacity, pa.int32()))
            yield from out.append_column("offset", pa.array(offset, pa.int32())).to_batches()


def best_fit(sizes: Sequence[int], lengths: Sequence[int], overhead: int) -> tuple[list[int], list[int], list[int]]:
    """Container, its final capacity and the offset in it for each of the sizes, which must be in descending order.

    Packed once for each choice of lengths to open; the cheapest packing is taken, the first of equals.
    """
    tries = (_fill(sizes, opened, lengths, overhead) for opened in choices(lengths))
    return min(tries, key=lambda t: t[0])[1]


def choices(lengths: Sequence[int]) -> list[tuple[int, ...]]:
    """All lengths, then every other choice of them, fewest first, as long as there are at most ``MOST_CHOICES``: else single ones."""
    some = [c for k in range(1, len(lengths)) for c in combinations(lengths, k) if k == 1 or 2 ** len(lengths) <= MOST_CHOICES]
    return [tuple(lengths), *some]


def _fill(sizes: Sequence[int], opened: Sequence[int], lengths: Sequence[int], overhead: int) -> tuple[int, tuple[list[int], list[int], list[int]]]:
    """Cost and packing when containers are opened at the lengths ``opened`` and end at any of ``lengths``.

    A piece longer than all of ``opened`` gets the shortest length that holds it.
    """
    counts = [0] * (lengths[-1] + 1)  # pieces still to come by size
    for n in sizes:
        counts[n] += 1
    present = sum(1 << n for n, c in enumerate(counts) if c and n)
    rooms: dict[int, list[int]] = {}  # by room left: open containers
    some = 0  # bit r is set where rooms[r] isn't empty
    used: list[int] = []
    box: list[int] = []
    offset: list[int] = []
    for n in sizes:
        fits = some >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                some &= ~(1 << room)
        else:
            options = [x for x in opened if x >= n] or [next(x for x in lengths if x >= n)]
            b, room = len(used), options[0] if len(options) == 1 else _least_cost(n, counts, present, options, lengths, overhead)
            used.append(0)
        box.append(b)
        offset.append(used[b])
        used[b] += n
        counts[n] -= 1
        if not counts[n]:
            present &= ~(1 << n)
        room -= n
        rooms.setdefault(room, []).append(b)
        some |= 1 << room
    final = [next(x for x in lengths if x >= u) for u in used]
    return sum(final) + overhead * len(final), (box, [final[b] for b in box], offset)


def _least_cost(n: int, counts: Sequence[int], present: int, options: Sequence[int], lengths: Sequence[int], overhead: int) -> int:
    """The length of a new container for a piece of size n that costs least per token the pieces to come put in, largest first."""
    costs = []
    for x in options:
        filled, room, left = n, x - n, present
        while room:
            left &= (1 << (room + 1)) - 1
            if not left:
                break
            size = left.bit_length() - 1
            left &= ~(1 << size)
            take = min(counts[size] - (size == n), room // size)
            filled += take * size
            room -= take * size
        final = next(y for y in lengths if y >= filled)
        costs.append(((final + overhead) / max(1, filled), x))
    return min(costs)[1]

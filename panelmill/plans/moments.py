"""Per-date sufficient statistics of a panel of returns and characteristics."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.operators.shards import starts, whole_groups

CONSTANT = "constant"
HELD_DATES = 2048  # dates whose sums a task holds before it hands them on


@dataclass
class Moments:
    """x[t] = Z'r / n, w[t] = Z'Z / n and s[t] = r'r of each date, with the cross-section size n.

    With s, sums of squares of what a model leaves of single returns follow from the moments: s - 2 n q'x + n q'w q for
    fitted returns Zq.
    """

    dates: list
    chars: list[str]
    n: np.ndarray
    x: np.ndarray  # (T, L)
    w: np.ndarray  # (T, L, L)
    s: np.ndarray  # (T,)

    def at(self, places) -> Moments:
        dates = [d for d, keep in zip(self.dates, np.isin(np.arange(len(self.dates)), places)) if keep]
        return Moments(dates, self.chars, self.n[places], self.x[places], self.w[places], self.s[places])

    def left(self, q: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Sum of squares left of the single returns on each of the dates ``at`` by the fitted returns Z q[t]."""
        return self.s[at] - self.n[at] * (2 * np.einsum("tl,tl->t", q, self.x[at]) - np.einsum("tl,tlm,tm->t", q, self.w[at], q))


def moment_rows(df: DataFrame, ret: str, chars: Sequence[str], date: str = "date", add_constant: bool = False) -> DataFrame:
    """(date, n, x ARRAY, w ARRAY, s): the moments as a table, one row per date.

    Rows with a missing value are left out. Every task sums up its own rows by date first, in matrix products, so what is
    shuffled is one small matrix per date and task and not the panel; a date with very many entities is no burden.
    """
    whole = df.select(F.col(date).alias("date"), F.col(ret).cast("double").alias("_r"), *[F.col(c).cast("double").alias(f"_z{i}") for i, c in enumerate(chars)])
    if add_constant:
        whole = whole.withColumn(f"_z{len(chars)}", F.lit(1.0))
    schema = f"date {dict(whole.dtypes)['date']}, n long, x array<double>, w array<double>, s double"
    size = len(chars) + add_constant
    part = whole.dropna().mapInArrow(partial(_sums, size=size), schema)
    return part.repartition("date").sortWithinPartitions("date").mapInArrow(_merge, schema)


def _table(dates: pa.Array, n, x, w, s) -> pa.RecordBatch:
    lists = [pa.array(list(map(list, v)), pa.list_(pa.float64())) for v in (x, w)]
    return pa.RecordBatch.from_arrays([dates, pa.array(n, pa.int64()), *lists, pa.array(s, pa.float64())], names=["date", "n", "x", "w", "s"])


def _sums(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    held: dict = {}
    kind = None

    def flush():
        out = _table(pa.array(list(held), kind), [v[0] for v in held.values()], *([v[i].ravel() for v in held.values()] for i in (1, 2)), [float(v[3]) for v in held.values()])
        held.clear()
        return out

    for batch in batches:
        if not batch.num_rows:
            continue
        kind = batch.column("date").type
        code = batch.column("date").dictionary_encode()
        z = np.column_stack([batch.column(f"_z{i}").to_numpy() for i in range(size)])
        r = batch.column("_r").to_numpy()
        codes = code.indices.to_numpy()
        order = np.argsort(codes, kind="stable")
        edges = np.append(np.flatnonzero(np.diff(codes[order], prepend=-1)), len(order))
        for a, b in zip(edges[:-1], edges[1:]):
            rows = order[a:b]
            zt = z[rows]
            d = code.dictionary[int(codes[rows[0]])].as_py()
            n, x, w, s = held.get(d, (0, 0.0, 0.0, 0.0))
            held[d] = (n + len(rows), x + zt.T @ r[rows], w + zt.T @ zt, s + r[rows] @ r[rows])
        if len(held) > HELD_DATES:
            yield flush()
    if held:
        yield flush()


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in whole_groups(batches, ["date"]):
        table = table.combine_chunks()
        first = np.flatnonzero(starts(table, ["date"]))
        n = np.add.reduceat(table.column("n").to_numpy(), first)
        sums = []
        for c in ("x", "w"):
            flat = np.array(table.column(c).to_pylist(), dtype=float)
            sums.append(np.add.reduceat(flat, first, axis=0) / n[:, None])
        squares = np.add.reduceat(table.column("s").to_numpy(), first)
        yield _table(table.column("date").combine_chunks().take(pa.array(first)), n, *sums, squares)


def collect_moments(df: DataFrame, ret: str, chars: Sequence[str], date: str = "date", add_constant: bool = False) -> Moments:
    """The moments on the driver: T x L x L numbers, however large the panel."""
    return gather(moment_rows(df, ret, chars, date, add_constant), [*chars, CONSTANT] if add_constant else list(chars))


def gather(rows: DataFrame, names: Sequence[str]) -> Moments:
    """The rows of ``moment_rows`` on the driver."""
    got = rows.toArrow().sort_by("date")
    size = len(names)
    x = np.array(got.column("x").to_pylist(), dtype=float).reshape(-1, size)
    w = np.array(got.column("w").to_pylist(), dtype=float).reshape(-1, size, size)
    return Moments(got.column("date").to_pylist(), list(names), got.column("n").to_numpy().astype(float), x, w, got.column("s").to_numpy().astype(float))

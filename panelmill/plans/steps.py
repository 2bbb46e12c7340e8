"""The steps of the estimator where the moments are: for panels whose T x L x L moments are too many for the driver.

``rows`` are those of ``moments.moment_rows``, one per date, best pinned. A step is one job; the driver gets the loadings and
normal equations, whose size is that of the loadings squared whatever the number of dates.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.plans import kernel


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = batch.column("n").to_numpy(zero_copy_only=False).astype(float)
    x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(n), -1)
    return n, x, batch.column("w").flatten().to_numpy(zero_copy_only=False).reshape(len(n), x.shape[1], x.shape[1])


def _given(batch: pa.RecordBatch, m: int) -> np.ndarray:
    return batch.column("g").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, m) if m else np.zeros((batch.num_rows, 0))


def factor_rows(rows: DataFrame, gamma: np.ndarray, k: int) -> DataFrame:
    """(date, f ARRAY): each date's factors for loadings ``gamma``; given ones are in a column ``g``, an array, if there are any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                _, x, w = _arrays(batch)
                f = kernel.factor_step(gamma, x, w, _given(batch, gamma.shape[1] - k), k)
                yield pa.RecordBatch.from_arrays([batch.column("date"), pa.array(f.tolist(), pa.list_(pa.float64()))], names=["date", "f"])

    return rows.mapInArrow(run, f"date {dict(rows.dtypes)['date']}, f array<double>")


def _partial(batches: Iterator[pa.RecordBatch], gamma: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    km = gamma.shape[1]
    a, b, second, total, n_dates = 0.0, 0.0, np.zeros((km, km)), np.zeros(km), 0
    for batch in batches:
        if batch.num_rows:
            n, x, w = _arrays(batch)
            f = kernel.factor_step(gamma, x, w, _given(batch, km - k), k)
            own = kernel.normal_equations(f, x, w, n)
            a, b, second, total, n_dates = a + own[0], b + own[1], second + f.T @ f, total + f.sum(axis=0), n_dates + len(f)
    if n_dates:
        flat = np.concatenate([a.ravel(), b.ravel(), second.ravel(), total, [float(n_dates)]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["i", "v"])


def loading_step(rows: DataFrame, gamma: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """New loadings, and second moments and means of the factors they were made from. The normal equations of its dates are
    summed up by each task, then over tasks by place, so no task and not the driver sees those of many tasks."""
    size, km = gamma.shape
    sums = rows.mapInArrow(partial(_partial, gamma=gamma, k=k), "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow().sort_by("i")
    flat = sums.column("v").to_numpy()
    if not len(flat):
        raise ValueError("no dates")
    cut = np.cumsum([(size * km) ** 2, size * km, km * km, km])
    a, b, second, total, n = np.split(flat, cut)
    return kernel.solve(a.reshape(size * km, -1), b).reshape(size, km), second.reshape(km, km), total / n[0]


def fit_rows(rows: DataFrame, size: int, k: int, min_tol: float = 1e-4, max_iters: int = 1000) -> tuple[np.ndarray, float, int]:
    """Latent loadings of ``k`` factors, orthonormal, factors orthogonal with means not below 0; last change and iterations.

    Starts from the leading directions of the portfolios' second moments, one aggregation, and alternates jobs until no
    loading changes by more than ``min_tol``.
    """
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    got = rows.agg(*[F.sum(F.col("x")[i] * F.col("x")[j]).alias(f"s{i}_{j}") for i, j in pairs]).first()
    xx = np.zeros((size, size))
    for i, j in pairs:
        xx[i, j] = xx[j, i] = got[f"s{i}_{j}"]
    gamma = np.linalg.eigh(xx)[1][:, ::-1][:, :k]
    tol, iters = np.inf, 0
    while iters < max_iters and tol > min_tol:
        iters += 1
        raw, second, mean = loading_step(rows, gamma, k)
        q, r = np.linalg.qr(raw)
        turn = np.linalg.eigh(r @ second @ r.T)[1][:, ::-1]
        new = q @ turn
        new = new * np.where(turn.T @ r @ mean < 0, -1.0, 1.0)
        tol = float(np.abs(new - gamma).max())
        gamma = new
    return gamma, tol, iters

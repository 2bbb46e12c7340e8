"""Instrumented factor models on a panel: in-sample and recursive fits, fitted returns, R2 and bootstrap tests.

The panel stays distributed. One pass reduces it to a matrix per date (moments); the estimator works on these, and what
follows from it for single assets (fits, loadings, R2) is again computed where the rows are.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelmill.plans import kernel
from panelmill.plans.moments import CONSTANT, Moments, collect_moments
from panelmill.session import attach


@dataclass
class Fit:
    """Results. In sample ``gamma`` is (L, K + M), out of sample (T, L, K + M) with NaN before the first forecast."""

    chars: list[str]
    names: list[str]
    dates: list
    k: int
    gamma: np.ndarray
    factors: np.ndarray
    means: np.ndarray  # (T, K + M): expected factors of every date
    var1: np.ndarray
    x_total: np.ndarray
    x_pred: np.ndarray
    first: int = 0  # first date that counts for R2
    stats: dict = field(default_factory=dict)

    def r2_x(self, x: np.ndarray, bench: str = "zero", span: Sequence[int] | None = None) -> tuple[float, float]:
        """Total and predictive R2 of the managed portfolios, over all dates from ``first`` on or those of ``span``."""
        at = np.arange(self.first, len(self.dates)) if span is None else np.asarray(span)
        b = benchmark_x(x, bench, at)[at]
        return kernel.r2(x[at], self.x_total[at], b), kernel.r2(x[at], self.x_pred[at], b)


def benchmark_x(x: np.ndarray, bench: str, at: np.ndarray) -> np.ndarray:
    """Forecast to beat: zero; the mean of all or of each portfolio; or those of the dates before, 0 on the first."""
    if bench == "zero":
        return np.zeros_like(x)
    if bench in ("mean", "all_mean"):
        return np.full_like(x, x.mean())
    if bench == "individual_mean":
        return np.broadcast_to(x[at].mean(axis=0), x.shape)
    past = np.arange(1, len(x))[:, None]
    own = np.vstack([np.zeros(x.shape[1]), np.cumsum(x, axis=0)[:-1] / past])
    if bench == "individual_mean_recursive":
        return own
    if bench == "all_mean_recursive":
        return np.broadcast_to(own.mean(axis=1)[:, None], x.shape)
    raise ValueError(f"unknown benchmark {bench!r}")


class IPCA:
    """``IPCA(panel, "ret_excess", chars).fit(K=2)``. With ``add_constant`` a constant is the last characteristic."""

    def __init__(self, panel: DataFrame, ret: str, chars: Sequence[str] | None = None, date: str = "date", entity: str = "entity", add_constant: bool = False, moments: Moments | None = None):
        self.ret, self.date, self.entity, self.add_constant = ret, date, entity, add_constant
        self.base = list(chars or [c for c in panel.columns if c not in (ret, date, entity)])
        self.panel = panel.select(date, entity, ret, *self.base).dropna()
        self.moments = moments or collect_moments(self.panel, ret, self.base, date, add_constant)
        self.chars = self.moments.chars

    def fit(
        self, K: int = 1, OOS: bool = False, gFac: dict | None = None, normalization_choice: str = "PCA_positivemean",
        normalization_choice_specs: Sequence[str] | None = None, OOS_window: str = "recursive", OOS_window_specs: int = 60,
        factor_mean: str = "constant", minTol: float = 1e-4, maxIters: int = 5000, F_names: Sequence[str] | None = None, G_names: Sequence[str] | None = None,
    ) -> Fit:
        """Estimate with K latent factors and those of ``gFac``, a map of date to their values.

        ``OOS``: for each date from place ``OOS_window_specs`` on, estimate on the dates before it (``recursive``) or on that
        many (``rolling``), starting from the last estimate, and realise the date's factor with its moments.
        ``factor_mean``: expected factors are the training mean (``constant``) or those of a ``VAR1``.
        """
        m = self.moments
        given = given_factors(m, gFac)
        rows = None
        if normalization_choice == "Identity":
            rows = [self.chars.index(c) for c in normalization_choice_specs or []]
            if len(rows) != K:
                raise ValueError("Identity needs K characteristics")
        names = [*(F_names or [str(i) for i in range(K)]), *(G_names or [f"g{i}" for i in range(given.shape[1])])]
        if OOS:
            return out_of_sample(self.panel.sparkSession, m, K, given, names, factor_mean, minTol, maxIters, rows, OOS_window, OOS_window_specs)
        return in_sample(m, K, given, names, factor_mean, minTol, maxIters, rows)

    def results(self, fit: Fit, R_fit: bool = False, Beta_fit: bool = False) -> dict:
        """What a fit gives, by name; fitted returns and loadings of single rows are there if asked for, as tables."""
        out = {"Gamma": fit.gamma, "Factors": fit.factors, "Lambda": fit.means, "xfits": fit.r2_x(self.moments.x)}
        if R_fit:
            out["rfits"] = self.asset_fits(fit)
        if Beta_fit:
            out["Betas"] = self.betas(fit)
        return out

    def asset_fits(self, fit: Fit) -> DataFrame:
        """(date, entity, ret, total, pred): fitted returns of every row, from what its date's factors make of each characteristic."""
        g = fit.gamma if fit.gamma.ndim == 3 else np.broadcast_to(fit.gamma, (len(fit.dates), *fit.gamma.shape))
        per = [(d, *[[float(v) for v in g[t] @ f[t]] for f in (fit.factors, fit.means)]) for t, d in enumerate(fit.dates) if t >= fit.first]
        return asset_fits(self.panel, self.ret, self.base, per, self.date, self.entity, self.add_constant)

    def betas(self, fit: Fit) -> DataFrame:
        """(date, entity, name, beta): each row's loading on each factor; out of sample those of its date, from the first forecast on."""
        z = [*[F.col(c) for c in self.base], *([F.lit(1.0)] if self.add_constant else [])]
        if fit.gamma.ndim == 3:
            per = [(d, [float(v) for v in fit.gamma[t].ravel()]) for t, d in enumerate(fit.dates) if t >= fit.first]
            own = self.panel.sparkSession.createDataFrame(per, f"{self.date} {dict(self.panel.dtypes)[self.date]}, _g array<double>")
            k = len(fit.names)
            beta = lambda j: sum((c * F.col("_g")[i * k + j] for i, c in enumerate(z)), F.lit(0.0))
            each = [F.struct(F.lit(name).alias("name"), beta(j).alias("beta")) for j, name in enumerate(fit.names)]
            return attach(self.panel, own, [self.date], "inner").select(self.date, self.entity, F.explode(F.array(*each)).alias("b")).select(self.date, self.entity, "b.*")
        each = [F.struct(F.lit(k).alias("name"), sum((c * float(g) for c, g in zip(z, fit.gamma[:, j])), F.lit(0.0)).alias("beta")) for j, k in enumerate(fit.names)]
        return self.panel.select(self.date, self.entity, F.explode(F.array(*each)).alias("b")).select(self.date, self.entity, "b.*")

    def r2_assets(self, fit: Fit, bench: str = "zero", since=None, until=None, fits: DataFrame | None = None) -> tuple[float, float]:
        """Total and predictive R2 of single returns. ``fits``: the fitted returns, pinned, if several benchmarks are asked for."""
        rows = asset_benchmark(self.asset_fits(fit) if fits is None else fits, bench, self.date, self.entity)
        if since is not None:
            rows = rows.filter(F.col(self.date) >= F.lit(since))
        if until is not None:
            rows = rows.filter(F.col(self.date) <= F.lit(until))
        got = rows.agg(*[(1 - F.sum((F.col("ret") - F.col(c)) ** 2) / F.sum((F.col("ret") - F.col("bench")) ** 2)).alias(c) for c in ("total", "pred")]).first()
        return got["total"], got["pred"]


def given_factors(m: Moments, by_date: dict | None) -> np.ndarray:
    if not by_date:
        return np.zeros((len(m.dates), 0))
    missing = [d for d in m.dates if d not in by_date]
    if missing:
        raise ValueError(f"no given factors for {len(missing)} dates, e.g. {missing[0]}")
    return np.array([np.atleast_1d(by_date[d]) for d in m.dates], dtype=float)


def in_sample(m: Moments, k: int, given: np.ndarray, names: list[str], factor_mean: str, min_tol: float, max_iters: int, rows=None) -> Fit:
    e = kernel.estimate(m.x, m.w, m.n, k, given, min_tol, max_iters, rows=rows)
    means = np.tile(e.factors.mean(axis=0), (len(m.dates), 1))
    b = np.hstack([np.zeros((e.factors.shape[1],) * 2), means[:1].T])
    if factor_mean == "VAR1":
        b = kernel.var1(e.factors)
        means[1:] = np.hstack([e.factors[:-1], np.ones((len(means) - 1, 1))]) @ b.T
    wg = m.w @ e.gamma
    fits = [np.einsum("tlk,tk->tl", wg, f) for f in (e.factors, means)]
    return Fit(m.chars, names, m.dates, k, e.gamma, e.factors, means, b, *fits, stats={"tol": e.tol, "iters": e.iters})


OOS_BLOCK = 16  # forecast dates of a task; the first starts anew, the others from the estimate of the date before


def forecasts(m: Moments, k: int, given: np.ndarray, factor_mean: str, min_tol: float, max_iters: int, rows, window: str, size: int, begin: int) -> list[tuple]:
    """(t, gamma, factors, means, iters) of up to ``OOS_BLOCK`` dates from ``begin`` on, each estimated on dates before it alone."""
    out, last = [], None
    for t in range(begin, min(begin + OOS_BLOCK, len(m.dates))):
        at = slice(max(0, t - size) if window == "rolling" else 0, t)
        start = None if last is None else (last, kernel.factor_step(last, m.x[at], m.w[at], given[at], k))
        e = kernel.estimate(m.x[at], m.w[at], m.n[at], k, given[at], min_tol, max_iters, start=start, rows=rows)
        last = e.gamma
        f = kernel.factor_step(e.gamma, m.x[t : t + 1], m.w[t : t + 1], given[t : t + 1], k)[0]
        mean = kernel.var1(e.factors) @ np.append(e.factors[-1], 1.0) if factor_mean == "VAR1" else e.factors.mean(axis=0)
        out.append((t, e.gamma, f, mean, e.iters))
    return out


def out_of_sample(
    spark: SparkSession, m: Moments, k: int, given: np.ndarray, names: list[str], factor_mean: str, min_tol: float, max_iters: int, rows=None, window: str = "recursive", size: int = 60
) -> Fit:
    """Blocks of dates are estimated in tasks of their own; the blocks don't depend on the number of tasks."""
    t_all, width, km = len(m.dates), m.x.shape[1], k + given.shape[1]
    gamma = np.full((t_all, width, km), np.nan)
    factors, means = np.full((t_all, km), np.nan), np.full((t_all, km), np.nan)
    iters = []

    def work(moments: Moments, job: int) -> list[tuple]:
        got = forecasts(moments, k, given, factor_mean, min_tol, max_iters, rows, window, size, size + job * OOS_BLOCK)
        return [(t, [float(v) for v in g.ravel()], [float(v) for v in f], [float(v) for v in l], i) for t, g, f, l, i in got]

    blocks = -(-max(0, t_all - size) // OOS_BLOCK)
    if blocks:
        for r in _spread(spark, blocks, m, work, "t int, gamma array<double>, factors array<double>, means array<double>, iters int").collect():  # one row per date
            gamma[r["t"]] = np.reshape(r["gamma"], (width, km))
            factors[r["t"]], means[r["t"]] = r["factors"], r["means"]
            iters.append(r["iters"])
    fits = [np.einsum("tlm,tmk,tk->tl", m.w, gamma, f) for f in (factors, means)]
    var = kernel.var1(factors[size:]) if factor_mean == "VAR1" and t_all - size > 1 else np.full((km, km + 1), np.nan)
    return Fit(m.chars, names, m.dates, k, gamma, factors, means, var, *fits, first=size, stats={"iters": iters})


def asset_fits(panel: DataFrame, ret: str, chars: Sequence[str], per_date: Sequence[tuple], date: str = "date", entity: str = "entity", add_constant: bool = False) -> DataFrame:
    """Fitted returns from (date, total weights, predictive weights) by characteristic; one small row per date is joined."""
    kind = dict(panel.dtypes)[date]
    weights = panel.sparkSession.createDataFrame(per_date, f"{date} {kind}, _ft array<double>, _fp array<double>")
    z = F.array(*[F.col(c).cast("double") for c in chars], *([F.lit(1.0)] if add_constant else []))
    dot = lambda w: F.aggregate(F.zip_with(z, w, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return attach(panel, weights, [date], "inner").select(date, entity, F.col(ret).alias("ret"), dot("_ft").alias("total"), dot("_fp").alias("pred"))


def asset_benchmark(rows: DataFrame, bench: str, date: str = "date", entity: str = "entity") -> DataFrame:
    """Add ``bench``: 0; the mean of all returns or of the entity's; or those of the dates before, 0 on the first."""
    if bench == "zero":
        return rows.withColumn("bench", F.lit(0.0))
    if bench in ("mean", "all_mean"):
        return rows.withColumn("bench", F.lit(rows.agg(F.avg("ret")).first()[0]).cast("double"))
    if bench == "individual_mean":
        return attach(rows, rows.groupBy(entity).agg(F.avg("ret").alias("bench")), [entity])
    if bench == "all_mean_recursive":
        sums = rows.groupBy(date).agg(F.sum("ret").alias("_s"), F.count("ret").alias("_n"))
        past = Window.orderBy(date).rowsBetween(Window.unboundedPreceding, -1)  # one row per date
        before = sums.select(date, F.coalesce(F.sum("_s").over(past) / F.sum("_n").over(past), F.lit(0.0)).alias("bench"))
        return attach(rows, before, [date])
    if bench == "individual_mean_recursive":
        # One row per entity and date first: an entity's rows of one date know nothing of each other.
        sums = rows.groupBy(entity, date).agg(F.sum("ret").alias("_s"), F.count("ret").alias("_n"))
        past = Window.partitionBy(entity).orderBy(date).rowsBetween(Window.unboundedPreceding, -1)
        mean = F.try_divide(F.sum("_s").over(past), F.sum("_n").over(past))
        return attach(rows, sums.select(entity, date, F.coalesce(mean, F.lit(0.0)).alias("bench")), [entity, date])
    raise ValueError(f"unknown benchmark {bench!r}")


def r2_column(fit: str, bench: Column | float = 0.0) -> Column:
    return 1 - F.sum((F.col("ret") - F.col(fit)) ** 2) / F.sum((F.col("ret") - bench) ** 2)


# Bootstrap tests and grids: many small estimates, one Spark task for each few of them.

BLOCK = 20  # draws of a job
REDRAWS = 20  # times a draw whose estimate is singular is drawn again before it counts as failed


def _spread(spark: SparkSession, jobs: int, m: Moments, work, schema: str) -> DataFrame:
    """Run ``work(moments, job)`` for each job number on the cluster; it returns the rows of that job."""
    shared = spark.sparkContext.broadcast(m)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r for j in batch["id"] for r in work(shared.value, int(j))]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    tasks = min(jobs, 4 * spark.sparkContext.defaultParallelism)
    return spark.range(0, jobs, 1, tasks).mapInPandas(run, schema)


def draw_numbers(t_all: int, rng: np.random.RandomState) -> tuple[np.ndarray, np.ndarray]:
    """A t(5) number and the number of a date, drawn in turn, for each date."""
    scale, pick = np.empty(t_all), np.empty(t_all, dtype=int)
    for t in range(t_all):
        scale[t] = rng.standard_t(5)
        pick[t] = rng.randint(0, high=t_all)
    return scale, pick


def null_moments(m: Moments, fit_factors: np.ndarray, null_gamma: np.ndarray) -> np.ndarray:
    return np.einsum("tlm,tm->tl", m.w, fit_factors @ null_gamma.T)


def null_draw(m: Moments, fit_factors: np.ndarray, null_gamma: np.ndarray, residuals: np.ndarray, rng: np.random.RandomState) -> np.ndarray:
    """Moments under the null: the model with ``null_gamma`` plus, per date, a t(5) number times a random date's residual."""
    scale, pick = draw_numbers(len(m.dates), rng)
    return null_moments(m, fit_factors, null_gamma) + scale[:, None] * residuals[pick]


def wild_bootstrap(spark: SparkSession, m: Moments, fit: Fit, tests: Sequence[str], draws: int, min_tol: float, max_iters: int, given: np.ndarray) -> DataFrame:
    """(test, draw, stat, observed, converged) of the hypotheses that loadings are 0; a draw has converged if it reached ``min_tol``.

    A test is ``row:<l>`` (characteristic number l has no effect) or ``last`` (the last factor has none). Draw number n is seeded
    with n, so the draws don't depend on how they are spread. A draw whose estimate is singular is drawn again, up to ``REDRAWS`` times;
    then its statistic is null. A job has ``BLOCK`` draws of all tests, as these share their random numbers, and estimates them together.
    """
    residuals = m.x - fit.x_total
    plain = fit.gamma

    def stat(gamma: np.ndarray, test: str) -> float:
        v = gamma[int(test[4:])] if test.startswith("row:") else gamma[:, -1]
        return float(v @ v)

    def null(test: str) -> np.ndarray:
        g = plain.copy()
        if test.startswith("row:"):
            g[int(test[4:])] = 0
        else:
            g[:, -1] = 0
        return g

    def work(moments: Moments, job: int) -> list[tuple]:
        numbers = range(job * BLOCK, min((job + 1) * BLOCK, draws))
        noise = [scale[:, None] * residuals[pick] for scale, pick in (draw_numbers(len(moments.dates), np.random.RandomState(d)) for d in numbers)]
        cases = [(test, draw) for test in tests for draw in numbers]
        x = np.array([base + v for base in (null_moments(moments, fit.factors, null(test)) for test in tests) for v in noise])
        found = kernel.estimate_many(x, moments.w, moments.n, fit.k, given, min_tol, max_iters)
        for i, (test, draw) in enumerate(cases):
            rng = np.random.RandomState(draw)
            for _ in range(1 + REDRAWS):
                if found[i]:
                    break
                try:
                    found[i] = kernel.estimate(null_draw(moments, fit.factors, null(test), residuals, rng), moments.w, moments.n, fit.k, given, min_tol, max_iters)
                except np.linalg.LinAlgError:
                    continue
        return [(test, draw, stat(e.gamma, test) if e else None, stat(plain, test), bool(e and e.tol <= min_tol)) for (test, draw), e in zip(cases, found)]

    return _spread(spark, -(-draws // BLOCK), m, work, "test string, draw int, stat double, observed double, converged boolean")


def p_values(draws: DataFrame) -> DataFrame:
    """(test, observed, pval, draws, converged): the share of draws above the observed statistic, and how many draws gave one and converged."""
    return draws.groupBy("test").agg(
        F.max("observed").alias("observed"), F.avg((F.col("stat") > F.col("observed")).cast("double")).alias("pval"),
        F.count("stat").alias("draws"), F.count_if("converged").alias("converged"),
    )


def wald_beta(spark: SparkSession, m: Moments, fit: Fit, chars: Sequence[str], given: np.ndarray, draws: int = 1000, min_tol: float = 1e-6, max_iters: int = 1000) -> DataFrame:
    """(characteristic, observed, pval, draws, converged): does the characteristic have no effect on any loading?"""
    tests = {f"row:{m.chars.index(c)}": c for c in chars}
    got = p_values(wild_bootstrap(spark, m, fit, list(tests), draws, min_tol, max_iters, given))
    label = F.create_map(*[F.lit(v) for kv in tests.items() for v in kv])
    return got.select(label[F.col("test")].alias("characteristic"), "observed", "pval", "draws", "converged")


def wald_last(spark: SparkSession, m: Moments, fit: Fit, given: np.ndarray, draws: int = 1000, min_tol: float = 1e-6, max_iters: int = 1000, compat: bool = False) -> DataFrame:
    """(test, observed, pval, draws, converged): do the loadings on the last factor vanish? With a constant given factor that is the test of alpha,
    with one other given factor that of delta. ``compat`` tests the last latent factor of a model without a given one."""
    if not compat and given.shape[1] != 1:
        raise ValueError("exactly one given factor is needed")
    return p_values(wild_bootstrap(spark, m, fit, ["last"], draws, min_tol, max_iters, given))


@dataclass(frozen=True)
class Spec:
    """One model of a grid: K latent factors and some of the given ones by name."""

    label: str
    k: int
    factors: tuple[str, ...] = ()
    oos: bool = False
    size: int = 60


def grid(spark: SparkSession, m: Moments, given: dict[str, np.ndarray], specs: Sequence[Spec], min_tol: float = 1e-6, max_iters: int = 1000) -> DataFrame:
    """(label, k, factors, oos, dates, iters, r2_total, r2_pred, assets_total, assets_pred) of every model.

    ``dates`` is the number of dates the R2 are over, of portfolios and of single returns, against a forecast of zero. A model
    is fitted in a task of its own, one out of sample in a task for each block of ``OOS_BLOCK`` dates; tasks return sums of
    squares, which are put together by label.
    """
    specs = list(specs)
    jobs = [(i, t) for i, s in enumerate(specs) for t in (range(s.size, len(m.dates), OOS_BLOCK) if s.oos else [-1])]

    def work(moments: Moments, job: int) -> list[tuple]:
        number, begin = jobs[job]
        s = specs[number]
        g = np.column_stack([given[f] for f in s.factors]) if s.factors else np.zeros((len(moments.dates), 0))
        if s.oos:
            got = forecasts(moments, s.k, g, "constant", min_tol, max_iters, None, "recursive", s.size, begin)
            at, iters = np.array([t for t, *_ in got]), max(i for *_, i in got)
            q = [np.array([gamma @ (f, mean)[j] for _, gamma, f, mean, _ in got]) for j in (0, 1)]
        else:
            e = kernel.estimate(moments.x, moments.w, moments.n, s.k, g, min_tol, max_iters)
            at, iters = np.arange(len(moments.dates)), e.iters
            q = [e.factors @ e.gamma.T, np.tile(e.gamma @ e.factors.mean(axis=0), (len(at), 1))]
        x, w = moments.x[at], moments.w[at]
        left = [float(((x - np.einsum("tlm,tm->tl", w, v)) ** 2).sum()) for v in q] + [float(moments.left(v, at).sum()) for v in q]
        return [(number, len(at), iters, *left, float((x**2).sum()), float(moments.s[at].sum()))]

    parts = _spread(spark, len(jobs), m, work, "number int, dates int, iters int, xt double, xp double, rt double, rp double, xx double, rr double")
    sums = parts.groupBy("number").agg(F.sum("dates").cast("int").alias("dates"), F.max("iters").alias("iters"), *[F.sum(c).alias(c) for c in ("xt", "xp", "rt", "rp", "xx", "rr")])
    label = spark.createDataFrame([(i, s.label, s.k, ",".join(s.factors), s.oos) for i, s in enumerate(specs)], "number int, label string, k int, factors string, oos boolean")
    r2 = lambda left, whole: 1 - F.try_divide(F.col(left), F.col(whole))
    return sums.join(F.broadcast(label), "number").select(  # one row per model
        "label", "k", "factors", "oos", "dates", "iters",
        r2("xt", "xx").alias("r2_total"), r2("xp", "xx").alias("r2_pred"), r2("rt", "rr").alias("assets_total"), r2("rp", "rr").alias("assets_pred"),
    )


def nested_specs(order: Sequence[str], ks: Sequence[int] | None = (0,), prefix: str = "", **more) -> list[Spec]:
    """Models with the first 1, 2, ... given factors, for each number of latent ones; ``ks`` None: as many latent as given ones."""
    specs = []
    for i in range(len(order)):
        for k in [i + 1] if ks is None else ks:
            specs.append(Spec(f"{prefix}K{k}+{'+'.join(order[: i + 1])}", k, tuple(order[: i + 1]), **more))
    return specs


ARRAYS = ("gamma", "factors", "means", "var1", "x_total", "x_pred")


def save(spark: SparkSession, fit: Fit, path: str) -> None:
    """A fit as Parquet in the folder ``path``, which may lie on any file system Spark can write: (name, shape, values) of its
    arrays and, as JSON, what else there is."""
    rest = {"chars": fit.chars, "names": fit.names, "dates": [str(d) for d in fit.dates], "k": fit.k, "first": fit.first}
    rows = [(c, list(getattr(fit, c).shape), [float(v) for v in getattr(fit, c).ravel()], None) for c in ARRAYS]
    rows.append(("rest", [], [], json.dumps(rest)))
    spark.createDataFrame(rows, "name string, shape array<int>, values array<double>, json string").coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> Fit:
    """A fit that ``save`` wrote; its dates are text."""
    rows = {r["name"]: r for r in spark.read.parquet(path).collect()}  # one row per array
    arrays = {c: np.array(rows[c]["values"], dtype=float).reshape(rows[c]["shape"]) for c in ARRAYS}
    return Fit(**json.loads(rows["rest"]["json"]), **arrays)


__all__ = ["CONSTANT", "IPCA", "Fit", "Spec", "grid", "load", "nested_specs", "p_values", "save", "wald_beta", "wald_last", "wild_bootstrap"]

"""Queries of the instrumented factor model. What is random, or iterates over more than one factor, has no SQL and is tested against numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelmill.operators.cross_section import correlation_p, order_by_list, significance, wide_by
from panelmill.plans import ipca, steps
from panelmill.plans.moments import Moments, collect_moments, moment_rows
from panelmill.queries.base import num, qnum
from panelmill.queries.cross_section import CHARS, CORR, SCORE, all_factors, correlation_rows, factor_frame, p_sql
from panelmill.session import pinned
from panelmill.sources import files
from panelmill.sources.panel import estimation_panel

QUERIES, ORACLES = {}, {}
DRAWS = 1000  # of each bootstrap test
#: Fixed loadings for the queries that SQL can check.
GAMMA = {"mcap": 0.6, "r2_1": -0.3, "r7_0": 0.2, "rvol_30d": 0.5, "beta": -0.5, "illiq": 0.4, "turn_7d": 0.1, "dh90": -0.2}
FACTORS = ("cmkt", "cmom", "smb", "liq", "vol")
GROUPS = {"mcap": "size", "r2_1": "momentum", "r7_0": "momentum", "dh90": "momentum", "rvol_30d": "risk", "beta": "risk", "illiq": "liquidity", "turn_7d": "liquidity"}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _model(spark: SparkSession, path: str, chars=CHARS, constant: bool = False) -> ipca.IPCA:
    return ipca.IPCA(estimation_panel(spark, path).select("date", "entity", "ret_excess", *chars), "ret_excess", chars, add_constant=constant)


def _frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


@query("select date, count(*) as n from estimation_panel group by 1")
def cross_section_n(spark: SparkSession, path: str) -> DataFrame:
    return moment_rows(estimation_panel(spark, path), "ret_excess", CHARS).select("date", "n")


_X = " union all ".join(f"select date, '{c}' as characteristic, {qnum(f'avg({c} * ret_excess)', 'x', 12)} from estimation_panel group by 1" for c in CHARS)
_PAIRS = [(i, j) for i in range(len(CHARS)) for j in range(i, len(CHARS))]
_W = " union all ".join(f"select date, '{CHARS[i]}' as a, '{CHARS[j]}' as b, {qnum(f'avg({CHARS[i]} * {CHARS[j]})', 'w', 12)} from estimation_panel group by 1" for i, j in _PAIRS)


@query(_X)
def managed_portfolios_x(spark: SparkSession, path: str) -> DataFrame:
    """Returns of the portfolios managed by each characteristic."""
    rows = moment_rows(estimation_panel(spark, path), "ret_excess", CHARS)
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("characteristic"), F.col("x")[i].alias("x")) for i, c in enumerate(CHARS)]))
    return rows.select("date", each.alias("e")).select("date", "e.characteristic", F.col("e.x").alias("x")).select("date", "characteristic", num("x", 12))


@query(_W)
def second_moments_w(spark: SparkSession, path: str) -> DataFrame:
    rows = moment_rows(estimation_panel(spark, path), "ret_excess", CHARS)
    each = F.explode(F.array(*[F.struct(F.lit(CHARS[i]).alias("a"), F.lit(CHARS[j]).alias("b"), F.col("w")[i * len(CHARS) + j].alias("w")) for i, j in _PAIRS]))
    return rows.select("date", each.alias("e")).select("date", "e.*").select("date", "a", "b", num("w", 12))


@query(f"""select date, {qnum('avg(ret_excess)', 'x', 12)}, {', '.join(qnum(f'avg({c})', f'w_{c}', 12) for c in CHARS)}, {qnum('sum(ret_excess * ret_excess)', 's', 10)}
from estimation_panel group by 1""")
def moments_of_a_constant(spark: SparkSession, path: str) -> DataFrame:
    """The last row of the moments when a constant is the last characteristic."""
    rows = moment_rows(estimation_panel(spark, path), "ret_excess", CHARS, add_constant=True)
    size = len(CHARS) + 1
    shown = [F.col("w")[len(CHARS) * size + i].alias(f"w_{c}") for i, c in enumerate(CHARS)]
    return rows.select("date", F.col("x")[len(CHARS)].alias("x"), *shown, "s").select("date", num("x", 12), *[num(f"w_{c}", 12) for c in CHARS], num("s", 10))


# SQL of the estimator's linear algebra: matrices are lists of rows.


def _solve(m: str, n: int) -> str:
    """Gauss-Jordan elimination of an augmented matrix of n rows as one expression; gives the solution as a list."""
    k = "e[1][1]::int"
    row = f"list_transform(range(1, {n + 2}), lambda j: case when i = {k} then m[i][j] / m[i][i] else m[i][j] - m[i][{k}] * m[{k}][j] / m[{k}][{k}] end)"
    step = f"lambda m, e: list_transform(range(1, {n + 1}), lambda i: {row})"
    return f"list_transform(list_reduce(list_concat([{m}], list_transform(range(1, {n + 1}), lambda k: [[k::double]])), {step}), lambda r: r[{n + 1}])"


def _normal(factors: list[str]) -> str:
    """The augmented normal equations of the loadings on factors, given as expressions, over the dates of a table with n, x, w."""
    size, km = len(CHARS), len(factors)
    rows = []
    for i in range(size):
        for a in range(km):
            left = [f"sum(n * {factors[a]} * {factors[b]} * w[{i + 1}][{j + 1}])" for j in range(size) for b in range(km)]
            rows.append(f"[{', '.join(left)}, sum(n * {factors[a]} * x[{i + 1}])]")
    return f"[{', '.join(rows)}]"


def _list(values) -> str:
    return f"[{', '.join(map(str, values))}]"


_MOM = f"""mom as (select date, count(*)::double as n, {_list(f'avg({c} * ret_excess)' for c in CHARS)} as x,
  {_list(_list(f'avg({a} * {b})' for b in CHARS) for a in CHARS)} as w, sum(ret_excess * ret_excess) as s from estimation_panel group by 1)"""
_WG = "list_transform(w, lambda r: list_inner_product(r, {g}))"
_F1 = f"list_inner_product({{g}}, x) / list_inner_product({{g}}, {_WG})"
_G0 = f"{_list(GAMMA[c] for c in CHARS)}::double[]"
_Z = _list(CHARS)
_BT = f"list_inner_product({_Z}, {_G0})"
_STEP = f"""b as (select *, {_BT} as bt from estimation_panel),
f as (select date, sum(bt * ret_excess) / sum(bt * bt) as f from b group by 1)"""


def _by_char(expr: str, name: str, source: str, places: int = 8) -> str:
    return " union all ".join(f"select '{c}' as characteristic, {qnum(expr.format(i=i + 1), name, places)} from {source}" for i, c in enumerate(CHARS))


def _fixed_gamma() -> np.ndarray:
    return np.array([[GAMMA[c]] for c in CHARS])


def _fixed_rows(spark: SparkSession, path: str) -> DataFrame:
    return pinned(moment_rows(estimation_panel(spark, path), "ret_excess", CHARS))


_TIMES = "list_transform(m, lambda r: list_inner_product(r, v))"


@query(f"""with recursive {_MOM}, xx as (select {_list(_list(f'sum(x[{i + 1}] * x[{j + 1}])' for j in range(len(CHARS))) for i in range(len(CHARS)))} as m from mom),
it(k, v) as (select 0, {_G0} union all select k + 1, list_transform(u, lambda a: a / sqrt(list_inner_product(u, u))) from (select k, {_TIMES} as u from it, xx where k < 2000)),
fin as (select list_transform(v, lambda a: a * sign(v[1])) as g from it where k = 2000) {_by_char('g[{i}]', 'gamma', 'fin', 5)}""")
def start_k1(spark: SparkSession, path: str) -> DataFrame:
    """The loadings the estimator starts from: the leading singular vector of the portfolios, here with a first entry above 0."""
    m = collect_moments(estimation_panel(spark, path), "ret_excess", CHARS)
    g = ipca.kernel.initial(m.x, 1, np.zeros((len(m.dates), 0)))[0][:, 0]
    return _frame(spark, [(c, float(v * np.sign(g[0]))) for c, v in zip(CHARS, g)], "characteristic string, gamma double").select("characteristic", num("gamma", 5))


@query(f"with {_STEP} select date, {qnum('f', 'f')} from f")
def als_factor_step_k1(spark: SparkSession, path: str) -> DataFrame:
    """The factor of each date for one column of fixed loadings."""
    return steps.factor_rows(_fixed_rows(spark, path), _fixed_gamma(), 1).select("date", F.col("f")[0].alias("f")).select("date", num("f"))


@query(f"with {_MOM}, f as (select *, {_F1.format(g=_G0)} as f from mom), g as (select {_solve('a', len(CHARS))} as g from (select {_normal(['f'])} as a from f)) {_by_char('g[{i}]', 'gamma', 'g', 6)}")
def als_loading_step_k1(spark: SparkSession, path: str) -> DataFrame:
    """The loadings that the factors of the fixed loadings lead to."""
    gamma = steps.loading_step(_fixed_rows(spark, path), _fixed_gamma(), 1)[0]
    return _frame(spark, [(c, float(v)) for c, v in zip(CHARS, gamma[:, 0])], "characteristic string, gamma double").select("characteristic", num("gamma", 6))


_NORM = "list_transform(v, lambda a: a / sqrt(list_inner_product(v, v)))"
_ALS_ROUNDS = 10
_ALS = f"""with recursive {_MOM}, it(k, g) as (select 0, {_G0} union all
select k + 1, {_NORM} from (select k, {_solve('a', len(CHARS))} as v from (select k, {_normal(['f'])} as a from (select k, n, x, w, {_F1.format(g='g')} as f from it, mom where k < {_ALS_ROUNDS}) group by k))),
last as (select g from it where k = {_ALS_ROUNDS}), fac as (select date, {_F1.format(g='g')} as f from mom, last),
fin as (select list_transform(g, lambda a: a * case when m < 0 then -1 else 1 end) as g from last, (select avg(f) as m from fac))"""


@query(f"{_ALS} {_by_char('g[{i}]', 'gamma', 'fin', 5)}")
def als_rounds_k1(spark: SparkSession, path: str) -> DataFrame:
    """Ten rounds of the estimator from the fixed loadings, as jobs over the moments where they are, normalised in the end."""
    rows, g = _fixed_rows(spark, path), _fixed_gamma()
    for _ in range(_ALS_ROUNDS):
        g = steps.loading_step(rows, g, 1)[0]
        g = g / np.linalg.norm(g)
    mean = steps.factor_rows(rows, g, 1).agg(F.avg(F.col("f")[0])).first()[0]
    g = g if mean >= 0 else -g
    return _frame(spark, [(c, float(v)) for c, v in zip(CHARS, g[:, 0])], "characteristic string, gamma double").select("characteristic", num("gamma", 5))


def _ten_rounds(spark: SparkSession, path: str, rows: list[int] | None = None) -> DataFrame:
    """The same on the driver."""
    m = collect_moments(estimation_panel(spark, path), "ret_excess", CHARS)
    g = _fixed_gamma()
    start = (g, ipca.kernel.factor_step(g, m.x, m.w, np.zeros((len(m.dates), 0)), 1))
    e = ipca.kernel.estimate(m.x, m.w, m.n, 1, min_tol=0.0, max_iters=_ALS_ROUNDS, start=start, rows=rows)
    return _frame(spark, [(c, float(v)) for c, v in zip(CHARS, e.gamma[:, 0])], "characteristic string, gamma double")


@query(f"{_ALS}, g as (select list_transform(g, lambda a: a / g[{CHARS.index('beta') + 1}]) as g from fin) {_by_char('g[{i}]', 'gamma', 'g', 5)}")
def identity_rounds_k1(spark: SparkSession, path: str) -> DataFrame:
    """Ten rounds with the factor named by a characteristic that loads on it with 1."""
    return _ten_rounds(spark, path, [CHARS.index("beta")]).select("characteristic", num("gamma", 5))


def _fixed(spark: SparkSession, path: str) -> DataFrame:
    panel = estimation_panel(spark, path).select("obs_id", "date", "entity", "ret_excess", *CHARS)
    g = _fixed_gamma()
    got = steps.factor_rows(_fixed_rows(spark, path), g, 1).collect()  # one row per date
    mean = float(np.mean([r["f"][0] for r in got]))
    per = [(r["date"], [float(v) for v in g[:, 0] * r["f"][0]], [float(v) for v in g[:, 0] * mean]) for r in got]
    return ipca.asset_fits(panel, "ret_excess", CHARS, per, entity="obs_id")


@query(f"""with {_STEP}, l as (select avg(f) as l from f)
select obs_id, date, {qnum('bt * f', 'total')}, {qnum('bt * l', 'pred')} from b join f using (date) cross join l""")
def asset_fits_fixed_gamma(spark: SparkSession, path: str) -> DataFrame:
    """Fitted returns of every observation for fixed loadings."""
    return _fixed(spark, path).select("obs_id", "date", num("total"), num("pred"))


@query(f"""with {_STEP}, l as (select avg(f) as l from f)
select {qnum('1 - sum(pow(ret_excess - bt * f, 2)) / sum(pow(ret_excess, 2))', 'total')},
  {qnum('1 - sum(pow(ret_excess - bt * l, 2)) / sum(pow(ret_excess, 2))', 'pred')} from b join f using (date) cross join l""")
def r2_fixed_gamma(spark: SparkSession, path: str) -> DataFrame:
    return _fixed(spark, path).agg(ipca.r2_column("total").alias("total"), ipca.r2_column("pred").alias("pred")).select(num("total"), num("pred"))


_BENCHES = ("zero", "all_mean", "individual_mean", "all_mean_recursive", "individual_mean_recursive")


@query(f"""with {_STEP}, l as (select avg(f) as l from f),
d as (select date, sum(ret_excess) as s, count(*) as n from estimation_panel group by 1),
dr as (select date, coalesce(sum(s) over p / sum(n) over p, 0) as b from d window p as (order by date rows between unbounded preceding and 1 preceding)),
e as (select entity, date, sum(ret_excess) as s, count(*) as n from estimation_panel group by 1, 2),
er as (select entity, date, coalesce(sum(s) over p / sum(n) over p, 0) as b from e window p as (partition by entity order by date rows between unbounded preceding and 1 preceding)),
x as (select ret_excess as r, bt * f as t, bt * l as p, 0.0 as zero, avg(ret_excess) over () as all_mean, avg(ret_excess) over (partition by entity) as individual_mean,
  dr.b as all_mean_recursive, er.b as individual_mean_recursive from b join f using (date) cross join l join dr using (date) join er using (entity, date))
{' union all '.join(f"select '{k}' as bench, {qnum(f'1 - sum(pow(r - t, 2)) / sum(pow(r - {k}, 2))', 'total')}, {qnum(f'1 - sum(pow(r - p, 2)) / sum(pow(r - {k}, 2))', 'pred')} from x" for k in _BENCHES)}""")
def asset_r2_fixed_gamma(spark: SparkSession, path: str) -> DataFrame:
    """R2 of single returns for fixed loadings against five benchmarks."""
    keys = estimation_panel(spark, path).select(F.col("obs_id").alias("_obs"), "entity")
    fits = _fixed(spark, path)
    rows = pinned(fits.join(keys, F.col("obs_id") == F.col("_obs")).drop("_obs"))
    out = None
    for bench in _BENCHES:
        got = ipca.asset_benchmark(rows, bench).agg(*[ipca.r2_column(c, F.col("bench")).alias(c) for c in ("total", "pred")])
        got = got.select(F.lit(bench).alias("bench"), num("total"), num("pred"))
        out = got if out is None else out.unionByName(got)
    return out


@query(f"with {_MOM}, f as (select *, {_F1.format(g=_G0)} as f, {_WG.format(g=_G0)} as wg from mom), l as (select avg(f) as l from f) {' union all '.join(f'''select date, '{c}' as characteristic, {qnum(f'wg[{i + 1}] * f', 'total', 10)}, {qnum(f'wg[{i + 1}] * l', 'pred', 10)} from f, l''' for i, c in enumerate(CHARS))}")
def portfolio_fits_fixed_gamma(spark: SparkSession, path: str) -> DataFrame:
    """Fitted returns of the managed portfolios for fixed loadings."""
    rows, g = _fixed_rows(spark, path), _fixed_gamma()
    f = steps.factor_rows(rows, g, 1)
    mean = F.lit(float(f.agg(F.avg(F.col("f")[0])).first()[0]))
    size = len(CHARS)
    wg = lambda i: sum((F.col("w")[i * size + j] * float(g[j, 0]) for j in range(size)), F.lit(0.0))
    each = F.array(*[F.struct(F.lit(c).alias("characteristic"), (wg(i) * F.col("f")[0]).alias("total"), (wg(i) * mean).alias("pred")) for i, c in enumerate(CHARS)])
    return rows.join(f, "date").select("date", F.explode(each).alias("e")).select("date", "e.*").select("date", "characteristic", num("total", 10), num("pred", 10))


@query(f"""with {_STEP}, p as (select date, f, lag(f) over (order by date) as p from f), c as (select regr_slope(f, p) as slope, regr_intercept(f, p) as cut from p where p is not null)
select date, {qnum('case when p is not null then cut + slope * p else (select avg(f) from f) end', 'f')} from p, c""")
def var1_fixed_gamma(spark: SparkSession, path: str) -> DataFrame:
    """Expected factors of each date from an autoregression, for fixed loadings; the first has the mean."""
    got = sorted(steps.factor_rows(_fixed_rows(spark, path), _fixed_gamma(), 1).collect(), key=lambda r: r["date"])  # one row per date
    f = np.array([r["f"] for r in got])
    means = np.vstack([f.mean(axis=0), np.hstack([f[:-1], np.ones((len(f) - 1, 1))]) @ ipca.kernel.var1(f).T])
    return _frame(spark, [(r["date"], float(v[0])) for r, v in zip(got, means)], "date date, f double").select("date", num("f"))


def _gamma_rows(fit: ipca.Fit) -> list[tuple]:
    g = fit.gamma if fit.gamma.ndim == 2 else fit.gamma[-1]
    return [(c, name, float(g[i, j])) for i, c in enumerate(fit.chars) for j, name in enumerate(fit.names)]


_GAMMA = "characteristic string, factor string, gamma double"


@query()
def ipca_fit(spark: SparkSession, path: str) -> DataFrame:
    """Loadings of two latent factors."""
    return _frame(spark, _gamma_rows(_model(spark, path).fit(K=2)), _GAMMA)


@query()
def ipca_identity(spark: SparkSession, path: str) -> DataFrame:
    """Two latent factors named by the characteristics that load on them with 1."""
    fit = _model(spark, path).fit(K=2, normalization_choice="Identity", normalization_choice_specs=["beta", "mcap"])
    return _frame(spark, _gamma_rows(fit), _GAMMA)


def _with_factors(spark: SparkSession, path: str) -> tuple[ipca.IPCA, dict]:
    """The panel on the dates that have all sorted-portfolio factors, and these by date. Dates that lack one are left out."""
    rows = factor_frame(spark, path).select("date", *FACTORS).dropna().collect()  # one row per date
    table = {r["date"]: [r[c] for c in FACTORS] for r in rows}
    dates = spark.createDataFrame([(d,) for d in table], "date date")
    panel = estimation_panel(spark, path).select("date", "entity", "ret_excess", *CHARS).join(F.broadcast(dates), "date", "left_semi")
    model = ipca.IPCA(panel, "ret_excess", CHARS)
    return model, table


_GIVEN = f"{{head}}fct as ({all_factors(15)}), {_MOM}, mf as (select mom.*, fct.* exclude (date) from mom join fct using (date) where {' and '.join(f'{c} is not null' for c in FACTORS)})"


def _given_sql(m: int) -> str:
    return f"with {_GIVEN.format(head='')}, g as (select {_solve('a', len(CHARS) * m)} as g from (select {_normal(list(FACTORS[:m]))} as a from mf))"


@query(f"{_given_sql(2)} {' union all '.join(f'''select '{c}' as characteristic, '{FACTORS[j]}' as factor, {qnum(f'g[{i * 2 + j + 1}]', 'gamma', 5)} from g''' for i, c in enumerate(CHARS) for j in range(2))}")
def ipca_fit_observable(spark: SparkSession, path: str) -> DataFrame:
    """Loadings on the market and momentum factors alone."""
    model, table = _with_factors(spark, path)
    fit = model.fit(K=0, gFac={d: v[:2] for d, v in table.items()}, G_names=list(FACTORS[:2]))
    return _frame(spark, _gamma_rows(fit), _GAMMA).select("characteristic", "factor", num("gamma", 5))


@query(f"""{_given_sql(1)} select obs_id, e.date, {qnum('list_inner_product(' + _Z + ', g.g)', 'beta', 5)}
from estimation_panel e join (select date from mf) d using (date), g""")
def betas_observable(spark: SparkSession, path: str) -> DataFrame:
    """Every observation's loading on the market factor."""
    model, table = _with_factors(spark, path)
    fit = model.fit(K=0, gFac={d: v[:1] for d, v in table.items()}, G_names=["cmkt"])
    dates = spark.createDataFrame([(d,) for d in fit.dates], "date date")
    rows = estimation_panel(spark, path).select("obs_id", "date", "ret_excess", *CHARS).join(F.broadcast(dates), "date", "left_semi")
    by_obs = ipca.IPCA(rows, "ret_excess", CHARS, entity="obs_id", moments=model.moments)
    return by_obs.betas(fit).select("obs_id", "date", num("beta", 5))


@query()
def ipca_fit_mixed(spark: SparkSession, path: str) -> DataFrame:
    """Loadings on one latent factor beside the market."""
    model, table = _with_factors(spark, path)
    return _frame(spark, _gamma_rows(model.fit(K=1, gFac={d: v[:1] for d, v in table.items()}, G_names=["cmkt"], minTol=1e-6, maxIters=1000)), _GAMMA)


@query()
def ipca_asset_r2(spark: SparkSession, path: str) -> DataFrame:
    """Total and predictive R2 of single returns and of portfolios against five benchmarks."""
    model = _model(spark, path)
    fit = model.fit(K=2)
    fits = pinned(model.asset_fits(fit))
    rows = []
    for bench in _BENCHES:
        rows.append(("returns", bench, *model.r2_assets(fit, bench, fits=fits)))
        rows.append(("portfolios", bench, *fit.r2_x(model.moments.x, bench)))
    return _frame(spark, rows, "of string, bench string, total double, pred double")


def _first_forecast(m: Moments) -> int:
    return max(2, len(m.dates) * 7 // 10)


@query()
def ipca_oos(spark: SparkSession, path: str) -> DataFrame:
    """Fitted returns out of sample, each date forecast from the dates before it."""
    model = _model(spark, path)
    fit = model.fit(K=1, OOS=True, OOS_window_specs=_first_forecast(model.moments), minTol=1e-6, maxIters=1000)
    return model.asset_fits(fit).select("date", "entity", num("total", 6), num("pred", 6))


_EW = "ew as (select date, avg(ret_excess) as m from estimation_panel group by 1)"


@query(f"""with {_MOM}, {_EW}, mw as (select *, row_number() over (order by date) - 1 as t, count(*) over () as dates from mom join ew using (date)),
late as (select date, t, m as now from mw where t >= greatest(2, dates * 7 // 10)),
g as (select date, now, mean, {_solve('a', len(CHARS))} as g from (select late.date, any_value(now) as now, avg(m) as mean, {_normal(['m'])} as a from late join mw on mw.t < late.t group by late.date))
select obs_id, date, {qnum('list_inner_product(' + _Z + ', g.g) * now', 'total', 6)}, {qnum('list_inner_product(' + _Z + ', g.g) * mean', 'pred', 6)} from estimation_panel join g using (date)""")
def oos_observable(spark: SparkSession, path: str) -> DataFrame:
    """Fitted returns out of sample on a given factor, the mean return of each date."""
    panel = estimation_panel(spark, path)
    means = {r["date"]: [r["m"]] for r in panel.groupBy("date").agg(F.avg("ret_excess").alias("m")).collect()}  # one row per date
    model = ipca.IPCA(panel.select("date", "obs_id", "ret_excess", *CHARS), "ret_excess", CHARS, entity="obs_id")
    fit = model.fit(K=0, OOS=True, gFac=means, OOS_window_specs=_first_forecast(model.moments))
    return model.asset_fits(fit).select("obs_id", "date", num("total", 6), num("pred", 6))


@query(ORACLES["oos_observable"].split("select obs_id, date,")[0] + f"select obs_id, date, {qnum('list_inner_product(' + _Z + ', g.g)', 'beta', 5)} from estimation_panel join g using (date)")
def oos_betas(spark: SparkSession, path: str) -> DataFrame:
    """Every observation's loading on that factor, estimated on the dates before its own."""
    panel = estimation_panel(spark, path)
    means = {r["date"]: [r["m"]] for r in panel.groupBy("date").agg(F.avg("ret_excess").alias("m")).collect()}  # one row per date
    model = ipca.IPCA(panel.select("date", "obs_id", "ret_excess", *CHARS), "ret_excess", CHARS, entity="obs_id")
    fit = model.fit(K=0, OOS=True, gFac=means, OOS_window_specs=_first_forecast(model.moments))
    return model.betas(fit).select("obs_id", "date", num("beta", 5))


@query()
def var1_lambda(spark: SparkSession, path: str) -> DataFrame:
    """Expected factors of each date from a vector autoregression."""
    fit = _model(spark, path).fit(K=2, factor_mean="VAR1")
    return _frame(spark, [(d, *map(float, v)) for d, v in zip(fit.dates, fit.means)], "date date, f0 double, f1 double")


@query()
def wald_beta(spark: SparkSession, path: str) -> DataFrame:
    """p-values of all characteristics from 1,000 draws each."""
    model = _model(spark, path)
    fit = model.fit(K=1, minTol=1e-6)
    return ipca.wald_beta(spark, model.moments, fit, CHARS, np.zeros((len(fit.dates), 0)), draws=DRAWS)


@query()
def pvalue_matrix(spark: SparkSession, path: str) -> DataFrame:
    """p-values written to one CSV folder per number of factors, read back with that number from the name, side by side with scores."""
    model, at = _model(spark, path), files.scratch(spark)
    for k in (1, 2):
        fit = model.fit(K=k, minTol=1e-6)
        got = ipca.wald_beta(spark, model.moments, fit, CHARS, np.zeros((len(fit.dates), 0)), draws=DRAWS)
        files.write_csv(got.select("characteristic", F.col("pval").alias("pval_beta"), "converged"), f"{at}/{k}_factors_pvals")
    rows = files.taken(files.keyed_csv(spark, f"{at}/*_factors_pvals", "characteristic string, pval_beta double, converged long"), at)
    wide = wide_by(rows, "characteristic", "k", [1, 2], "pval_beta", "k").join(wide_by(rows, "characteristic", "k", [1, 2], "converged", "converged_k"), "characteristic")
    wide = order_by_list(wide, "characteristic", CHARS)
    scores = [significance(F.col(f"k{k}")).alias(f"score_k{k}") for k in (1, 2)]
    return wide.select("place", "characteristic", "k1", "k2", *scores, *[F.col(f"converged_k{k}").cast("long").alias(f"converged_k{k}") for k in (1, 2)])


@query(f"""with one as (select * from estimation_panel where day(date) % 2 = 1), two as (select * from estimation_panel where day(date) % 2 = 0),
p1 as (select characteristic, {p_sql('r', 'n')} as p from ({CORR.format('one')})), p2 as (select characteristic, {p_sql('r', 'n')} as p from ({CORR.format('two')}))
select list_position({_list(repr(c) for c in CHARS)}, characteristic)::bigint as place, characteristic, {qnum('p1.p', 'k1', 6)}, {qnum('p2.p', 'k2', 6)},
  {SCORE.format(p='p1.p')} as score_k1, {SCORE.format(p='p2.p')} as score_k2 from p1 join p2 using (characteristic)""")
def correlation_matrix(spark: SparkSession, path: str) -> DataFrame:
    """The same from p-values that SQL has too: those of the correlations with the return on odd (1) and on even days (2)."""
    at = files.scratch(spark)
    for k in (1, 2):
        got = correlation_rows(estimation_panel(spark, path).filter(F.dayofmonth("date") % 2 == k % 2)).withColumn("pval", correlation_p(F.col("r"), F.col("n")))
        files.write_csv(got.select("characteristic", "pval"), f"{at}/{k}_factors_pvals")
    rows = files.taken(files.keyed_csv(spark, f"{at}/*_factors_pvals", "characteristic string, pval double"), at)
    wide = order_by_list(wide_by(rows, "characteristic", "k", [1, 2], "pval", "k"), "characteristic", CHARS)
    return wide.select("place", "characteristic", num("k1", 6), num("k2", 6), *[significance(F.col(f"k{k}")).alias(f"score_k{k}") for k in (1, 2)])


@query()
def wald_alpha(spark: SparkSession, path: str) -> DataFrame:
    """Is there an intercept beside one latent factor?"""
    model = _model(spark, path)
    fit = model.fit(K=1, gFac={d: [1.0] for d in model.moments.dates}, G_names=["alpha"], minTol=1e-6, maxIters=1000)
    return ipca.wald_last(spark, model.moments, fit, np.ones((len(fit.dates), 1)), draws=DRAWS)


@query()
def wald_delta(spark: SparkSession, path: str) -> DataFrame:
    """Does the market add to one latent factor?"""
    model, table = _with_factors(spark, path)
    given = {d: v[:1] for d, v in table.items()}
    fit = model.fit(K=1, gFac=given, G_names=["cmkt"], maxIters=100)
    return ipca.wald_last(spark, model.moments, fit, ipca.given_factors(model.moments, given), draws=DRAWS)


def _grid_inputs(spark: SparkSession, path: str) -> tuple[Moments, dict[str, np.ndarray]]:
    model, table = _with_factors(spark, path)
    return model.moments, {c: np.array([table[d][i] for d in model.moments.dates]) for i, c in enumerate(FACTORS)}


@query()
def ipca_grid(spark: SparkSession, path: str) -> DataFrame:
    """Nested given factors alone and beside as many latent ones; one to six latent factors beside one, three and five given ones."""
    m, given = _grid_inputs(spark, path)
    nested = ipca.nested_specs(FACTORS, prefix="SL ") + ipca.nested_specs(FACTORS, None, prefix="DL ")
    mixed = [ipca.Spec(f"{name} K{k}", k, FACTORS[:n]) for name, n in (("MKT", 1), ("MKT_3", 3), ("MKT_5", 5)) for k in range(1, 7)]
    return ipca.grid(spark, m, given, nested).unionByName(ipca.grid(spark, m, given, mixed, max_iters=500))


@query()
def ipca_oos_grid(spark: SparkSession, path: str) -> DataFrame:
    """The nested models out of sample, with no and with as many latent factors."""
    m, given = _grid_inputs(spark, path)
    more = {"oos": True, "size": _first_forecast(m)}
    return ipca.grid(spark, m, given, ipca.nested_specs(FACTORS, prefix="SL ", **more) + ipca.nested_specs(FACTORS, None, prefix="DL ", **more))


def _r2_sql(m: int) -> str:
    """R2 of portfolios and of single returns on the first m given factors, from the moments."""
    q = _list(" + ".join(f"g.g[{i * m + j + 1}] * {{}}{FACTORS[j]}" for j in range(m)) for i in range(len(CHARS)))
    real, mean = q.replace("{}", ""), q.replace("{}", "m_")
    left = lambda v: f"list_sum(list_transform(list_zip(x, {_WG.format(g=v)}), lambda z: pow(z[1] - z[2], 2)))"
    rest = lambda v: f"s - n * (2 * list_inner_product({v}, x) - list_inner_product({v}, {_WG.format(g=v)}))"
    return f"""select 'SL K0+{'+'.join(FACTORS[:m])}' as label, count(*)::int as dates, {qnum('1 - sum(xt) / sum(xx)', 'r2_total', 6)}, {qnum('1 - sum(xp) / sum(xx)', 'r2_pred', 6)},
  {qnum('1 - sum(rt) / sum(s)', 'assets_total', 6)}, {qnum('1 - sum(rp) / sum(s)', 'assets_pred', 6)} from (select s, list_inner_product(x, x) as xx, {left('q')} as xt, {left('p')} as xp, {rest('q')} as rt, {rest('p')} as rp
  from (select mf.*, {real} as q, {mean} as p from mf, mm, (select {_solve('a', len(CHARS) * m)} as g from (select {_normal(list(FACTORS[:m]))} as a from mf)) g))"""


@query(f"with {_GIVEN.format(head='')}, mm as (select {', '.join(f'avg({c}) as m_{c}' for c in FACTORS)} from mf) {' union all '.join(_r2_sql(m) for m in range(1, 6))}")
def grid_observable(spark: SparkSession, path: str) -> DataFrame:
    """The models of the grid that have given factors alone."""
    m, given = _grid_inputs(spark, path)
    got = ipca.grid(spark, m, given, ipca.nested_specs(FACTORS, prefix="SL "))
    return got.select("label", "dates", *[num(c, 6) for c in ("r2_total", "r2_pred", "assets_total", "assets_pred")])


def _grouped(spark: SparkSession, rows: DataFrame) -> DataFrame:
    lookup = _frame(spark, list(GROUPS.items()), "characteristic string, kind string")
    rows = rows.join(F.broadcast(lookup), "characteristic", "left")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("kind").orderBy("characteristic"))).select("kind", "place", "characteristic", "gamma")


@query(f"""{_ALS}, r as ({_by_char('g[{i}]', 'gamma', 'fin', 5)}), k(characteristic, kind) as (values {', '.join(f"('{c}', '{k}')" for c, k in GROUPS.items())})
select kind, row_number() over (partition by kind order by characteristic)::int as place, characteristic, gamma from r left join k using (characteristic)""")
def gamma_by_group(spark: SparkSession, path: str) -> DataFrame:
    """Loadings of one latent factor, after ten rounds, with each characteristic's group, in a given order within it."""
    lookup = _frame(spark, list(GROUPS.items()), "characteristic string, kind string")
    rows = _ten_rounds(spark, path).join(F.broadcast(lookup), "characteristic", "left")  # one row per characteristic
    place = F.row_number().over(Window.partitionBy("kind").orderBy("characteristic"))
    return rows.withColumn("place", place).select("kind", "place", "characteristic", num("gamma", 5))


@query(f"with {_STEP} select date, {qnum('f', 'f')} from f")
def saved_model(spark: SparkSession, path: str) -> DataFrame:
    """A model with the fixed loadings, saved to a shared folder and loaded again: its factors."""
    m = collect_moments(estimation_panel(spark, path), "ret_excess", CHARS)
    g = _fixed_gamma()
    f = ipca.kernel.factor_step(g, m.x, m.w, np.zeros((len(m.dates), 0)), 1)
    means = np.tile(f.mean(axis=0), (len(f), 1))
    fits = [np.einsum("tlk,tk->tl", m.w @ g, v) for v in (f, means)]
    at = files.scratch(spark)
    ipca.save(spark, ipca.Fit(m.chars, ["0"], m.dates, 1, g, f, means, np.zeros((1, 2)), *fits), at)
    back = ipca.load(spark, at)
    rows = _frame(spark, [(d, float(v)) for d, v in zip(back.dates, back.factors[:, 0])], "date string, f double")
    return files.taken(rows.select(F.to_date("date").alias("date"), num("f")), at)

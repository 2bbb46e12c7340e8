"""The factor model: moments, kernel, fits, R2, bootstrap, grids."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelmill.plans import ipca, kernel, steps
from panelmill.plans.moments import collect_moments, moment_rows

CHARS = ["c0", "c1", "c2", "c3"]


def planted(seed=0, t_all=60, n=80, k=2, noise=0.01, given=0):
    rng = np.random.RandomState(seed)
    gamma = np.linalg.qr(rng.normal(size=(4, k + given)))[0]
    f = rng.normal(0.02, 0.05, (t_all, k + given))
    rows = []
    for t in range(t_all):
        z = rng.uniform(-0.5, 0.5, (n, 4))
        r = z @ gamma @ f[t] + rng.normal(0, noise, n)
        rows += [(dt.date(2024, 1, 1) + dt.timedelta(days=t), i, r[i], *z[i]) for i in range(n)]
    return pd.DataFrame(rows, columns=["date", "entity", "ret", *CHARS]), gamma, f


@pytest.fixture(scope="module")
def model(spark):
    pdf, gamma, f = planted()
    return ipca.IPCA(spark.createDataFrame(pdf).repartition(7), "ret", CHARS), pdf, gamma, f


def test_moments_against_numpy(spark, model):
    m, pdf = model[0].moments, model[1]
    for t, (d, g) in enumerate(pdf.groupby("date")):
        z, r = g[CHARS].to_numpy(), g.ret.to_numpy()
        assert m.dates[t] == d and m.n[t] == len(g)
        assert np.allclose(m.x[t], z.T @ r / len(g)) and np.allclose(m.w[t], z.T @ z / len(g))
    odd = pd.concat([pdf.head(5), pdf.head(2).assign(c0=None), pdf.head(2).assign(ret=np.nan)])
    got = collect_moments(spark.createDataFrame(odd).replace(float("nan"), None), "ret", CHARS, add_constant=True)
    assert got.n.tolist() == [5.0] and got.chars[-1] == "constant" and np.isclose(got.w[0, -1, -1], 1.0)
    assert collect_moments(spark.createDataFrame(pdf).limit(0), "ret", CHARS).dates == []


def test_recovers_a_planted_model(model):
    m, pdf, gamma, f = model
    fit = m.fit(K=2, minTol=1e-8)
    assert np.allclose(fit.gamma.T @ fit.gamma, np.eye(2), atol=1e-8)
    second = fit.factors.T @ fit.factors
    assert abs(second[0, 1]) < 1e-8 and second[0, 0] >= second[1, 1] and (fit.factors.mean(axis=0) >= 0).all()
    true, got = gamma @ f.T, fit.gamma @ fit.factors.T
    assert np.linalg.norm(true - got) / np.linalg.norm(true) < 0.1
    total, pred = fit.r2_x(m.moments.x)
    assert total > 0.98 and pred < total
    by_rows, by_rows_pred = m.r2_assets(fit)
    z = pdf[CHARS].to_numpy()
    t = pd.factorize(pdf.date)[0]
    mine = np.einsum("il,il->i", z, (fit.gamma @ fit.factors.T).T[t])
    assert np.isclose(by_rows, 1 - ((pdf.ret - mine) ** 2).sum() / (pdf.ret**2).sum())
    assert m.betas(fit).count() == 2 * len(pdf)


def test_as_many_factors_as_characteristics_fit_exactly(model):
    fit = model[0].fit(K=4, minTol=1e-10, maxIters=50)
    assert np.isclose(fit.r2_x(model[0].moments.x)[0], 1.0)


def test_identity_normalisation_is_the_same_model(model):
    m = model[0]
    a, b = m.fit(K=2, minTol=1e-9), m.fit(K=2, normalization_choice="Identity", normalization_choice_specs=["c1", "c2"], minTol=1e-9)
    assert np.allclose(b.gamma[1:3], np.eye(2), atol=1e-8)
    assert np.allclose(a.gamma @ a.factors.T, b.gamma @ b.factors.T, atol=1e-6)
    with pytest.raises(ValueError):
        m.fit(K=2, normalization_choice="Identity", normalization_choice_specs=["c1"])


def test_given_factors(spark):
    pdf, gamma, f = planted(1, k=2, given=1, noise=0.001)
    m = ipca.IPCA(spark.createDataFrame(pdf), "ret", CHARS)
    by_date = {d: [float(v)] for d, v in zip(m.moments.dates, f[:, 2])}
    alone = m.fit(K=0, gFac=by_date)
    mixed = m.fit(K=2, gFac=by_date, minTol=1e-8)
    assert alone.gamma.shape == (4, 1) and np.allclose(mixed.factors[:, 2], f[:, 2])
    assert np.abs(mixed.gamma[:, :2].T @ mixed.gamma[:, 2:]).max() < 1e-8
    assert mixed.r2_x(m.moments.x)[0] > 0.999 > alone.r2_x(m.moments.x)[0]
    with pytest.raises(ValueError):
        m.fit(K=0)
    with pytest.raises(ValueError):
        m.fit(K=0, gFac={m.moments.dates[0]: [1.0]})


def test_out_of_sample_uses_the_past_only(spark, model):
    m, pdf, *_ = model
    fit = m.fit(K=1, OOS=True, OOS_window_specs=40, minTol=1e-6, maxIters=200)
    cut = pdf[pd.factorize(pdf.date)[0] <= 50]
    early = ipca.IPCA(spark.createDataFrame(cut), "ret", CHARS).fit(K=1, OOS=True, OOS_window_specs=40, minTol=1e-6, maxIters=200)
    assert np.allclose(fit.gamma[40:51], early.gamma[40:51]) and np.allclose(fit.x_pred[40:51], early.x_pred[40:51])
    assert np.isnan(fit.gamma[:40]).all()
    rolling = m.fit(K=1, OOS=True, OOS_window="rolling", OOS_window_specs=20, factor_mean="VAR1", minTol=1e-6, maxIters=200)
    direct = kernel.estimate(m.moments.x[5:25], m.moments.w[5:25], m.moments.n[5:25], 1, min_tol=1e-9)
    assert np.allclose(np.abs(rolling.gamma[25]), np.abs(direct.gamma), atol=1e-3)
    assert m.asset_fits(fit).count() == 20 * 80


def test_var1():
    rng = np.random.RandomState(3)
    a, f = np.array([[0.5, 0.1], [0.0, -0.3]]), [np.zeros(2)]
    for _ in range(4000):
        f.append(a @ f[-1] + [0.1, 0.2] + rng.normal(0, 0.1, 2))
    assert np.allclose(kernel.var1(np.array(f)), np.column_stack([a, [0.1, 0.2]]), atol=0.05)


def test_benchmarks(spark, model):
    m = model[0]
    fit = m.fit(K=1)
    x = m.moments.x
    own = ipca.benchmark_x(x, "individual_mean_recursive", np.arange(len(x)))
    assert np.allclose(own[0], 0) and np.allclose(own[7], x[:7].mean(axis=0))
    assert np.allclose(ipca.benchmark_x(x, "all_mean_recursive", np.arange(len(x)))[7], x[:7].mean())
    rows = m.asset_fits(fit)
    pdf = rows.toPandas().sort_values(["entity", "date"])
    got = ipca.asset_benchmark(rows, "individual_mean_recursive").toPandas().sort_values(["entity", "date"])
    want = pdf.groupby("entity").ret.transform(lambda s: s.shift(1).expanding().mean()).fillna(0)
    assert np.allclose(got.bench, want)
    whole = ipca.asset_benchmark(rows, "all_mean_recursive").groupBy("date").agg(F.max("bench").alias("b")).toPandas().sort_values("date")
    sums = pdf.groupby("date").ret.agg(["sum", "count"]).cumsum().shift(1)
    assert np.allclose(whole.b, (sums["sum"] / sums["count"]).fillna(0))
    with pytest.raises(ValueError):
        ipca.asset_benchmark(rows, "?")


def test_bootstrap_draws_do_not_depend_on_tasks(spark, model):
    m = model[0]
    fit = m.fit(K=1, minTol=1e-6)
    none = np.zeros((60, 0))
    draws = ipca.wild_bootstrap(spark, m.moments, fit, ["row:0", "row:3"], 6, 1e-5, 200, none).toPandas().set_index(["test", "draw"]).stat
    rng = np.random.RandomState(4)
    null = fit.gamma.copy()
    null[3] = 0
    x = ipca.null_draw(m.moments, fit.factors, null, m.moments.x - fit.x_total, rng)
    mine = kernel.estimate(x, m.moments.w, m.moments.n, 1, none, 1e-5, 200).gamma[3]
    assert len(draws) == 12 and np.isclose(draws["row:3", 4], mine @ mine)


def test_tests_tell_effects_from_none(spark):
    rng = np.random.RandomState(6)
    pdf, _, f = planted(7, k=1, noise=0.02)
    t = pd.factorize(pdf.date)[0]
    pdf["ret"] = pdf.c0 * f[t, 0] * 3 + rng.normal(0, 0.02, len(pdf))
    m = ipca.IPCA(spark.createDataFrame(pdf), "ret", CHARS)
    fit = m.fit(K=1, minTol=1e-6)
    got = {r.characteristic: r.pval for r in ipca.wald_beta(spark, m.moments, fit, ["c0", "c2"], np.zeros((60, 0)), draws=40).collect()}
    assert got["c0"] == 0.0 and got["c2"] > 0.05
    ones = np.ones((60, 1))
    alpha = m.fit(K=1, gFac={d: [1.0] for d in m.moments.dates}, minTol=1e-6)
    assert ipca.wald_last(spark, m.moments, alpha, ones, draws=40).first().pval > 0.02
    with pytest.raises(ValueError):
        ipca.wald_last(spark, m.moments, fit, np.zeros((60, 0)))


def test_grid(spark, model):
    m, _, _, f = model
    given = {"a": f[:, 0], "b": f[:, 1]}
    specs = ipca.nested_specs(["a", "b"], (0, 1)) + [ipca.Spec("oos", 1, (), True, 40)]
    got = {r.label: r for r in ipca.grid(spark, m.moments, given, specs).collect()}
    assert len(got) == 5 and got["K0+a+b"].r2_total > 0.98 > got["K0+a"].r2_total
    alone = m.fit(K=0, gFac={d: [float(v)] for d, v in zip(m.moments.dates, f[:, 0])}, minTol=1e-6, maxIters=1000)
    assert np.isclose(alone.r2_x(m.moments.x)[0], got["K0+a"].r2_total)


def test_grid_of_single_returns_and_out_of_sample(spark, model):
    """R2 of single returns from the moments equals that over the rows; blocks of dates give what one fit gives."""
    m, _, _, f = model
    specs = [ipca.Spec("in", 1), ipca.Spec("out", 1, (), True, 20), ipca.Spec("too many", 3, ("a", "b"))]
    got = {r.label: r for r in ipca.grid(spark, m.moments, {"a": f[:, 0], "b": f[:, 1]}, specs, 1e-6, 300).collect()}
    for label, fit in (("in", m.fit(K=1, minTol=1e-6, maxIters=300)), ("out", m.fit(K=1, OOS=True, OOS_window_specs=20, minTol=1e-6, maxIters=300))):
        assert np.allclose([got[label].assets_total, got[label].assets_pred], m.r2_assets(fit))
        assert np.allclose([got[label].r2_total, got[label].r2_pred], fit.r2_x(m.moments.x))
    assert (got["in"].dates, got["out"].dates) == (60, 40) and got["too many"].r2_total > got["in"].r2_total


def test_save(spark, tmp_path, model):
    fit = model[0].fit(K=1, OOS=True, OOS_window_specs=50)
    ipca.save(spark, fit, str(tmp_path / "fit"))
    back = ipca.load(spark, str(tmp_path / "fit"))
    assert all(np.array_equal(getattr(back, c), getattr(fit, c), equal_nan=True) for c in ipca.ARRAYS)
    assert (back.chars, back.names, back.k, back.first, back.dates[0]) == (fit.chars, fit.names, 1, 50, str(fit.dates[0]))


def test_steps_where_the_moments_are(spark, model):
    m, _, _, f = model
    rows = moment_rows(m.panel, "ret", CHARS).repartition(5)
    none = np.zeros((60, 0))
    start = np.linalg.qr(np.random.RandomState(1).normal(size=(4, 2)))[0]
    want = kernel.loading_step(kernel.factor_step(start, m.moments.x, m.moments.w, none, 2), m.moments.x, m.moments.w, m.moments.n)
    got, second, mean = steps.loading_step(rows, start, 2)
    assert np.allclose(got, want) and second.shape == (2, 2) and mean.shape == (2,)
    by_date = {r.date: r.f for r in steps.factor_rows(rows, start, 2).collect()}
    assert np.allclose([by_date[d] for d in m.moments.dates], kernel.factor_step(start, m.moments.x, m.moments.w, none, 2))
    given = rows.join(spark.createDataFrame([(d, [float(v)]) for d, v in zip(m.moments.dates, f[:, 0])], "date date, g array<double>"), "date")
    both = np.hstack([start[:, :1], np.ones((4, 1))])
    want = kernel.loading_step(kernel.factor_step(both, m.moments.x, m.moments.w, f[:, :1], 1), m.moments.x, m.moments.w, m.moments.n)
    assert np.allclose(steps.loading_step(given, both, 1)[0], want)
    gamma, tol, iters = steps.fit_rows(rows, 4, 2, 1e-7, 60)
    assert tol <= 1e-7 and np.allclose(gamma, m.fit(K=2, minTol=1e-8).gamma, atol=1e-5)
    with pytest.raises(ValueError):
        steps.loading_step(rows.limit(0), start, 2)


def test_loadings_out_of_sample(model):
    m, pdf, *_ = model
    fit = m.fit(K=1, OOS=True, OOS_window_specs=50)
    got = m.betas(fit).toPandas().sort_values(["date", "entity"])
    late = pdf[pd.factorize(pdf.date)[0] >= 50].sort_values(["date", "entity"])
    t = pd.factorize(late.date)[0] + 50
    assert np.allclose(got.beta, np.einsum("il,il->i", late[CHARS].to_numpy(), fit.gamma[t, :, 0])) and len(got) == 10 * 80
    assert set(m.results(fit)) == {"Gamma", "Factors", "Lambda", "xfits"}
    assert m.results(fit, R_fit=True, Beta_fit=True)["Betas"].columns == ["date", "entity", "name", "beta"]


def test_benchmark_of_the_past_ignores_rows_of_the_same_date(spark):
    d = [dt.date(2024, 1, k) for k in (1, 2, 3)]
    rows = [(d[0], 1, 1.0), (d[1], 1, 5.0), (d[1], 1, 9.0), (d[2], 1, 0.0), (d[2], 2, 4.0), (d[2], None, 4.0)]
    got = ipca.asset_benchmark(spark.createDataFrame(rows, "date date, entity int, ret double"), "individual_mean_recursive").collect()
    assert sorted((r.date, r.entity or 0, r.ret, r.bench) for r in got) == [
        (d[0], 1, 1.0, 0.0), (d[1], 1, 5.0, 1.0), (d[1], 1, 9.0, 1.0), (d[2], 0, 4.0, 0.0), (d[2], 1, 0.0, 5.0), (d[2], 2, 4.0, 0.0),
    ]


def test_singular_draws_end(spark, model, monkeypatch):
    """A draw that is singular however often it is drawn counts as failed."""
    m = model[0]
    fit = m.fit(K=1, minTol=1e-6)
    bad = ipca.Moments(m.moments.dates, CHARS, m.moments.n, m.moments.x * np.nan, m.moments.w, m.moments.s)
    draws = ipca.wild_bootstrap(spark, bad, fit, ["row:0"], 3, 1e-5, 5, np.zeros((60, 0)))
    got = ipca.p_values(draws).first()
    assert (got.draws, got.converged, got.pval) == (0, 0, None)


def test_many_estimates_together_equal_single_ones(model):
    m, _, _, f = model
    m = m.moments
    rng = np.random.RandomState(8)
    x = m.x + rng.normal(0, 1e-3, (5, *m.x.shape))
    for k, given in ((1, None), (2, None), (3, None), (1, f[:, :1]), (2, np.ones((60, 1)))):
        for got, v in zip(kernel.estimate_many(x, m.w, m.n, k, given, 1e-7, 300), x):
            want = kernel.estimate(v, m.w, m.n, k, given, 1e-7, 300)
            assert got.iters == want.iters and np.allclose(got.gamma, want.gamma, atol=1e-6) and np.allclose(got.factors, want.factors, atol=1e-6)


def test_dates_with_fewer_entities_than_factors_take_the_shortest_solution():
    rng = np.random.RandomState(0)
    z = [rng.normal(size=(80 if t > 2 else t + 1, 5)) for t in range(60)]
    n, w = np.array([float(len(v)) for v in z]), np.array([v.T @ v / len(v) for v in z])
    true = np.linalg.qr(rng.normal(size=(5, 3)))[0] * [1.5, 1, 0.8]
    x = np.einsum("tlm,mk,tk->tl", w, true, rng.normal(size=(60, 3)) * [3, 2, 1] + 0.3) + rng.normal(0, 0.1, (90, 60, 5))
    x[7] = np.nan  # no estimate, the others are not held up
    none = np.zeros((60, 0))
    for k in (2, 3):
        g = np.linalg.qr(rng.normal(size=(5, k)))[0]
        want = [np.linalg.lstsq(g.T @ w[t] @ g, g.T @ x[0, t], rcond=1e-12)[0] for t in range(60)]
        assert np.allclose(kernel.factor_step(g, x[0], w, none, k), want)
        found = kernel.estimate_many(x, w, n, k, none, 1e-7, 300)
        assert [i for i, e in enumerate(found) if e is None] == [7]
        for got, v in list(zip(found, x))[::6]:
            want = kernel.estimate(v, w, n, k, none, 1e-7, 300)
            assert got.tol <= 1e-7 and got.iters == want.iters and np.abs(got.factors).max() < 100
            assert np.allclose(got.gamma, want.gamma, atol=1e-6) and np.allclose(got.factors, want.factors, atol=1e-6)


def test_singular_equations_of_the_loadings_take_the_shortest_solution():
    """A characteristic that is 0 throughout, and a date whose factor outweighs all others."""
    rng = np.random.RandomState(1)
    z = rng.normal(size=(30, 40, 4))
    z[..., 3] = 0
    w, n = np.einsum("tij,tik->tjk", z, z) / 40, np.full(30, 40.0)
    f = rng.normal(size=(30, 1))
    x = np.einsum("tlm,m,tk->tl", w, [1.0, 0.5, -0.5, 0], f)
    for got in (kernel.estimate(x, w, n, 1, None, 1e-8, 200), *kernel.estimate_many(np.array([x, 2 * x]), w, n, 1, None, 1e-8, 200)):
        assert got.tol <= 1e-8 and np.allclose(np.abs(got.gamma[:, 0]), np.array([1, 0.5, 0.5, 0]) / 1.5**0.5)
    f[4] = 1e10
    a, b = kernel.normal_equations(f, x, w, n)
    want = np.linalg.lstsq(a, b, rcond=1e-15)[0]
    assert np.allclose(kernel.loading_step(f, x, w, n)[:, 0], want) and np.allclose(kernel._loadings(a[None], b[None], np.array([True]))[0], want)


def test_bootstrap_tells_which_draws_converged(spark, model):
    m = model[0]
    fit = m.fit(K=1, minTol=1e-6)
    none = np.zeros((60, 0))
    short, whole = (ipca.wald_beta(spark, m.moments, fit, ["c0"], none, draws=25, max_iters=i).first() for i in (1, 1000))
    assert (short.draws, short.converged) == (25, 0) and whole.draws == 25 and whole.converged > 0


def test_draws_are_those_of_their_seeds_for_every_test(spark, model):
    m = model[0].moments
    fit = model[0].fit(K=1, minTol=1e-6)
    none = np.zeros((60, 0))
    got = {(r.test, r.draw): r for r in ipca.wild_bootstrap(spark, m, fit, ["row:0", "row:2"], 43, 1e-6, 500, none).collect()}
    assert len(got) == 86 and {d for _, d in got} == set(range(43))
    for row, draw in ((0, 0), (0, 21), (2, 42), (2, 3)):
        null = fit.gamma.copy()
        null[row] = 0
        x = ipca.null_draw(m, fit.factors, null, m.x - fit.x_total, np.random.RandomState(draw))
        want = kernel.estimate(x, m.w, m.n, 1, none, 1e-6, 500)
        assert np.isclose(got[f"row:{row}", draw].stat, want.gamma[row] @ want.gamma[row], atol=1e-9) and got[f"row:{row}", draw].converged == (want.tol <= 1e-6)


def test_registered_bootstraps_draw_a_thousand_times_for_every_characteristic(spark, monkeypatch):
    from panelmill.queries import model as q

    seen, plain = [], ipca.wild_bootstrap

    def few(spark, m, fit, tests, draws, min_tol, max_iters, given):
        seen.append((len(tests), draws, max_iters))
        return plain(spark, m, fit, tests, 2, min_tol, 2, given)

    monkeypatch.setattr(ipca, "wild_bootstrap", few)
    path = "/root/testdata/sf0.001"
    rows = q.pvalue_matrix(spark, path).collect()
    assert {r.characteristic for r in rows} == set(q.CHARS) and all(r.converged_k1 is not None and r.converged_k2 is not None for r in rows)
    assert q.wald_beta(spark, path).count() == 8 and q.wald_alpha(spark, path).count() == 1
    assert seen == [(8, 1000, 1000)] * 3 + [(1, 1000, 1000)]

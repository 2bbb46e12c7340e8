"""Cleaning, windows, cross-sections, factors, descriptives, files and the stream."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelmill.operators import characteristics as ch
from panelmill.operators import clean, describe, factors, market
from panelmill.operators import cross_section as cs
from panelmill.operators.order_stats import quantiles
from panelmill.plans import pipeline
from panelmill.sources import files
from panelmill.streaming.bars import daily_bars

DAY = dt.date(2024, 1, 1)


def day(n):
    return DAY + dt.timedelta(days=n)


def prices(spark, n=200, entities=4, seed=0):
    rng = np.random.RandomState(seed)
    rows = []
    for e in range(entities):
        close = np.exp(np.cumsum(rng.normal(0, 0.05, n)))
        for i in range(n):
            o = float(close[i] * math.exp(rng.normal(0, 0.01)))
            hi, lo = max(o, close[i]) * 1.01, min(o, close[i]) * 0.99
            rows.append((f"e{e}", day(i), o, float(hi), float(lo), float(close[i]), float(rng.randint(100, 1000)), float(rng.randint(10**6, 10**7))))
    return spark.createDataFrame(rows, "entity string, date date, open double, high double, low double, close double, volume double, marketcap double")


def one(spark, values, col="ret", entity="a"):
    return spark.createDataFrame([(entity, day(i), v) for i, v in enumerate(values)], f"entity string, date date, {col} double")


def test_clip_and_return_keep_nulls(spark):
    got = clean.clip(one(spark, [None, -2.0, 9.0, 0.1])).orderBy("date").collect()
    assert [r.ret for r in got] == [None, -0.99, 5.0, 0.1]
    got = clean.simple_return(one(spark, [2.0, 3.0, 0.0, 1.0], "close")).orderBy("date").collect()
    assert [r.ret for r in got] == [None, 0.5, -1.0, None]


def test_streak_gaps_and_repeats(spark):
    rows = [("a", day(i)) for i in (0, 1, 1, 2, 5, 6, 7, 8)] + [("b", day(0)), ("c", None)]
    df = spark.createDataFrame(rows, "entity string, date date")
    assert {(r.entity, r.streak) for r in clean.longest_streak(df).collect()} == {("a", 4), ("b", 1)}
    assert {r.entity for r in clean.streak_filter(df, 4).collect()} == {"a"}
    weekly = spark.createDataFrame([("a", day(7 * i)) for i in (0, 1, 2, 4)], "entity string, date date")
    assert clean.longest_streak(weekly, 7).first().streak == 3


def test_filters(spark):
    rows = [("bench", day(0), 10.0), ("a", day(0), 11.0), ("b", day(0), 9.0), ("a", day(1), 99.0), (None, day(0), 1.0), ("n", day(0), None)]
    df = spark.createDataFrame(rows, "entity string, date date, marketcap double")
    assert {(r.entity, r.marketcap) for r in clean.benchmark_filter(df, "bench").collect()} == {("bench", 10.0), ("b", 9.0), ("a", 99.0), (None, 1.0), ("n", None)}
    names = spark.createDataFrame([("a",), ("a",), (None,)], "x string")
    assert {r.entity for r in clean.exclude(df, names).collect()} == {"bench", "b", "n", None}
    assert clean.min_observations(df, 2).count() == 2 and clean.min_cross_section(df, 5).count() == 5
    ids = {r.entity: r.entity_id for r in clean.dense_ids(df).collect()}
    assert ids == {"a": 1, "b": 2, "bench": 3, "n": 4}
    first = clean.keep_first(df, ["entity"], ["date"]).collect()
    assert len(first) == 5 and next(r for r in first if r.entity == "a").marketcap == 11.0


def test_rate_is_carried_and_leading_dates_stay_null(spark):
    df = spark.createDataFrame([("a", day(i), 0.1, 5.0) for i in range(4)], "entity string, date date, ret double, marketcap double")
    rates = spark.createDataFrame([(day(1), 2.52), (day(2), None)], "date date, rate_pct double")
    got = [r.rf for r in market.market_series(df, rates).orderBy("date").collect()]
    want = 1.0252 ** (1 / 252) - 1
    assert got[0] is None and all(math.isclose(g, want) for g in got[1:])


def test_complete_windows_and_null_rules(spark):
    df = one(spark, [None, *[0.01 * i for i in range(10)]]).withColumns({c: F.lit(1.0) for c in ("open", "high", "low", "close", "volume", "marketcap")})
    got = ch.distribution(ch.momentum(df)).orderBy("date").collect()
    assert [r.r7_0 is None for r in got] == [True] * 6 + [False] * 5  # nulls are skipped, rows count
    assert [r.maxret_7d is None for r in got] == [True] * 7 + [False] * 4  # strict
    assert math.isclose(got[6].r7_0, np.prod([1 + 0.01 * i for i in range(6)]) - 1)


def test_constant_window_gives_null(spark):
    df = one(spark, [0.0] * 40).withColumns({"ret_excess": F.lit(0.0), "cmkt": F.lit(0.0), **{c: F.lit(1.0) for c in ("open", "high", "low", "close", "volume", "marketcap")}})
    last = ch.build(df, ["capm", "delay", "liquidity", "distribution", "bid_ask"]).orderBy(F.desc("date")).first()
    assert last.beta is None and last.delay is None and last.skew_7d is None and last.sat is None and last.bidask is None


def edge_numpy(o, h, l, c):
    o, h, l, c = map(np.log, (o, h, l, c))
    m = (h + l) / 2
    o1, h1, l1, c1, m1 = o[1:], h[:-1], l[:-1], c[:-1], m[:-1]
    o, h, l, m = o1, h[1:], l[1:], m[1:]
    tau = ((h != l) | (l != c1)).astype(float)
    po = np.mean(tau * (o != h)) + np.mean(tau * (o != l))
    pc = np.mean(tau * (c1 != h1)) + np.mean(tau * (c1 != l1))
    r1, r2, r3, r4, r5 = m - o, o - m1, m - c1, c1 - m1, o - c1
    d1, d3, d5 = (r - tau * r.mean() / tau.mean() for r in (r1, r3, r5))
    x1 = -4 / po * d1 * r2 - 4 / pc * d3 * r4
    x2 = -4 / po * d1 * r5 - 4 / pc * d5 * r4
    e1, e2, v1, v2 = x1.mean(), x2.mean(), x1.var(), x2.var()
    return math.sqrt(abs((v2 * e1 + v1 * e2) / (v1 + v2)))


def test_spread_against_numpy(spark):
    df = prices(spark, 60, 2)
    got = ch.bid_ask(df).toPandas().sort_values(["entity", "date"])
    for _, g in got.groupby("entity"):
        g = g.reset_index(drop=True)
        assert g.bidask[:29].isna().all()
        for i in range(29, 60):
            w = g.loc[i - 29 : i, ["open", "high", "low", "close"]].to_numpy().T
            assert math.isclose(g.bidask[i], edge_numpy(*w), rel_tol=1e-9)


def test_delay_against_least_squares(spark):
    rng = np.random.RandomState(1)
    x = rng.normal(0, 0.05, 50)
    y = 0.5 * x + 0.3 * np.roll(x, 1) + rng.normal(0, 0.02, 50)
    rows = [("a", day(i), float(y[i]) if i != 20 else None, float(x[i])) for i in range(50)]
    got = ch.delay(spark.createDataFrame(rows, "entity string, date date, ret_excess double, cmkt double")).orderBy("date").collect()

    def r2(y, *xs):
        z = np.column_stack([np.ones(len(y)), *xs])
        e = y - z @ np.linalg.lstsq(z, y, rcond=None)[0]
        return 1 - e @ e / ((y - y.mean()) @ (y - y.mean()))

    for i in range(29, 50):
        at = np.array([k for k in range(i - 27, i + 1) if k != 20])
        assert math.isclose(got[i].delay, r2(y[at], x[at], x[at - 1], x[at - 2]) - r2(y[at], x[at]), rel_tol=1e-6, abs_tol=1e-9)


def test_rank_scale_edges(spark):
    rows = [("a", day(0), 1.0), ("b", day(1), 3.0), ("c", day(1), 3.0), ("d", day(2), 1.0), ("e", day(2), 2.0), ("f", day(2), 2.0), ("g", day(2), None), ("h", day(2), float("nan"))]
    got = {r.entity: r.x for r in cs.rank_scale(spark.createDataFrame(rows, "entity string, date date, x double"), ["x"]).collect()}
    assert got == {"a": None, "b": 0.5, "c": 0.5, "d": -0.5, "e": 0.5, "f": 0.5, "g": None, "h": None}


def test_ranks_against_pandas(spark):
    rng = np.random.RandomState(2)
    pdf = pd.DataFrame({"date": [day(int(i)) for i in rng.randint(0, 5, 300)], "entity": [f"e{i}" for i in range(300)], "x": rng.randint(0, 20, 300).astype(float)})
    got = cs.rank_scale(spark.createDataFrame(pdf), ["x"]).toPandas().set_index("entity").x
    rank = pdf.groupby("date").x.rank()
    want = (rank - 1) / (rank.groupby(pdf.date).transform("max") - 1) - 0.5
    assert np.allclose(got[pdf.entity].to_numpy(), want)


def test_buckets_of_uneven_sizes_and_ties(spark):
    rows = [(f"e{i:02}", day(0), 1.0 if i < 4 else float(i)) for i in range(12)] + [("n", day(0), None)]
    got = {r.entity: r.bucket for r in cs.buckets(spark.createDataFrame(rows, "entity string, date date, x double"), "x", 5).collect()}
    assert "n" not in got and [sum(b == q for b in got.values()) for q in range(1, 6)] == [3, 3, 2, 2, 2]
    assert got["e02"] == 1 and got["e03"] == 2


def test_factor_needs_both_ends(spark):
    rows = [(f"e{i}", day(t), float(10 + i), 0.01 * i) for t in range(2) for i in range(10 if t else 3)]
    df = spark.createDataFrame(rows, "entity string, date date, marketcap double, ret double")
    got = {r.date: r.smb for r in factors.size_factor(df).collect()}
    assert got[day(0)] is None
    low = (10 * 0.0 + 11 * 0.01) / 21
    high = (18 * 0.08 + 19 * 0.09) / 37
    assert math.isclose(got[day(1)], low - high)


def test_correlations_with_a_constant(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.5, 5.0), (3.0, 5.0, 5.0), (None, 1.0, 5.0)], "a double, b double, c double")
    got = {(r.a, r.b): r.r for r in cs.correlations(df, ["a", "b", "c"]).collect()}
    assert math.isclose(got["a", "b"], np.corrcoef([1, 2, 3], [2, 4.5, 5])[0, 1]) and got["b", "a"] == got["a", "b"] and got["a", "c"] is None


def test_quantiles_and_numbers(spark):
    rng = np.random.RandomState(3)
    pdf = pd.DataFrame({"g": ["hot"] * 900 + ["b"] * 3, "x": np.round(rng.normal(0, 1, 903), 1), "i": range(903)})
    df = spark.createDataFrame(pdf)
    got = {(r.g, r.p): r.value for r in quantiles(df, ["g"], "x", [0.0, 0.1, 0.5, 1.0]).collect()}
    assert len(got) == 8 and all(math.isclose(v, np.quantile(pdf.x[pdf.g == g], p), abs_tol=1e-12) for (g, p), v in got.items())
    places = describe.numbered(df, ["x", "i"], "n").toPandas().sort_values(["x", "i"])
    assert places.n.tolist() == list(range(1, 904))
    assert describe.column_summary(df.limit(0), "x").first().n == 0


def test_loader_and_sample(spark, tmp_path):
    df = prices(spark, 40, 5).withColumns({"ret": F.lit(0.1), "ret_excess": F.rand(1), "mcap": F.lit(1.0)})
    out = pipeline.load_panel(df.union(df), cache=str(tmp_path / "panel"))
    assert out.columns[:2] == ["date", "entity"] and "mcap" not in out.columns and "close" not in out.columns and "r2_1" in out.columns
    assert out.count() == 5 * 39 and {r.entity for r in out.select("entity").distinct().collect()} == {1, 2, 3, 4, 5}
    again = pipeline.load_panel(df.limit(0), cache=str(tmp_path / "panel"))
    assert again.count() == 5 * 39
    sample = pipeline.estimation_sample(out, "2024-01-05", "2024-01-20", 10, 5)
    assert sample.count() == 16 * 5 and abs(sample.agg(F.max("volume")).first()[0]) <= 0.5


def test_files(spark, tmp_path):
    (tmp_path / "bad.json").write_text('{"data": [{"symbol": "A", "name": "Aa", "shortname": "aa", "trading_since": 86400}, {"symbol": "A", "name": "Aa", "shortname": "aa", "trading_since": 86400}]}\n{"data": [oops\n')
    got = files.entity_list(spark, str(tmp_path / "bad.json")).collect()
    assert [(r.symbol, r.trading_since) for r in got] == [("A", dt.date(1970, 1, 2))]
    (tmp_path / "names.txt").write_text("a\n b \n\na\n")
    assert sorted(r.entity for r in files.names(spark, str(tmp_path / "names.txt")).collect()) == ["a", "b"]
    for k in (2, 13):
        (tmp_path / f"{k}_factors_pvals_20_41.csv").write_text(f"characteristic,pval_beta\nbeta,0.0{k}\n")
    got = files.keyed_csv(spark, str(tmp_path / "*_factors_pvals_*.csv"), "characteristic string, pval_beta double").collect()
    assert {(r.k, r.pval_beta) for r in got} == {(2, 0.02), (13, 0.013)}
    (tmp_path / "coin_a.json").write_text('{"data": [{"time_start": "2024-01-01 00:00:00", "price_open_usd": 1, "price_close_usd": 2, "price_high_usd": 3, "price_low_usd": 1, "volume_usd": 5, "market_cap_usd": 9}, {"time_start": "2024-01-02", "price_close_usd": 0, "volume_usd": 5, "market_cap_usd": 9}]}\n')
    got = files.histories(spark, str(tmp_path / "coin_a.json")).collect()
    assert [(r.entity, r.date, r.close) for r in got] == [("coin_a", day(0), 2.0)]
    text = files.latex(spark.createDataFrame([("a_b", 1.5, 1000)], "n string, x double, k long"))
    assert r"a\_b & 1.5000 & 1,000 \\" in text
    with pytest.raises(ValueError):
        files.latex(spark.range(5), most=4)


def test_bars_on_a_stream_and_on_a_table(spark, tmp_path):
    rows = [("a", dt.datetime(2024, 1, d, h), float(d * h)) for d in range(1, 6) for h in (1, 5, 9)] + [("a", None, 1.0), ("a", dt.datetime(2024, 1, 1, 2), None)]
    df = spark.createDataFrame(rows, "entity string, snapped_at timestamp, marketcap double")
    df.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = daily_bars(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), late="1 day")
    run = stream.writeStream.format("memory").queryName("bars").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    streamed = {(r.start, r.open, r.high, r.low, r.close, r.readings) for r in spark.table("bars").collect()}
    batch = {(r.start, r.open, r.high, r.low, r.close, r.readings) for r in daily_bars(df).collect()}
    assert len(batch) == 5 and (dt.datetime(2024, 1, 2), 2.0, 18.0, 2.0, 18.0, 3) in batch
    assert streamed and streamed <= batch


def test_factors_and_cross_sections_of_all_dates(spark, tmp_path):
    from panelmill.queries.cross_section import factor_history
    from panelmill.queries.panel import min_cross_section_history

    rng = np.random.RandomState(2)
    days = [dt.date(2018, 4, 10) + dt.timedelta(days=i) for i in range(80)]
    rows, shift = [], {f"e{e:02}": np.exp(np.cumsum(rng.normal(0, 0.05, len(days)))) for e in range(40)}
    for e, close in shift.items():
        for d, c in zip(days, close):
            o = float(c * math.exp(rng.normal(0, 0.01)))
            rows.append((len(rows), d, e, o, max(o, c) * 1.01, min(o, c) * 0.99, float(c), float(rng.randint(100, 1000)), float(rng.randint(10**6, 10**7)), None, "meme", dt.datetime.combine(d, dt.time())))
    kinds = "row_id long, date date, entity string, open double, high double, low double, close double, volume double, marketcap double, ret double, sector string, read_at timestamp"
    spark.createDataFrame([tuple(float(v) if isinstance(v, np.floating) else v for v in r) for r in rows], kinds).write.parquet(f"{tmp_path}/panel_clean.parquet")
    spark.createDataFrame([(d, 4.0) for d in days], "date date, rate_pct double").write.parquet(f"{tmp_path}/risk_free.parquet")
    floor = dt.date(2018, 6, 1)
    assert sorted(r.date for r in factor_history(spark, str(tmp_path)).collect()) == [d for d in days if d >= floor]
    few = min_cross_section_history(spark, str(tmp_path))
    assert few.count() == 0  # 28 days from the floor on are too few for an entity
    spark.createDataFrame([tuple(float(v) if isinstance(v, np.floating) else v for v in (*r[:1], r[1] + dt.timedelta(days=40), *r[2:])) for r in rows], kinds).write.parquet(f"{tmp_path}/later/panel_clean.parquet")
    late = min_cross_section_history(spark, f"{tmp_path}/later").select("date").distinct().collect()
    assert sorted(r.date for r in late) == [d + dt.timedelta(days=40) for d in days if d + dt.timedelta(days=40) >= floor]


def test_broadcasts_are_bounded_by_bytes(spark):
    from panelmill.session import attach, byte_size

    small = spark.createDataFrame([(None, "x" * 100, [1.0, 2.0]), (1, "é", None)], "k int, t string, a array<double>")
    assert byte_size(small) == 2 * (16 + 8) + 100 + 2 + len("[1.0,2.0]") and byte_size(small.limit(0)) == 0
    big = spark.createDataFrame([(None, 1), (1, 2), (2, 3)], "k int, n int")
    rows = lambda most: sorted((r.n, len(r.t or "")) for r in attach(big, small, ["k"], most=most).collect())
    assert rows(1 << 20) == rows(0) == [(1, 100), (2, 1), (3, 0)]
    plan = lambda most: attach(big, small, ["k"], most=most)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan(1 << 20) and "SortMergeJoin" in plan(0)


def test_a_cluster_needs_a_shared_folder():
    from panelmill.session import ensure_checkpoint_dir

    class Context:
        master, at = "spark://somewhere:7077", None

        def getCheckpointDir(self):
            return self.at

        def setCheckpointDir(self, at):
            self.at = at

    class Session:
        def __init__(self, folder):
            self.sparkContext = Context()
            self.conf = {"spark.checkpoint.dir": folder} if folder else {}

    with pytest.raises(ValueError):
        ensure_checkpoint_dir(Session(None))
    shared = Session("hdfs:///shared")
    ensure_checkpoint_dir(shared)
    assert shared.sparkContext.at == "hdfs:///shared"


def test_p_values_of_correlations(spark):
    from panelmill.operators.cross_section import correlation_p

    rows = [(0.0, 100), (0.2, 100), (-0.3, 402), (1.0, 10), (None, 10), (0.5, 2)]
    got = [r.p for r in spark.createDataFrame(rows, "r double, n long").select(correlation_p(F.col("r"), F.col("n")).alias("p")).collect()]
    for (r, n), p in zip(rows[:3], got):
        assert abs(p - math.erfc(abs(r) * math.sqrt((n - 2) / (1 - r * r)) / math.sqrt(2))) < 3e-4
    assert got[3:] == [0.0, None, None]


def test_weeks(spark):
    from panelmill.plans.pipeline import load_panel, weekly

    rows = [("a", dt.date(2024, 1, d), float(d)) for d in (1, 3, 7, 8, 20)] + [(None, dt.date(2024, 1, 2), None), ("b", None, 1.0)]
    got = weekly(spark.createDataFrame(rows, "entity string, date date, x double")).collect()
    assert sorted(((r.entity, r.date, r.x) for r in got), key=str) == sorted(
        [("a", dt.date(2024, 1, 1), 7.0), ("a", dt.date(2024, 1, 8), 8.0), ("a", dt.date(2024, 1, 15), 20.0), (None, dt.date(2024, 1, 1), None), ("b", None, 1.0)], key=str
    )
    df = spark.createDataFrame([("a", dt.date(2024, 1, 1 + 3 * i), 0.1 * i, 1.0 * i) for i in range(8)], "entity string, date date, ret_excess double, x double")
    assert load_panel(df, freq="weekly").count() == 3 and load_panel(df).count() == 7
    with pytest.raises(ValueError):
        load_panel(df, freq="hourly")

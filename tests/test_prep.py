"""The data-preparation operators against brute force, and their edge cases."""

import datetime as dt
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelmill.operators.asof import known_at, known_before
from panelmill.operators.impute import Numeric, impute
from panelmill.operators.regular import regular_grid
from panelmill.operators.spikes import Field, bands, chart, rolling_median, spikes, stuck_runs
from panelmill.operators.trailing import binary_parts, trailing_totals
from panelmill.operators.versions import latest_version

DAY = dt.date(2024, 1, 1)
NAN = float("nan")


def day(n):
    return DAY + dt.timedelta(days=n)


def at(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=n)


GRID = "entity string, date date, close double, v int, _s string"


def test_grid_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(e, day(d), float(rng.randint(1, 99)), rng.randint(0, 3), "x") for e in ("a", "b", None) for d in rng.sample(range(400), 40) for _ in range(2)]
    df = spark.createDataFrame(rows, GRID)
    for fill in ("last", "linear", "none"):
        got = {(r.entity, r.date): r for r in regular_grid(df, "entity", "date", "close", ["v", "close"], fill=fill, shard_steps=16).collect()}
        n = 0
        for e in ("a", "b", None):
            best = {}
            for r in rows:
                if r[0] == e:
                    best[r[1]] = max(best.get(r[1], (-1, 0)), (r[3], r[2]))
            days = sorted(best)
            for k in range((days[-1] - days[0]).days + 1):
                d = days[0] + dt.timedelta(days=k)
                n += 1
                r = got[e, d]
                before = max(x for x in days if x <= d)
                assert r.observed == (d in best) and r.read_date == before
                if d in best or fill == "last":
                    assert r.close == best[before][1]
                elif fill == "none":
                    assert r.close is None
                else:
                    after = min(x for x in days if x > d)
                    share = (d - before).days / (after - before).days
                    assert math.isclose(r.close, best[before][1] + (best[after][1] - best[before][1]) * share)
        assert n == len(got)


def test_grid_edges(spark):
    rows = [("a", day(0), 1.0, 0, "x"), ("a", day(200), 2.0, 0, "x"), ("a", None, 3.0, 0, "x"), ("b", day(0), None, 0, "x"), ("c", day(0), NAN, 0, "x"), ("d", day(5), 7.0, None, "x")]
    got = regular_grid(spark.createDataFrame(rows, GRID), "entity", "date", "close", ["v"], shard_steps=8).collect()
    assert {r.entity for r in got} == {"a", "d"}
    assert sum(r.entity == "a" for r in got) == 201 and sum(r.observed for r in got) == 3
    assert regular_grid(spark.createDataFrame([], GRID), "entity", "date", "close", ["v"]).count() == 0
    with pytest.raises(ValueError):
        regular_grid(spark.createDataFrame([], GRID), "entity", "date", "close", ["v"], fill="?")


def test_grid_of_weeks(spark):
    rows = [("a", day(0), 1.0, 0, "x"), ("a", day(30), 2.0, 0, "x")]
    got = regular_grid(spark.createDataFrame(rows, GRID), "entity", "date", "close", ["v"], step_days=7).collect()
    dates = sorted(r.date for r in got)
    assert all((b - a).days == 7 for a, b in zip(dates, dates[1:])) and 0 <= (day(0) - dates[0]).days < 7


EVENTS, ATTRS = "id long, entity string, at timestamp, value double", "id long, entity string, since timestamp, rank int, value double"


def known(spark, events, attrs):
    e, a = spark.createDataFrame(events, EVENTS), spark.createDataFrame(attrs, ATTRS)
    out = known_at(e, a, "entity", F.col("at"), F.col("since"), ["rank", "id"], ["id", "value"], ["id", "value"])
    return [(r.id, r.known.id if r.known else None) for r in out.collect()]


def test_known_against_brute_force(spark):
    rng = random.Random(2)
    names = ["hot"] * 8 + ["b", "c", None]
    attrs = [(i, rng.choice(names), at(rng.randint(0, 500)), rng.randint(0, 50), 1.0) for i in range(1500)]
    events = [(i, rng.choice(names), at(rng.randint(-20, 500)), 2.0) for i in range(1500)]
    want = []
    for i, e, t, _ in events:
        have = [(a[3], a[0]) for a in attrs if a[1] == e and a[2] <= t]
        want.append((i, max(have)[1] if have else None))
    assert sorted(known(spark, events, attrs), key=str) == sorted(want, key=str)


def test_known_edges(spark):
    attrs = [(1, "a", at(5), 1, None), (2, "a", at(5), 1, 3.0), (3, "a", None, 9, 1.0), (4, None, at(1), 1, 1.0)]
    events = [(1, "a", at(5), None), (1, "a", at(5), None), (2, "a", at(4), 1.0), (3, "a", None, 1.0), (4, None, at(1), 1.0), (5, "z", at(9), 1.0)]
    assert sorted(known(spark, events, attrs), key=str) == sorted([(1, 2), (1, 2), (2, None), (3, None), (4, 4), (5, None)], key=str)
    assert known(spark, events[:1], []) == [(1, None)]
    assert known(spark, [], attrs) == []


def test_known_before_against_brute_force(spark):
    """Events at, before and after their own day; rows known late, revised, without a time or a day."""
    rng = random.Random(9)
    names = ["hot"] * 6 + ["b", None]
    rows = []
    for i in range(1200):
        d = rng.randint(-30, 400)
        known = None if rng.random() < 0.03 else at(24 * d + rng.choice([5, 30, 24 * 40, 24 * 300, -50]))
        rows.append((i, rng.choice(names), None if rng.random() < 0.03 else day(d), known))
    events = []
    for i in range(900):
        d = rng.randint(-20, 400)
        time = None if rng.random() < 0.03 else at(24 * d + rng.choice([0, 7, 7, 24, 100, 24 * 90, -10, -24 * 50]))
        events.append((i % 850, rng.choice(names), None if rng.random() < 0.03 else day(d), time, "x"))
    e = spark.createDataFrame(events, "id long, entity string, date date, as_of timestamp, known string")
    a = spark.createDataFrame(rows, "id long, entity string, date date, known_at timestamp")

    def run(e, a):
        out = known_before(e, a, "entity", F.col("as_of"), F.col("known_at"), F.col("date"), F.col("date"), ["date", "known_at", "id"], ["id", "date"], ["id", "date"])
        return sorted(((r.id, r.date, r.known and r.known.id) for r in out.collect()), key=str)

    want = []
    for i, n, d, t, _ in events:
        have = [(r[2], r[3], r[0]) for r in rows if r[1] == n and None not in (d, t, r[2], r[3]) and r[2] < d and r[3] <= t]
        want.append((i, d, max(have)[2] if have else None))
    assert run(e, a) == sorted(want, key=str)
    on_day = e.filter("date(as_of) = date")
    assert run(on_day, a) == sorted((w for w, v in zip(want, events) if v[2] and v[3] and v[3].date() == v[2]), key=str)
    assert run(e.limit(0), a) == [] and all(k is None for *_, k in run(e, a.limit(0)))


def test_binary_parts():
    for n in range(1, 70):
        parts = binary_parts(n)
        covered = sorted(x for shift, size in parts for x in range(shift, shift + size))
        assert covered == list(range(n)) and all(size & (size - 1) == 0 for _, size in parts)


TRAIL = "entity string, date date, x double, y double, v int, active string"


def test_trailing_against_brute_force(spark):
    rng = random.Random(3)
    value = lambda: rng.choice([None, NAN, float(rng.randint(-9, 9))])
    rows = [(e, day(d), value(), value(), v, "q") for e in ("a", None) for d in rng.sample(range(150), 50) for v in range(2)] + [("a", None, 1.0, 1.0, 0, "q")]
    got = {(r.entity, r.date): r for r in trailing_totals(spark.createDataFrame(rows, TRAIL), "entity", "date", ["x", "y"], ["v"], (1, 7, 30)).collect()}
    for e in ("a", None):
        last = {}
        for r in rows:
            if r[0] == e and r[1]:
                last[r[1]] = r
        first = min(last)
        span = (max(last) - first).days + 1
        assert span == sum(k[0] == e for k in got)
        for k in range(span):
            d = first + dt.timedelta(days=k)
            for w in (1, 7, 30):
                for j, m in ((2, "x"), (3, "y")):
                    vals = [last[d - dt.timedelta(days=b)][j] for b in range(w) if d - dt.timedelta(days=b) in last]
                    want = sum(v for v in vals if v is not None and v == v)
                    assert math.isclose(got[e, d][f"{m}_sum_{w}"], want, abs_tol=1e-9)
                    assert math.isclose(got[e, d][f"{m}_avg_{w}"], want / w, abs_tol=1e-9)
            assert got[e, d].age == k and got[e, d].active == (d in last)
    assert trailing_totals(spark.createDataFrame([], TRAIL), "entity", "date", ["x"], ["v"]).count() == 0


FIELDS = {"cap": Field(0.0, False, True, True), "ret": Field(-1.0, True, False, False)}
READ = "field string, entity string, t timestamp, value double, id long, _f string"


def brute_spikes(rows):
    out = set()
    for f, e in {(r[0], r[1]) for r in rows}:
        own = [r for r in rows if r[0] == f and r[1] == e and r[3] is not None]
        rule = FIELDS[f]
        bad = [r for r in own if not math.isfinite(r[3]) or (r[3] < rule.least if rule.least_possible else r[3] <= rule.least)]
        out |= {(f, r[4]) for r in bad}
        good = {}
        for r in own:
            if r not in bad and r[2] is not None:
                good[r[2]] = max(good.get(r[2], -math.inf), r[3])
        if not good:
            continue
        times = sorted(good)
        raw = np.array([good[t] for t in times])
        x = np.log(raw) if rule.log else raw
        level = np.array([np.median(x[max(0, i - 15) : i + 16]) for i in range(len(x))]) if rule.local else np.median(x)
        far = np.abs(x - level)
        hit = far > 8 * np.median(far)
        begin = 0
        for i in range(1, len(x) + 1):
            if i == len(x) or raw[i] != raw[begin]:
                if i - begin >= 5:
                    hit[begin + 1 : i] = True
                begin = i
        cases = {t for t, h in zip(times, hit) if h}
        out |= {(f, r[4]) for r in own if r not in bad and r[2] in cases}
    return out


def test_spikes_against_brute_force(spark):
    rng = np.random.RandomState(4)
    rows, i = [], 0
    for e, n in (("hot", 9000), ("b", 40), ("c", 3), (None, 200)):
        walk = np.cumsum(rng.normal(0, 0.01, n)) + 5
        walk[n // 2 :] += 1.0  # a lasting change
        ret = rng.normal(0, 0.02, n)
        for k in range(n):
            v, r = math.exp(walk[k]), float(ret[k])
            if rng.rand() < 0.004:
                v *= 50
            if rng.rand() < 0.004:
                r += 3
            if rng.rand() < 0.002:
                v, r = 0.0, NAN
            if k % 500 in range(100, 107) and n > 400:
                v = 123.0
            if k % 97 == 0:
                v = None
            for f, x in (("cap", v), ("ret", r)):
                rows.append((f, e, at(k), x, i, "q"))
                i += 1
                if k % 50 == 7:
                    rows.append((f, e, at(k), x, i, "q"))
                    i += 1
    rows += [("cap", "b", None, 1e9, i, "q"), ("cap", "b", None, -1.0, i + 2, "q"), ("other", "b", at(0), -5.0, i + 1, "q")]
    got = spikes(spark.createDataFrame(rows, READ), "field", "entity", "t", "value", "id", FIELDS).collect()
    want = brute_spikes([r for r in rows if r[0] in FIELDS])
    assert {(r.field, r.id) for r in got} == want and len(got) == len(want)
    assert {r.kind for r in got} == {"impossible", "stuck", "spike"}
    assert spikes(spark.createDataFrame([], READ), "field", "entity", "t", "value", "id", FIELDS).count() == 0


def test_spikes_in_long_runs_and_turbulent_stretches(spark):
    rng = np.random.RandomState(1)
    rows = []
    for e in ["calm", *range(9, 16), 30]:
        cap, ret = np.cumsum(rng.normal(0, 0.01, 600)) + 5, rng.normal(0, 0.02, 600)
        if e == "calm":  # then not: a stretch in which the distances are ten times as large
            cap[300:360] += rng.normal(0, 0.1, 60)
            ret[300:400] = rng.normal(0, 0.15, 100)
        else:
            cap[300 : 300 + e] += 2
            ret[300 : 300 + e] += 3
        rows += [(f, str(e), at(k), float(x), 2 * (len(rows) + k) + (f == "ret"), "q") for f, v in (("cap", np.exp(cap)), ("ret", ret)) for k, x in enumerate(v)]
    got = {(r.field, r.id) for r in spikes(spark.createDataFrame(rows, READ), "field", "entity", "t", "value", "id", FIELDS).collect()}
    assert got == brute_spikes(rows)
    faulty = {(r[0], r[4]) for r in rows if r[1] != "calm" and (r[0] == "ret" or int(r[1]) <= 15) and at(300) <= r[2] < at(300 + int(r[1]))}
    assert faulty <= got


def test_chart_parts():
    x = np.array([1.0, 1, 1, 1, 1, 2, 3, 3])
    assert stuck_runs(x, 5).tolist() == [False, True, True, True, True, False, False, False]
    assert rolling_median(x, 2).tolist() == [np.median(x[max(0, i - 2) : i + 3]) for i in range(8)]
    rng = np.random.RandomState(0)
    series = rng.normal(0, 1, 500)
    series[250] = 30.0
    series[300:] += 15.0
    flags = chart(series.tolist())
    assert flags[250] and sum(flags[400:]) < 40  # the chart has moved to the new level
    assert chart([]) == [] and chart([1.0, 1.0]) == [False, False]


def test_scan_is_the_exact_rule_and_draws_no_chart(monkeypatch):
    from panelmill.operators import spikes as module

    def unused(*args, **kwargs):
        raise AssertionError("a chart has no effect on the result")

    monkeypatch.setattr(module, "bands", unused)
    x = np.random.RandomState(5).normal(0, 1, 300)
    x[100:106] = 0.25
    table = pa.table({"_f": pa.array([0] * 300 + [1] * 300, pa.int8()), "_s": ["a"] * 600, "_t": list(range(300)) * 2, "_k": [*range(599), None], "_x": [*x, *x], "_c": [0] * 600, "_i": list(range(300)) * 2})
    got = pa.Table.from_batches(module._scan_chunks(iter(table.to_batches()), frozenset([0]))).to_pydict()
    want = [abs(x[i] - np.median(x[max(0, i - 15) : i + 16])) for i in range(300)]
    assert list(got) == ["_f", "_s", "_t", "_k", "_d", "stuck"] and np.allclose(got["_d"], [*want, *x])
    assert [i for i, v in enumerate(got["stuck"]) if v] == [*range(101, 106), *range(401, 406)] and [i for i, t in enumerate(got["_t"]) if t is not None] == [599]


def test_no_spike_is_cleared_by_the_chart():
    """Contamination, random walks, bursts of either sign, changes of level at any place, long runs: what is beyond the limit is
    suspected or not cleared, and of calm readings nearly all are cleared."""
    rng = np.random.RandomState(3)
    cases = calm = cleared_calm = 0
    for trial in range(120):
        n = rng.randint(40, 1500)
        x = rng.normal(0, 1, n) * rng.choice([0.01, 1.0]) + np.cumsum(rng.normal(0, rng.choice([0, 0.02]), n))
        quiet = trial % 6 == 0
        if not quiet:
            hit = rng.rand(n) < rng.uniform(0.01, 0.15)
            x[hit] += rng.choice([-1, 1], hit.sum()) * rng.uniform(5, 60, hit.sum())
            begin, length = rng.randint(0, n), rng.randint(1, 40)
            x[begin : begin + length] += 20.0 * (-1.0) ** np.arange(len(x[begin : begin + length])) if trial % 2 else 20.0
            x[rng.randint(0, n) :] += rng.choice([0, 8])
        centre, band = map(np.array, bands(x.tolist()))
        for level in (rolling_median(x, 15), np.full(n, np.median(x))):
            away = np.abs(x - level)
            limit = 8 * np.median(away)
            cleared = (np.abs(x - centre) <= band) & (np.abs(centre - level) + band <= limit)
            assert not (cleared & (away > limit)).any()
            cases += (away > limit).sum()
            if quiet and level[0] != level[-1]:
                calm, cleared_calm = calm + n, cleared_calm + cleared.sum()
    assert cases > 5000 and cleared_calm > 0.8 * calm


TABLE = "id long, entity string, date date, volume double, sector string, cap double, volume_filled string, _y_volume string"


def test_impute_accuracy_and_masks(spark):
    rng = np.random.RandomState(5)
    rows, truth = [], {}
    level = {f"e{i}": rng.normal(10, 2) for i in range(30)}
    kind = {e: "xyz"[i % 3] for i, e in enumerate(level)}
    for i in range(3000):
        e = "e0" if i % 3 == 0 else f"e{rng.randint(30)}"
        cap = rng.normal(level[e], 0.5)
        v = math.exp(0.8 * cap + {"x": 0, "y": 1, "z": 2}[kind[e]] + rng.normal(0, 0.1))
        truth[i] = (math.log(v), kind[e])
        hide_v, hide_k = rng.rand() < 0.1, rng.rand() < 0.1
        rows.append((i, e, day(int(rng.randint(50))), [None, NAN, -1.0, 0.0, math.inf][i % 5] if hide_v else v, [None, "?", ""][i % 3] if hide_k else kind[e], math.exp(cap), "old", "k"))
    df = spark.createDataFrame(rows, TABLE)
    args = ("id", "entity", "date", {"volume": Numeric(True)}, {"sector": ["x", "y", "z"]}, {"cap": Numeric(True)})
    got = impute(df, *args).collect()
    assert len(got) == 3000 and got[0]["_y_volume"] == "k"
    missing_v = [r for r in got if r.volume_was_missing]
    missing_k = [r for r in got if r.sector_was_missing]
    assert {r.id for r in missing_v} == {r[0] for r in rows if r[3] is None or not (math.isfinite(r[3]) and r[3] > 0)}
    assert {r.id for r in missing_k} == {r[0] for r in rows if r[4] not in ("x", "y", "z")}
    error = np.array([math.log(r.volume_filled) - truth[r.id][0] for r in missing_v])
    assert abs(error.mean()) < 0.05 and 0.1 < error.std() < 0.25  # a draw has the residual's spread on top of it
    assert np.mean([r.sector_filled == truth[r.id][1] for r in missing_k]) > 0.97
    assert all(r.volume_filled == r.volume for r in got if not r.volume_was_missing)
    again = {r.id: (r.volume_filled, r.sector_filled) for r in impute(df.repartition(5), *args).collect()}
    same = [again[r.id][1] == r.sector_filled and math.isclose(again[r.id][0], r.volume_filled, rel_tol=1e-6) for r in got]
    assert all(same)


def test_impute_edges(spark):
    args = ("id", "entity", "date", {"volume": Numeric(True)}, {"sector": None}, {"cap": Numeric(True)})
    assert impute(spark.createDataFrame([], TABLE), *args).count() == 0
    rows = [(1, None, None, None, None, None, "", ""), (1, None, None, None, None, 3.0, "", "")]
    got = impute(spark.createDataFrame(rows, TABLE), *args).collect()
    assert all(r.volume_filled is None and r.sector_filled is None and r.volume_was_missing and r.sector_was_missing for r in got)
    got = impute(spark.createDataFrame([*rows, (2, "a", day(0), 5.0, "s", 1.0, "", "")], TABLE), *args).collect()
    assert [r.sector_filled for r in got] == ["s"] * 3 and all(r.volume_filled > 0 for r in got)


def test_imputed_levels_of_sparse_entities(spark):
    """Entities differ much and their readings little: one other reading says nearly all, none leaves the overall level."""
    rng = np.random.RandomState(6)
    rows, level, i = [], {}, 0
    for k in range(120):
        e, size = f"e{k}", [0, 1, 3, 60][k % 4]
        level[e] = rng.normal(10, 2)
        for j in range(size + 4):
            v = math.exp(level[e] + rng.normal(0, 0.2))
            rows.append((i, e, day(int(rng.randint(50))), None if j >= size else v, "x", float(rng.rand() + 1), "", ""))
            i += 1
    got = impute(spark.createDataFrame(rows, TABLE), "id", "entity", "date", {"volume": Numeric(True)}, {"sector": ["x"]}, {"cap": Numeric(True)}).collect()
    off = {n: [] for n in (0, 1, 3, 60)}
    for r in got:
        if r.volume_was_missing:
            off[[0, 1, 3, 60][int(r.entity[1:]) % 4]].append(math.log(r.volume_filled) - level[r.entity])
    for n, most in ((1, 0.6), (3, 0.45), (60, 0.35)):
        assert abs(np.mean(off[n])) < 0.15 and np.std(off[n]) < most
    unseen = [math.log(r.volume_filled) for r in got if int(r.entity[1:]) % 4 == 0]
    assert abs(np.mean(unseen) - np.mean([v for e, v in level.items() if int(e[1:]) % 4])) < 1.5


def test_latest_version(spark):
    rows = [("a", 1, 5.0), ("a", None, 6.0), ("a", 2, 7.0), (None, 1, 8.0), (None, 1, 8.0)]
    got = latest_version(spark.createDataFrame(rows, "k string, v int, x double"), ["k"], ["v"]).collect()
    assert {(r.k, r.x) for r in got} == {("a", 7.0), (None, 8.0)}

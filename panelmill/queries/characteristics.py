"""Queries of the rolling characteristics, and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

from panelmill.operators import characteristics as ch
from panelmill.queries.base import EXCESS, RETURNS, excess, num, over, qnum, qsci, returns, sci, skip, strict

QUERIES, ORACLES = {}, {}
#: By query, how each of its columns is shown.
SHOWN = {}
AVG, SD, MAX, MIN = "avg({x}) {w}", "stddev_samp({x}) {w}", "max({x}) {w}", "min({x}) {w}"
PROD = "product(1 + {x}) {w} - 1"


def shown(name: str) -> list[Column]:
    return [sci(c) if places is None else num(c, places) for c, places in SHOWN[name]]


def ln(x: str) -> str:
    return f"case when ({x}) > 0 then ln({x}) end"


def add(name: str, groups: list[str], columns: dict[str, str], base: str = RETURNS, start=returns, wide: tuple[str, ...] = (), doc: str = "", places: int = 8) -> None:
    """Register a query that builds groups of characteristics and shows some columns; ``columns`` has the SQL of each."""

    SHOWN[name] = [(c, None if c in wide else places) for c in columns]

    def run(spark: SparkSession, path: str) -> DataFrame:
        df = start(spark, path)
        for g in groups:
            df = ch.GROUPS[g](df)
        return df.select("entity", "date", *shown(name))

    run.__name__, run.__doc__ = name, doc
    QUERIES[name] = run
    if all(columns.values()):
        source = {EXCESS: "exc", LIQ: "liq", LAGS: "lag"}.get(base, "ret")
        ORACLES[name] = f"with {base} select entity, date, {', '.join(qsci(x, c) if c in wide else qnum(x, c, places) for c, x in columns.items())} from {source}"


LIQ = f"""{RETURNS},
liq0 as (select *, lag(volume) over (partition by entity order by date) / marketcap as turn,
  abs(ret) / volume as ami, close * volume as traded, close * volume / marketcap as scaled from ret),
liq as (select *, lag(turn) over (partition by entity order by date) as turn_before from liq0)"""
LAGS = f"""{EXCESS},
lag0 as (select *, lag(cmkt, 1) over (partition by entity order by date) as x1, lag(cmkt, 2) over (partition by entity order by date) as x2 from exc),
lag as (select *, ret_excess is not null and cmkt is not null and x1 is not null and x2 is not null as whole from lag0)"""

add("size_chars", ["size"], {"mcap": "ln(marketcap)", "prc": "ln(close)", "maxdprc": strict(MAX, "close", 7)}, wide=("maxdprc",), doc="Log cap, log price, greatest close of 7 rows.")
add("cumret_7_14_21_30", ["momentum"], {f"r{n}_0": skip(PROD, "ret", n) for n in (7, 14, 21, 30)}, doc="Compounded returns.")
add("cumret_30_14", ["momentum"], {"r30_14": skip(PROD, "ret", 16, 14)})
add("cumret_180_60", ["momentum"], {"r180_60": skip(PROD, "ret", 120, 60)})
add("dist_high_90", ["momentum"], {"dh90": f"close / ({strict(MAX, 'close', 90)})"})
add("volume_means", ["volume"], {"volume_7d": strict(AVG, "volume", 7), "volume_30d": strict(AVG, "volume", 30)}, wide=("volume_7d", "volume_30d"))
add("log_volume", ["volume"], {"logvol": ln(strict(AVG, "volume", 7))})
add("price_volume", ["volume"], {"prcvol": ln(strict(AVG, "traded", 7))}, base=LIQ)
add("scaled_volume", ["volume"], {"volscaled": ln(strict(AVG, "scaled", 7))}, base=LIQ)


def _reg(f: str, n: int = 30) -> str:
    w = over(n - 1)
    return f"case when rn >= {n} and regr_count(ret_excess, cmkt) {w} > 2 and regr_sxx(ret_excess, cmkt) {w} > 1e-18 then {f.format(w=w)} end"


add("capm_alpha_beta", ["capm"], {"alpha": _reg("regr_intercept(ret_excess, cmkt) {w}"), "beta": _reg("regr_slope(ret_excess, cmkt) {w}")}, base=EXCESS, start=excess)
add(
    "capm_ivol", ["capm"],
    {"ivol": _reg("sqrt(greatest(regr_syy(ret_excess, cmkt) {w} - pow(regr_sxy(ret_excess, cmkt) {w}, 2) / regr_sxx(ret_excess, cmkt) {w}, 0) / (regr_count(ret_excess, cmkt) {w} - 1))")},
    base=EXCESS, start=excess,
)
add("beta_squared", ["capm"], {"beta2": _reg("pow(regr_slope(ret_excess, cmkt) {w}, 2)")}, base=EXCESS, start=excess)

YZ_STEPS = """yz0 as (select *, lag(close) over (partition by entity order by date) as last from ret),
lag as (select *, ln(open / last) as o, ln(high / open) as u, ln(low / open) as d, ln(close / open) as c from yz0)"""
YZ = f"{RETURNS},\n{YZ_STEPS}"


def _yz(n: int) -> str:
    w = over(n - 2)
    k = 0.34 / (1.34 + (n + 1) / (n - 1))
    var = f"var_samp(o) {w} + {k!r} * var_samp(c) {w} + (1 - {k!r}) * avg(u * (u - c) + d * (d - c)) {w}"
    return f"case when rn >= {n} and count(o) {w} = {n - 1} and count(u * d * c) {w} = {n - 1} and ({var}) >= 0 then sqrt({var}) end"


def _add_from_lag(name: str, groups: list[str], columns: dict[str, str], base: str, **more) -> None:
    add(name, groups, columns, base=base, **more)
    ORACLES[name] = f"with {base} select entity, date, {', '.join(qnum(x, c, more.get('places', 8)) for c, x in columns.items())} from lag"


_add_from_lag("yang_zhang_vol", ["risk"], {"rvol_7d": _yz(7), "rvol_30d": _yz(30)}, YZ)
add("ret_vol", ["risk"], {"retvol": strict(SD, "ret", 7)})
add("std_price_volume", ["risk"], {"stdprcvol": ln(strict(SD, "traded", 7))}, base=LIQ)
add("var_5", ["risk"], {"var": skip("quantile_cont({x}, 0.05) {w}", "ret", 90)})
_ES = f"""{RETURNS},
lag0 as (select entity, date, rn, {skip('quantile_cont({x}, 0.05) {w}', 'ret', 90)} as q, list(ret) {over(89)} as seen from ret),
lag as (select *, list_filter(seen, lambda v : v is not null and v <= q) as tail from lag0)"""
_add_from_lag("es_5", ["risk"], {"es_5": "case when q is not null then list_avg(tail) end"}, _ES)


def _delay() -> str:
    w = over(27)
    s = {p: f"covar_pop({a}, {b}) filter (whole) {w}" for p, (a, b) in {
        "aa": ("cmkt", "cmkt"), "bb": ("x1", "x1"), "dd": ("x2", "x2"), "ab": ("cmkt", "x1"), "ad": ("cmkt", "x2"), "bd": ("x1", "x2"),
        "ya": ("ret_excess", "cmkt"), "yb": ("ret_excess", "x1"), "yd": ("ret_excess", "x2"), "yy": ("ret_excess", "ret_excess")}.items()}
    return ", ".join(f"{x} as {p}" for p, x in s.items()) + f", count(*) filter (whole) {w} as n"


_DELAY = f"""{LAGS},
cov as (select entity, date, rn, {_delay()} from lag),
det as (select *, aa * (bb * dd - bd * bd) + ab * (ad * bd - ab * dd) + ad * (ab * bd - ad * bb) as det,
  ya * ya * (bb * dd - bd * bd) + yb * yb * (aa * dd - ad * ad) + yd * yd * (aa * bb - ab * ab)
  + 2 * (ya * yb * (ad * bd - ab * dd) + ya * yd * (ab * bd - ad * bb) + yb * yd * (ab * ad - aa * bd)) as quad from cov)"""
add("delay", ["delay"], {"delay": "case when false then 0.0 end"}, base=LAGS, start=excess, places=6)
ORACLES["delay"] = f"""with {_DELAY} select entity, date, {qnum('case when rn >= 30 and n > 4 and yy > 1e-18 and aa > 1e-18 and det > 1e-9 * aa * bb * dd then (quad / det - ya * ya / aa) / yy end', 'delay', 6)} from det"""

add("amihud", ["liquidity"], {"illiq": strict(AVG, "ami", 90)}, base=LIQ, wide=("illiq",))
add("turnover", ["liquidity"], {"turn": "turn"}, base=LIQ)
add("turnover_mean", ["liquidity"], {"turn_7d": strict(AVG, "turn", 7)}, base=LIQ)
add("turnover_sd", ["liquidity"], {"std_turn": strict(SD, "turn", 30)}, base=LIQ)
add("volume_sd", ["liquidity"], {"std_vol": ln(strict(SD, "volume", 30))}, base=LIQ)
add("volume_cv", ["liquidity"], {"cv_vol": f"({strict(SD, 'volume', 30)}) / ({strict(AVG, 'volume', 30)})"}, base=LIQ)
add("abnormal_turnover", ["liquidity"], {"sat": f"(turn_before - ({strict(AVG, 'turn', 30, 1)})) / ({strict(SD, 'turn', 30, 1)})"}, base=LIQ, places=6)
add(
    "volume_shock", ["liquidity"],
    {f"volsh_{n}d": f"ln(volume) - ({ln(strict(AVG, 'volume', n))})" for n in (15, 30)}, base=LIQ,
)
_DTO = f"""{LIQ},
mt as (select date, sum(turn * marketcap) / sum(marketcap) as mt from liq where turn is not null group by 1),
lag as (select liq.*, turn - mt as x from liq left join mt using (date))"""
_add_from_lag("detrended_turnover", ["liquidity", "detrended_turnover"], {"dto": f"case when rn >= 90 then x - quantile_cont(x, 0.5) {over(89)} end"}, _DTO)

_M = "(avg(pow({x}, 3)) {w} - 3 * avg({x}) {w} * avg({x} * {x}) {w} + 2 * pow(avg({x}) {w}, 3)) / pow(var_pop({x}) {w}, 1.5)"
add("skew", ["distribution"], {f"skew_{n}d": strict(_M, "ret", n) for n in (7, 30)}, places=4)
_K = "kurtosis_pop({x}) {w}"
add("kurt", ["distribution"], {f"kurt_{n}d": strict(_K, "ret", n) for n in (7, 30)}, places=4)
add("max_min_ret", ["distribution"], {f"{m}ret_{n}d": strict(a, "ret", n) for n in (7, 30) for m, a in (("max", MAX), ("min", MIN))})


def _edge(n: int = 30) -> str:
    """The estimator written out row by row in lists, as it is published."""
    w = over(n - 2)
    mean = lambda x: f"list_avg(list_transform(rows, lambda v: {x}))"
    a = "-4 / po * (v.r1 - v.t * m1 / mt) * v.r2 - 4 / pc * (v.r3 - v.t * m3 / mt) * v.r4"
    b = "-4 / po * (v.r1 - v.t * m1 / mt) * v.r5 - 4 / pc * (v.r5 - v.t * m5 / mt) * v.r4"
    return f"""lag0 as (select entity, date, rn, ln(open) as o, ln(high) as h, ln(low) as l, ln(close) as c, ln(lag(high) over k) as h1, ln(lag(low) over k) as l1,
  ln(lag(close) over k) as c1 from ret window k as (partition by entity order by date)),
lag1 as (select *, (h + l) / 2 as mid, (h1 + l1) / 2 as mid1, case when h <> l or l <> c1 then 1.0 else 0.0 end as t from lag0),
lag2 as (select *, case when o + h + l + c + h1 + l1 + c1 is not null then {{'r1': mid - o, 'r2': o - mid1, 'r3': mid - c1, 'r4': c1 - mid1, 'r5': o - c1, 't': t::double,
  'oh': t::double * (o <> h)::int, 'ol': t::double * (o <> l)::int, 'ch': t::double * (c1 <> h1)::int, 'cl': t::double * (c1 <> l1)::int}} end as x from lag1),
lag3 as (select entity, date, rn, list_filter(list(x) {w}, lambda v: v is not null) as rows from lag2),
lag4 as (select *, {mean('v.r1')} as m1, {mean('v.r3')} as m3, {mean('v.r5')} as m5, {mean('v.t')} as mt, {mean('v.oh')} + {mean('v.ol')} as po, {mean('v.ch')} + {mean('v.cl')} as pc,
  list_sum(list_transform(rows, lambda v: v.t)) as n from lag3),
lag5 as (select *, list_transform(rows, lambda v: {a}) as xa, list_transform(rows, lambda v: {b}) as xb from lag4 where rn >= {n} and n >= 2 and po > 0 and pc > 0),
lag6 as (select *, list_avg(xa) as ea, list_avg(xb) as eb, list_var_pop(xa) as va, list_var_pop(xb) as vb from lag5),
lag7 as (select entity, date, sqrt(abs(case when va + vb > 0 then (vb * ea + va * eb) / (va + vb) else (ea + eb) / 2 end)) as bidask from lag6),
lag as (select lag0.entity, lag0.date, bidask from lag0 left join lag7 using (entity, date))"""


EDGE = f"{RETURNS},\n{_edge()}"
_add_from_lag("edge_spread", ["bid_ask"], {"bidask": "bidask"}, EDGE, doc="EDGE bid-ask spread over 30 rows.", places=6)

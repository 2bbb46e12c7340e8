"""Queries across a date's entities: ranks, correlations, sorted portfolios; and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.operators import characteristics as ch
from panelmill.operators import cross_section as cs
from panelmill.operators import factors as fac
from panelmill.operators.market import market_series
from panelmill.queries.base import EXCESS, FIRST, RETURNS, num, qnum, returns, skip
from panelmill.queries.characteristics import PROD, YZ, YZ_STEPS, _yz
from panelmill.sources.panel import estimation_panel, risk_free

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


CHARS = ["mcap", "r2_1", "r7_0", "rvol_30d", "beta", "illiq", "turn_7d", "dh90"]


@query(f"""with {RETURNS}, s as (select entity, date, ret, {skip(PROD, 'ret', 7)} as r7 from ret)
select entity, date, {qnum('ret', 'ret')}, {qnum('lag(ret) over (partition by entity order by date)', 'r2_1')}, {qnum('lag(r7) over (partition by entity order by date)', 'r7_0')} from s""")
def lagged_chars(spark: SparkSession, path: str) -> DataFrame:
    """Characteristics one row later; the return itself stays and its lag gets a name of its own."""
    rows = ch.momentum(returns(spark, path)).select("entity", "date", "ret", F.col("ret").alias("_ret"), "r7_0")
    out = cs.lag_all(rows, ["_ret", "r7_0"], {"_ret": "r2_1"})
    return out.select("entity", "date", num("ret"), num("r2_1"), num("r7_0"))


def _scaled(wide: bool = False) -> str:
    def z(c: str) -> str:
        plain = f"(r_{c} - 1) / nullif(max(r_{c}) over (partition by date) - 1, 0) - 0.5"
        return qnum(f"2 * ({plain})" if wide else plain, c)

    ranks = ", ".join(
        f"case when {c} is not null then rank() over (partition by date order by {c} nulls last) + (count(*) over (partition by date, {c}) - 1) / 2.0 end as r_{c}"
        for c in ("marketcap", "ret")
    )
    return f"with {RETURNS}, r as (select entity, date, {ranks} from ret) select entity, date, {z('marketcap')}, {z('ret')} from r"


@query(_scaled())
def rank_scale(spark: SparkSession, path: str) -> DataFrame:
    return cs.rank_scale(returns(spark, path).select("entity", "date", "marketcap", "ret"), ["marketcap", "ret"]).select("entity", "date", num("marketcap"), num("ret"))


@query(_scaled(wide=True))
def rank_scale_one(spark: SparkSession, path: str) -> DataFrame:
    rows = cs.rank_scale(returns(spark, path).select("entity", "date", "marketcap", "ret"), ["marketcap", "ret"], wide=True)
    return rows.select("entity", "date", num("marketcap"), num("ret"))


_PAIRS = " union all ".join(f"select '{a}' as a, '{b}' as b, {qnum(f'corr({a}, {b})', 'r')} from estimation_panel" for a in CHARS for b in CHARS if a != b)


@query(_PAIRS)
def corr_pairs(spark: SparkSession, path: str) -> DataFrame:
    return cs.correlations(estimation_panel(spark, path), CHARS).select("a", "b", num("r"))


@query(f"select * from ({_PAIRS}) where abs(r) > 0.005 and abs(r) < 1")
def high_corr(spark: SparkSession, path: str) -> DataFrame:
    return cs.close_pairs(estimation_panel(spark, path), CHARS, 0.005).select("a", "b", num("r"))


@query(f"""with {RETURNS} select entity, date, ntile(5) over (partition by date order by marketcap, entity)::int as bucket from ret where marketcap is not null""")
def ntile_buckets(spark: SparkSession, path: str) -> DataFrame:
    return cs.buckets(returns(spark, path), "marketcap", 5).select("entity", "date", "bucket")


def _legs(source: str, signal: str, tag: str = "", n: int = 5) -> str:
    return f"""sig{tag} as (select *, round({signal}, 9) as signal from {source} where ret is not null),
b{tag} as (select *, ntile({n}) over (partition by date order by signal, entity) as q from sig{tag} where signal is not null),
legs{tag} as (select date, q, sum(ret * marketcap) / sum(marketcap) as r from b{tag} group by 1, 2)"""


def _lagged(expr: str, source: str, name: str = "sl") -> str:
    return f"{name} as (select *, lag(round({expr}, 9)) over (partition by entity order by date) as ls from {source})"


def _factor(long: int, short: int, name: str, tag: str = "", places: int = 8) -> str:
    return f"select date, {qnum(f'max(case when q = {long} then r end) - max(case when q = {short} then r end)', name, places)} from legs{tag} group by 1"


@query(f"with {RETURNS}, {_legs('ret', 'marketcap')} {_factor(1, 5, 'smb')}")
def smb(spark: SparkSession, path: str) -> DataFrame:
    return fac.size_factor(returns(spark, path)).select("date", num("smb"))


@query(f"with {RETURNS}, {_legs('ret', 'marketcap')} select date, {', '.join(qnum(f'max(case when q = {q} then r end)', f'Q{q}') for q in range(1, 6))} from legs group by 1")
def size_quintiles(spark: SparkSession, path: str) -> DataFrame:
    """Returns of the size quintiles side by side."""
    return fac.leg_returns(returns(spark, path), F.round("marketcap", 9), 5).select("date", *[num(f"Q{q}") for q in range(1, 6)])


@query(f"with {RETURNS}, {_lagged('abs(ret) / (volume / 1e6)', 'ret')}, {_legs('sl', 'ls')} {_factor(5, 1, 'liq')}")
def liquidity_factor(spark: SparkSession, path: str) -> DataFrame:
    return fac.liquidity_factor(returns(spark, path)).select("date", num("liq"))


@query(f"with {YZ}, vl as (select *, {_yz(30)} as rvol from lag), {_lagged('rvol', 'vl')}, {_legs('sl', 'ls')} {_factor(5, 1, 'vol')}")
def volatility_factor(spark: SparkSession, path: str) -> DataFrame:
    return fac.volatility_factor(ch.risk(returns(spark, path))).select("date", num("vol"))


_MOM = f"""mm as (select *, {skip(PROD, 'ret', 21)} as r21 from ret),
ml as (select *, lag(round(r21, 9)) over (partition by entity order by date) as ls from mm where r21 is not null and ret is not null),
ms as (select *, case when marketcap <= median(marketcap) over (partition by date) then 'small' else 'big' end as size,
  ntile(10) over (partition by date order by ls, entity) as q from ml where ls is not null),
mg as (select date, size || case when q <= 3 then '_low' when q <= 7 then '_medium' else '_high' end as leg, sum(ret * marketcap) / sum(marketcap) as r from ms group by 1, 2),
mf as (select date, (max(case when leg = 'small_high' then r end) + max(case when leg = 'big_high' then r end)) / 2
  - (max(case when leg = 'small_low' then r end) + max(case when leg = 'big_low' then r end)) / 2 as cmom from mg group by 1)"""


@query(f"with {RETURNS}, {_MOM} select date, {qnum('cmom', 'cmom')} from mf")
def momentum_factor(spark: SparkSession, path: str) -> DataFrame:
    return fac.momentum_factor(ch.momentum(returns(spark, path))).select("date", num("cmom"))


def factor_frame(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """cmkt, smb, cmom, liq and vol of the dates that have all of them."""
    rows = returns(spark, path)
    market = market_series(rows, risk_free(spark, path)).select("date", "cmkt")
    return fac.merge(
        [market, fac.size_factor(rows), fac.momentum_factor(ch.momentum(rows)), fac.liquidity_factor(rows), fac.volatility_factor(ch.risk(rows))], since
    )


def all_factors(places: int = 8) -> str:
    return f"""with {EXCESS}, {_legs('ret', 'marketcap', '1')}, f1 as ({_factor(1, 5, 'smb', '1', places)}),
{_lagged('abs(ret) / (volume / 1e6)', 'ret', 'sl2')}, {_legs('sl2', 'ls', '2')}, f2 as ({_factor(5, 1, 'liq', '2', places)}),
{YZ_STEPS}, vl as (select *, {_yz(30)} as rvol from lag), {_lagged('rvol', 'vl', 'sl3')}, {_legs('sl3', 'ls', '3')}, f3 as ({_factor(5, 1, 'vol', '3', places)}), {_MOM}
select date, {qnum('cmkt', 'cmkt', places)}, smb, {qnum('cmom', 'cmom', places)}, liq, vol from (select date, mktret - rf as cmkt from mkt) join f1 using (date)
join mf using (date) join f2 using (date) join f3 using (date)"""


_ALL = all_factors()


@query(_ALL)
def factor_table(spark: SparkSession, path: str) -> DataFrame:
    """The factors of all dates that have all five."""
    return factor_frame(spark, path).select("date", *[num(c) for c in ("cmkt", "smb", "cmom", "liq", "vol")])


@query(f"{_ALL} where date >= '{FIRST}'")
def factor_history(spark: SparkSession, path: str) -> DataFrame:
    """Those from the reference's floor on."""
    return factor_frame(spark, path, FIRST).select("date", *[num(c) for c in ("cmkt", "smb", "cmom", "liq", "vol")])


# The sectors of the panel.
SECTORS = ["settlement", "lending", "gaming", "storage", "oracle", "meme", "privacy", "bridge"]


@query(f"""with m as (select strftime(date, '%Y%m')::bigint as month_key, sector, avg(ret) as r from panel_clean where isfinite(ret) group by 1, 2)
select month_key, {', '.join(f"round(max(case when sector = '{c}' then r end), 8) + 0.0 as s_{c}" for c in SECTORS)} from m group by 1""")
def pivot_mean(spark: SparkSession, path: str) -> DataFrame:
    """Mean delivered return by month, one column per sector."""
    rows = spark.read.parquet(f"{path}/panel_clean.parquet").filter("ret is not null and not isnan(ret) and abs(ret) < double('infinity')")
    rows = rows.select(F.date_format("date", "yyyyMM").cast("long").alias("month_key"), "sector", "ret")
    out = cs.wide_by(rows, "month_key", "sector", SECTORS, "ret", "s_")
    return out.select("month_key", *[num(f"s_{c}") for c in SECTORS])


def p_sql(r: str, n: str) -> str:
    t = f"abs({r}) * sqrt(({n} - 2) / (1 - {r} * {r}))"
    return f"case when {n} > 2 and abs({r}) < 1 then 2.0 / (exp(0.07056 * pow({t}, 3) + 1.5976 * {t}) + 1) when {n} > 2 and {r} is not null then 0.0 end"


SCORE = "case when {p} < 0.01 then 3 when {p} < 0.05 then 2 when {p} < 0.1 then 1 else 0 end"


def correlation_rows(df: DataFrame) -> DataFrame:
    """(characteristic, r, n): correlation of each characteristic with the return."""
    pairs = [(F.col(c).isNotNull() & F.col("ret_excess").isNotNull()) for c in CHARS]
    got = df.agg(*[F.corr(c, "ret_excess").alias(f"r_{c}") for c in CHARS], *[F.count_if(ok).alias(f"n_{c}") for c, ok in zip(CHARS, pairs)])
    each = [F.struct(F.lit(c).alias("characteristic"), F.col(f"r_{c}").alias("r"), F.col(f"n_{c}").alias("n")) for c in CHARS]
    return got.select(F.explode(F.array(*each)).alias("x")).select("x.*")


CORR = " union all ".join(f"select '{c}' as characteristic, corr({c}, ret_excess) as r, count(*) filter ({c} is not null and ret_excess is not null) as n from {{0}}" for c in CHARS)


@query(f"""with c as ({CORR.format('estimation_panel')}), p as (select characteristic, {p_sql('r', 'n')} as p from c)
select characteristic, {qnum('p', 'p', 7)}, {SCORE.format(p='p')} as score, coalesce(list_position(['beta', 'mcap', 'illiq'], characteristic), 0)::bigint as place from p""")
def significance_scores(spark: SparkSession, path: str) -> DataFrame:
    """A score per characteristic from the p-value of its correlation with the return, and its place in a given order."""
    rows = correlation_rows(estimation_panel(spark, path)).withColumn("p", cs.correlation_p(F.col("r"), F.col("n")))
    rows = cs.order_by_list(rows.withColumn("score", cs.significance(F.col("p"))), "characteristic", ["beta", "mcap", "illiq"])
    return rows.select("characteristic", num("p", 7), "score", F.coalesce("place", F.lit(0)).cast("long").alias("place"))

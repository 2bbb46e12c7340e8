"""The inputs that many queries share, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.operators import clean
from panelmill.operators.market import with_market
from panelmill.sources.panel import panel, risk_free

BENCHMARK = "quorvalt"
#: The reference's first and last date of factors and estimation.
FIRST, LAST = "2018-06-01", "2025-07-31"


def usable(spark: SparkSession, path: str) -> DataFrame:
    """The panel with close, volume and market cap."""
    return clean.positive_filter(panel(spark, path))


def returns(spark: SparkSession, path: str) -> DataFrame:
    """The usable panel with clipped returns."""
    return clean.clip(clean.simple_return(usable(spark, path)))


def excess(spark: SparkSession, path: str) -> DataFrame:
    """The returns with the market's, the rate and the excesses."""
    return with_market(returns(spark, path), risk_free(spark, path))


def num(name: str, places: int = 8) -> Column:
    """A column rounded for comparison; -0.0 becomes 0.0 and NaN null."""
    return (F.round(F.when(~F.isnan(name), F.col(name)), places) + F.lit(0.0)).alias(name)


def sci(name: str, digits: int = 9) -> Column:
    """A column in scientific notation, for numbers of any size."""
    return F.when(F.col(name).isNotNull(), F.format_string(f"%.{digits}e", F.col(name))).alias(name)


def qnum(expr: str, name: str, places: int = 8) -> str:
    return f"round(case when isnan(({expr})::double) then null else ({expr})::double end, {places}) + 0.0 as {name}"


def qsci(expr: str, name: str, digits: int = 9) -> str:
    return f"case when ({expr}) is not null then format('{{:.{digits}e}}', ({expr})::double) end as {name}"


_POS = "case when {0} > 0 and isfinite({0}) then {0} end as {0}"
PANEL = f"""pan as (select entity, date, {', '.join(_POS.format(c) for c in ('open', 'high', 'low', 'close', 'volume', 'marketcap'))}, sector
  from panel_clean qualify row_number() over (partition by entity, date order by read_at desc, row_id desc) = 1),
use as (select * from pan where close > 0 and volume > 0 and marketcap > 0)"""
RETURNS = f"""{PANEL},
raw as (select *, close / lag(close) over (partition by entity order by date) - 1 as plain from use),
ret as (select * exclude (plain), case when plain is not null then least(greatest(plain, -0.99), 5.0) end as ret,
  row_number() over (partition by entity order by date) as rn from raw)"""
EXCESS = f"""{RETURNS},
rate as (select date, pow(1 + max(rate_pct) / 100, 1.0 / 252) - 1 as rf from risk_free group by 1),
vw as (select date, sum(ret * marketcap) / sum(marketcap) as mktret from ret where ret is not null group by 1),
mkt as (select date, mktret, last_value(rf ignore nulls) over (order by date rows unbounded preceding) as rf from vw left join rate using (date)),
exc as (select ret.*, mktret, rf, mktret - rf as cmkt, ret - rf as ret_excess from ret left join mkt using (date))"""


def over(back: int, upto: int = 0) -> str:
    end = "current row" if upto == 0 else f"{-upto} preceding"
    return f"over (partition by entity order by date rows between {back} preceding and {end})"


def strict(agg: str, x: str, n: int, lag: int = 0) -> str:
    w = over(n + lag - 1, -lag)
    return f"case when rn >= {n + lag} and count({x}) {w} = {n} then {agg.format(x=x, w=w)} end"


def skip(agg: str, x: str, n: int, lag: int = 0) -> str:
    return f"case when rn >= {n + lag} then {agg.format(x=x, w=over(n + lag - 1, -lag))} end"

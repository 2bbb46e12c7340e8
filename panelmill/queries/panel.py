"""Queries of cleaning, joins, aggregates and descriptives on the panel, and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.operators import clean, describe, market
from panelmill.queries.base import BENCHMARK, EXCESS, FIRST, LAST, PANEL, RETURNS, excess, num, qnum, qsci, returns, sci, usable
from panelmill.session import table
from panelmill.sources.panel import panel, risk_free

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_OHLC = ", ".join(qsci(c, c) for c in ("open", "high", "low", "close", "volume", "marketcap"))


@query(f"with {PANEL} select entity, date, {_OHLC} from pan")
def panel_ohlcv(spark: SparkSession, path: str) -> DataFrame:
    """The canonical panel: one row per entity and date, the last version read."""
    return panel(spark, path).select("entity", "date", *[sci(c) for c in ("open", "high", "low", "close", "volume", "marketcap")])


@query(f"with {PANEL} select entity, date, {qsci('close', 'close')} from use")
def positive_filter(spark: SparkSession, path: str) -> DataFrame:
    return usable(spark, path).select("entity", "date", sci("close"))


@query(f"with {PANEL} select entity, date, {qsci('marketcap', 'marketcap')} from use where marketcap >= 1e7")
def size_floor(spark: SparkSession, path: str) -> DataFrame:
    return clean.size_floor(usable(spark, path), 1e7).select("entity", "date", sci("marketcap"))


@query(f"with {PANEL} select entity, date, {qnum('volume / marketcap', 'ratio')} from use where volume / marketcap <= 0.05")
def vm_ratio_filter(spark: SparkSession, path: str) -> DataFrame:
    rows = clean.ratio_filter(usable(spark, path), 0.05).withColumn("ratio", F.col("volume") / F.col("marketcap"))
    return rows.select("entity", "date", num("ratio"))


#: An entity whose cap others do exceed.
SECOND = "brinzelo"


@query(f"""with {PANEL} select u.entity, u.date, {qsci('u.marketcap', 'marketcap')} from use u
left join (select date, marketcap as cap from use where entity = '{SECOND}') b using (date)
where u.entity = '{SECOND}' or cap is null or u.marketcap <= cap""")
def benchmark_cap_filter(spark: SparkSession, path: str) -> DataFrame:
    return clean.benchmark_filter(usable(spark, path), SECOND).select("entity", "date", sci("marketcap"))


@query(f"""with {PANEL} select entity, date from use where entity not in (select shortname from entities where name ilike '% token' and shortname is not null)""")
def exclusion_anti_join(spark: SparkSession, path: str) -> DataFrame:
    """Rows of entities that aren't in an exclusion list, which may repeat names."""
    listed = table(spark, path, "entities").filter(F.col("name").ilike("% token")).select("shortname")
    return clean.exclude(usable(spark, path), listed).select("entity", "date")


@query(f"""with {PANEL}, i as (select entity, date, date - (row_number() over (partition by entity order by date))::int as g from use)
select entity, max(n)::bigint as streak from (select entity, g, count(*) as n from i group by 1, 2) group by 1""")
def longest_streak(spark: SparkSession, path: str) -> DataFrame:
    return clean.longest_streak(usable(spark, path))


@query(f"""with {PANEL}, i as (select entity, date, date - (row_number() over (partition by entity order by date))::int as g from use),
s as (select distinct entity from (select entity, g, count(*) as n from i group by 1, 2) where n >= 20)
select entity, date from use semi join s using (entity)""")
def streak_filter(spark: SparkSession, path: str) -> DataFrame:
    return clean.streak_filter(usable(spark, path), 20).select("entity", "date")


@query(f"with {PANEL} select entity, date from use qualify count(*) over (partition by entity) >= 90")
def min_obs_filter(spark: SparkSession, path: str) -> DataFrame:
    return clean.min_observations(usable(spark, path), 90).select("entity", "date")


@query(f"""with {PANEL}, e as (select entity, date from use where date between '{FIRST}' and '{LAST}'
qualify count(*) over (partition by entity) >= 60) select entity, date from e qualify count(*) over (partition by date) >= 30""")
def min_cross_section(spark: SparkSession, path: str) -> DataFrame:
    """Date range, then entities with enough rows, then dates with enough of these; entities aren't counted again."""
    rows = usable(spark, path).filter(F.col("date").between(FIRST, LAST))
    return clean.min_cross_section(clean.min_observations(rows, 60), 30).select("entity", "date")


@query(ORACLES["min_cross_section"].replace("date from use where", "date, marketcap from use where marketcap >= 1e6 and"))
def min_cross_section_history(spark: SparkSession, path: str) -> DataFrame:
    """The same after the floor on size."""
    rows = clean.size_floor(usable(spark, path), 1e6).filter(F.col("date").between(FIRST, LAST))
    return clean.min_cross_section(clean.min_observations(rows, 60), 30).select("entity", "date")


@query("""select entity, date, obs_id from estimation_panel qualify row_number() over (partition by entity, date order by obs_id) = 1""")
def dedup_first(spark: SparkSession, path: str) -> DataFrame:
    rows = table(spark, path, "estimation_panel").select("entity", "date", "obs_id")
    return clean.keep_first(rows, ["entity", "date"], ["obs_id"]).select("entity", "date", "obs_id")


@query("select distinct symbol, name, shortname from entities")
def distinct_entities(spark: SparkSession, path: str) -> DataFrame:
    return table(spark, path, "entities").select("symbol", "name", "shortname").distinct()


@query("""select entity, row_number() over (order by entity) as entity_id from (select distinct entity from panel_clean where entity is not null)""")
def dense_id(spark: SparkSession, path: str) -> DataFrame:
    return clean.dense_ids(table(spark, path, "panel_clean"))


@query(f"with {RETURNS} select entity, date, {qnum('close / lag(close) over (partition by entity order by date) - 1', 'ret')} from use")
def simple_return(spark: SparkSession, path: str) -> DataFrame:
    return clean.simple_return(usable(spark, path)).select("entity", "date", num("ret"))


@query(f"""with {RETURNS} select entity, date, {qnum('case when ret is not null then least(greatest(ret, -0.05), 0.05) end', 'ret')} from ret""")
def clip_return(spark: SparkSession, path: str) -> DataFrame:
    return clean.clip(returns(spark, path), low=-0.05, high=0.05).select("entity", "date", num("ret"))


@query(f"with {EXCESS} select date, {qnum('mktret', 'mktret')} from mkt")
def market_return(spark: SparkSession, path: str) -> DataFrame:
    return market.value_weighted(returns(spark, path), ["date"], "ret", name="mktret").select("date", num("mktret"))


@query(f"with {EXCESS} select date, {qnum('rf', 'rf', 10)} from mkt")
def rf_locf(spark: SparkSession, path: str) -> DataFrame:
    """The daily rate on every market date: joined by date, then carried over dates without one."""
    return market.market_series(returns(spark, path), risk_free(spark, path)).select("date", num("rf", 10))


@query(f"with {EXCESS} select entity, date, {qnum('cmkt', 'cmkt')}, {qnum('ret_excess', 'ret_excess')} from exc")
def market_excess(spark: SparkSession, path: str) -> DataFrame:
    return excess(spark, path).select("entity", "date", num("cmkt"), num("ret_excess"))


@query(f"with {PANEL} select entity, count(*) as n from use group by 1")
def obs_per_entity(spark: SparkSession, path: str) -> DataFrame:
    return describe.observations(usable(spark, path), "entity")


@query(f"with {PANEL} select date, count(distinct entity) as entities from use group by 1")
def entities_per_date(spark: SparkSession, path: str) -> DataFrame:
    return describe.entities_per(usable(spark, path), F.col("date").alias("date"))


@query(f"with {PANEL} select year(date)::int as year, count(distinct entity) as entities from use group by 1")
def entities_per_year(spark: SparkSession, path: str) -> DataFrame:
    return describe.entities_per(usable(spark, path), F.year("date").alias("year"))


@query(f"""with {PANEL}, d as (select year(date)::int as year, date, count(distinct entity) as n from use group by 1, 2)
select year, min(n) as least from d group by 1""")
def min_cross_section_per_year(spark: SparkSession, path: str) -> DataFrame:
    return describe.least_cross_section(usable(spark, path))


@query(f"""with {PANEL}, d as (select date, count(distinct entity) as n from use group by 1)
select date, case when date = '2025-03-10' then lag(n) over (order by date) else n end as n from d""")
def date_patch(spark: SparkSession, path: str) -> DataFrame:
    """Entities per date, one date replaced by the date before it."""
    counts = describe.entities_per(usable(spark, path), F.col("date").alias("date")).withColumnRenamed("entities", "n")
    return describe.patch_date(counts, "n", "2025-03-10")


@query(f"with {PANEL} select date, {qsci('sum(marketcap)', 'marketcap')} from use group by 1")
def total_cap_per_date(spark: SparkSession, path: str) -> DataFrame:
    return usable(spark, path).groupBy("date").agg(F.sum("marketcap").alias("marketcap")).select("date", sci("marketcap"))


@query(f"""with {RETURNS} select max(date) as last_date, count(*) as n, count_if(ret > 0.2)::bigint as high, count_if(ret < -0.2)::bigint as low from ret""")
def global_counters(spark: SparkSession, path: str) -> DataFrame:
    return returns(spark, path).agg(
        F.max("date").alias("last_date"), F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("ret") > 0.2).alias("high"), F.count_if(F.col("ret") < -0.2).alias("low"),
    )


_ROW = f"""count(*) as n, count(distinct entity) as entities, {qnum('avg(ret)', 'mean')}, {qnum('stddev_samp(ret)', 'sd')},
{', '.join(qnum(f'quantile_cont(ret, {p / 100})', f'p{p}') for p in (10, 25, 50, 75, 90))}"""


@query(f"""with {RETURNS}, x as (select * from ret where ret is not null),
last as (select entity, row_number() over (order by marketcap desc, entity) as k from ret where date = (select max(date) from ret))
select 'all' as sample, {_ROW} from x union all
select 'top 100', {_ROW} from x where entity in (select entity from last where k <= 100) union all
select 'top 10', {_ROW} from x where entity in (select entity from last where k <= 10) union all
select entity, {_ROW} from x where entity in ('quorvalt', 'brinzelo', 'hestramund') group by entity""")
def summary_table(spark: SparkSession, path: str) -> DataFrame:
    """Count, entities, mean, deviation and percentiles of returns: all, the largest 100 and 10 on the last date, three by name."""
    out = describe.summary(returns(spark, path), "ret", [100, 10], ["quorvalt", "brinzelo", "hestramund"])
    return out.select("sample", "n", "entities", *[num(c) for c in ("mean", "sd", "p10", "p25", "p50", "p75", "p90")])


@query(f"""with {PANEL} select entity, {qsci('marketcap', 'marketcap')} from use where date = (select max(date) from use)
order by use.marketcap desc, entity limit 10""")
def top_k_last_date(spark: SparkSession, path: str) -> DataFrame:
    return describe.largest(usable(spark, path), 10).select("entity", sci("marketcap"))


@query("""select shortname, trading_since, row_number() over (order by trading_since, shortname) as place
from (select distinct shortname, trading_since from entities where trading_since is not null)""")
def listing_order(spark: SparkSession, path: str) -> DataFrame:
    """Entities numbered in the order of their listing."""
    listed = table(spark, path, "entities").select("shortname", "trading_since").filter("trading_since is not null").distinct()
    return describe.numbered(listed, ["trading_since", "shortname"], "place")


@query(f"""with {RETURNS}, q as (select date, entity, ret from ret where ret is not null)
select date, {qnum('median(ret)', 'median')}, {qnum('quantile_cont(ret, 0.9)', 'p90')} from q group by 1""")
def median_per_date(spark: SparkSession, path: str) -> DataFrame:
    rows = returns(spark, path).filter("ret is not null")
    return rows.groupBy("date").agg(F.percentile("ret", 0.5).alias("median"), F.percentile("ret", 0.9).alias("p90")).select("date", num("median"), num("p90"))


@query(f"""with {PANEL} select count(*) as n, count(*) - count(volume) as missing, {qsci('min(volume)', 'min')},
{', '.join(qsci(f'quantile_cont(volume, {p})', c) for p, c in ((0.25, 'q1'), (0.5, 'median'), (0.75, 'q3')))}, {qsci('avg(volume)', 'mean', 6)}, {qsci('max(volume)', 'max')} from pan""")
def column_summary(spark: SparkSession, path: str) -> DataFrame:
    out = describe.column_summary(panel(spark, path), "volume")
    return out.select("n", "missing", *[sci(c) for c in ("min", "q1", "median", "q3")], sci("mean", 6), sci("max"))

"""Queries of readers, writers, scalars, pipelines and the stream, each over the given tables, with DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.operators import clean
from panelmill.plans import pipeline
from panelmill.queries import characteristics
from panelmill.queries.base import BENCHMARK, EXCESS, PANEL, RETURNS, num, qnum, qsci, returns, sci, usable
from panelmill.session import table
from panelmill.sources import files
from panelmill.sources.panel import panel, risk_free
from panelmill.streaming.bars import daily_bars

QUERIES, ORACLES = {}, {}
DOCUMENT_ROWS = 1000  # rows in a JSON document


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("select distinct symbol, name, shortname, coalesce(market_cap_rank, -1) as market_cap_rank, trading_since, round(last_market_cap_usd, 2) as last_market_cap_usd from entities")
def entity_json(spark: SparkSession, path: str) -> DataFrame:
    """The entity list written as JSON documents and read back: epoch seconds to dates, distinct rows."""
    rows = table(spark, path, "entities").select(
        "symbol", "name", "shortname", "market_cap_rank", F.unix_seconds(F.col("trading_since").cast("timestamp")).alias("trading_since"), "last_market_cap_usd"
    )
    # About as many rows to a document whatever the table's size; copies of a row are spread too.
    documents = max(1, -(-rows.count() // DOCUMENT_ROWS))
    place = F.pmod(F.monotonically_increasing_id(), F.lit(documents))
    docs = rows.groupBy(place.alias("g")).agg(F.collect_list(F.struct(*rows.columns)).alias("data")).select("data")
    at = files.scratch(spark)
    docs.write.json(at)
    rank = F.coalesce("market_cap_rank", F.lit(-1))
    got = files.entity_list(spark, at).withColumns({"last_market_cap_usd": F.round("last_market_cap_usd", 2), "market_cap_rank": rank})
    return files.taken(got, at)


@query(f"""with {PANEL} select date, entity, {', '.join(qsci(c, c) for c in ('open', 'close', 'high', 'low', 'volume', 'marketcap'))} from use""")
def history_json(spark: SparkSession, path: str) -> DataFrame:
    """Histories written as JSON documents, one folder per entity, and read back with the entity from the path."""
    raw = panel(spark, path)
    row = F.struct(
        F.date_format("date", "yyyy-MM-dd HH:mm:ss").alias("time_start"), F.col("open").alias("price_open_usd"), F.col("close").alias("price_close_usd"),
        F.col("high").alias("price_high_usd"), F.col("low").alias("price_low_usd"), F.col("volume").alias("volume_usd"), F.col("marketcap").alias("market_cap_usd"),
    )
    at = files.scratch(spark)
    # One document per entity and month: bounded whatever the entity.
    docs = raw.groupBy("entity", F.trunc("date", "month").alias("m")).agg(F.collect_list(row).alias("data")).select("entity", "data")
    docs.repartition("entity").write.partitionBy("entity").json(at)
    return files.taken(files.histories(spark, at), at).select("date", "entity", *[sci(c) for c in ("open", "close", "high", "low", "volume", "marketcap")])


@query("""select distinct shortname as entity from entities where shortname is not null""")
def names_text(spark: SparkSession, path: str) -> DataFrame:
    """A list of names written as text lines, possibly repeated, and read back as a distinct list."""
    at = files.scratch(spark)
    files.write_names(table(spark, path, "entities"), at)
    return files.taken(files.names(spark, at), at)


@query("select date, max(rate_pct) as rate_pct from risk_free group by 1")
def rates_csv(spark: SparkSession, path: str) -> DataFrame:
    """The yields written as CSV and read back with a schema; nulls survive."""
    at = files.scratch(spark)
    files.write_csv(risk_free(spark, path), at)
    return files.taken(files.csv(spark, at, "date date, rate_pct double"), at)


@query(f"""with {PANEL} select year(date)::int * 100 + month(date)::int as k, entity, count(*) as n from use group by 1, 2""")
def keyed_files(spark: SparkSession, path: str) -> DataFrame:
    """Monthly counts in CSV folders whose names begin with the month; the key comes back from the name."""
    counts = usable(spark, path).groupBy((F.year("date") * 100 + F.month("date")).alias("k"), "entity").agg(F.count(F.lit(1)).alias("n"))
    at = files.scratch(spark)
    counts.withColumn("part", F.concat_ws("_", "k", F.lit("counts"))).drop("k").write.partitionBy("part").csv(at, header=True)
    return files.taken(files.keyed_csv(spark, f"{at}/part=*/", "entity string, n long", r"part=(\d+)_").select("k", "entity", "n"), at)


@query("""select date, 'clean' as source, count(*) as n, null::varchar as marketcap from panel_clean group by 1
union all select date, 'filtered', count(*), format('{:.9e}', max(case when isfinite(marketcap) then marketcap end)) from filtered_panel group by 1""")
def appended(spark: SparkSession, path: str) -> DataFrame:
    """Two sources appended by name, columns missing in one of them null."""
    a = table(spark, path, "panel_clean").groupBy("date").agg(F.lit("clean").alias("source"), F.count(F.lit(1)).alias("n"))
    cap = F.when(F.abs("marketcap") < float("inf"), F.col("marketcap"))
    b = table(spark, path, "filtered_panel").groupBy("date").agg(F.lit("filtered").alias("source"), F.count(F.lit(1)).alias("n"), F.max(cap).alias("marketcap"))
    return files.append([a, None, b.withColumn("marketcap", sci("marketcap"))])


@query("""select epoch_ms(snapped_at)::bigint // 86400000 as day, count(*) as n, count(distinct entity) as entities from panel_raw where snapped_at is not null group by 1""")
def epoch_dates(spark: SparkSession, path: str) -> DataFrame:
    """Readings keyed by epoch milliseconds, per date."""
    rows = table(spark, path, "panel_raw").filter("snapped_at is not null").select(F.unix_millis("snapped_at").alias("ms"), "entity")
    by = files.epoch_series(rows, "ms").groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("entity").alias("entities"))
    return by.select(F.unix_date("date").cast("long").alias("day"), "n", "entities")


@query(f"""with {PANEL} select entity, strftime(date, '%Y%m%d')::int as date_key, 'https://example.org/' || entity || '/' || strftime(date, '%Y-%m-%d') as url,
  split_part(entity, '-', 1) as stem, case when open is not null then round(round(close / open * 100 - 100, 6)::decimal(30, 6), 2)::varchar || '%' end as change, sign(close - open)::int as side from use""")
def scalar_functions(spark: SparkSession, path: str) -> DataFrame:
    """Date keys, formatted strings, splits, percentages and signs."""
    # Rounded as decimals, so that it is the same number everywhere that gets two places.
    change = F.round(F.round(F.col("close") / F.col("open") * 100 - 100, 6).cast("decimal(30,6)"), 2)
    rows = usable(spark, path)
    return rows.select(
        "entity", F.date_format("date", "yyyyMMdd").cast("int").alias("date_key"),
        F.format_string("https://example.org/%s/%s", "entity", F.date_format("date", "yyyy-MM-dd")).alias("url"),
        F.split("entity", "-")[0].alias("stem"), F.concat(change.cast("string"), F.lit("%")).alias("change"),
        F.signum(F.col("close") - F.col("open")).cast("int").alias("side"),
    )


@query(f"""with {PANEL}, bench as (select date, marketcap as cap from use where entity = '{BENCHMARK}'),
c1 as (select u.* from use u left join bench using (date) where u.entity = '{BENCHMARK}' or cap is null or u.marketcap <= cap),
c2 as (select * from c1 where entity not in (select shortname from entities where name ilike '% token' and shortname is not null)
  and marketcap >= 1e6 and volume / marketcap <= 1),
c3 as (select *, date - (row_number() over (partition by entity order by date))::int as g from c2),
c4 as (select distinct entity from (select entity, g, count(*) as n from c3 group by 1, 2) where n >= 15),
c5 as (select *, close / lag(close) over (partition by entity order by date) - 1 as plain from c2 semi join c4 using (entity))
select entity, date, {qnum('case when plain is not null then least(greatest(plain, -0.99), 5.0) end', 'ret')} from c5""")
def clean_pipeline(spark: SparkSession, path: str) -> DataFrame:
    """The whole cleaning stage, with a shorter streak."""
    listed = table(spark, path, "entities").filter(F.col("name").ilike("% token")).select("shortname")
    return pipeline.clean_panel(panel(spark, path), listed, BENCHMARK, streak=15).select("entity", "date", num("ret"))


def _finite(c: str) -> str:
    return f"case when not isnan({c}) then {c} end"


_LOADED = ("marketcap", "rvol_7d", "rvol_30d", "turn", "ret")
_SHOWN = ("marketcap", "rvol_7d", "rvol_30d", "turn", "r2_1")


def _estimation(weekly: bool, least_rows: int, least_entities: int) -> str:
    """SQL of the loader and the sample: first versions, (weeks,) ids, lags, whole rows, filters, ranks."""
    version = "row_number() over (partition by date, entity order by known_at, ret nulls first, marketcap nulls first) = 1"
    week = "first0 as (select * exclude (date), date_trunc('week', date)::date as date from one qualify row_number() over (partition by entity, date_trunc('week', date) order by date desc) = 1)"
    lags = ", ".join(f"lag({_finite(c)}) over (partition by entity order by date) as {'r2_1' if c == 'ret' else c}" for c in _LOADED)
    ranks = ", ".join(f"rank() over (partition by date order by {c}) + (count(*) over (partition by date, {c}) - 1) / 2.0 as k_{c}" for c in _SHOWN)
    scaled = ", ".join(qnum(f"(k_{c} - 1) / nullif(max(k_{c}) over (partition by date) - 1, 0) - 0.5", c) for c in _SHOWN)
    return f"""with one as (select date, entity, ret, marketcap, rvol_7d, rvol_30d, turn from characteristics qualify {version}),
{week if weekly else 'first0 as (select * from one)'},
lagged as (select date, entity, {_finite('ret')} as ret_excess, {lags} from first0),
ids as (select entity, row_number() over (order by entity) as id from (select distinct entity from lagged where entity is not null)),
whole as (select lagged.* exclude (entity), id as entity from lagged join ids using (entity)
  where ret_excess is not null and {' and '.join(f'{c} is not null' for c in _SHOWN)}),
rowed as (select * from whole where date between '2014-01-01' and '2025-07-31' qualify count(*) over (partition by entity) >= {least_rows}),
sample as (select * from rowed qualify count(*) over (partition by date) >= {least_entities}),
ranked as (select *, {ranks} from sample)
select date, entity::bigint as entity, {qnum('ret_excess', 'ret_excess')}, {scaled} from ranked"""


def _sample(spark: SparkSession, path: str, freq: str, least_rows: int, least_entities: int) -> DataFrame:
    rows = table(spark, path, "characteristics").select("date", "entity", "ret", "marketcap", "rvol_7d", "rvol_30d", "turn", F.col("ret").alias("ret_excess"), "known_at")
    rows = clean.keep_first(rows, ["date", "entity"], ["known_at", "ret", "marketcap"]).drop("known_at")
    sample = pipeline.estimation_sample(pipeline.load_panel(rows, freq=freq), "2014-01-01", "2025-07-31", least_rows, least_entities)
    return sample.select("date", F.col("entity").cast("long").alias("entity"), num("ret_excess"), *[num(c) for c in _SHOWN])


@query(_estimation(False, 30, 5))
def estimation_pipeline(spark: SparkSession, path: str) -> DataFrame:
    """From the characteristics table to the ranked estimation sample."""
    return _sample(spark, path, "daily", 30, 5)


@query(_estimation(True, 5, 5))
def weekly_pipeline(spark: SparkSession, path: str) -> DataFrame:
    """The same from the last row of each week."""
    return _sample(spark, path, "weekly", 5, 5)


@query(f"""with {RETURNS}, d as (select date, avg(rate_pct) as index_7 from (select date, max(rate_pct) as rate_pct from risk_free group by 1) group by 1)
select entity, date, {qnum('ln(marketcap)', 'mcap')}, {qnum('index_7', 'idx')} from ret left join d using (date)""")
def series_by_date(spark: SparkSession, path: str) -> DataFrame:
    """A sheet of a dated series, landed as CSV with headings and a text date of its own, projected, renamed and joined to the panel by date."""
    at = files.scratch(spark)
    sheet = risk_free(spark, path).select(F.date_format("date", "dd.MM.yyyy").alias("Day"), F.col("rate_pct").alias("Index (daily)"), F.lit("n/a").alias("Remark"))
    files.write_csv(sheet, at)
    read = files.csv(spark, at, "`Day` string, `Index (daily)` double, `Remark` string")
    series = files.taken(read.select(F.to_date("Day", "dd.MM.yyyy").alias("date"), F.col("Index (daily)").alias("idx")), at)
    df = pipeline.characteristics_panel(returns(spark, path), risk_free(spark, path), ["size"], [series])
    return df.select("entity", "date", num("mcap"), num("idx"))


@query(f"""with {PANEL} select entity, date, strftime(date, '%Y%m')::int as month_key, {qsci('close', 'close')}, sector from use""")
def partitioned_table(spark: SparkSession, path: str) -> DataFrame:
    """The panel written as Parquet in folders by month and read back, the month from the folder's name."""
    at = files.scratch(spark)
    files.write_table(usable(spark, path).select("entity", "date", "close", "sector", F.date_format("date", "yyyyMM").cast("int").alias("month_key")), at, ["month_key"])
    return files.taken(spark.read.parquet(at), at).select("entity", "date", "month_key", sci("close"), "sector")


@query(f"""with {PANEL}, y as (select year(date)::int as year, count(distinct entity) as entities, count(*) as n, avg(close / open) as ratio from use group by 1),
l as (select 0 as place, '\\begin{{tabular}}{{lrrr}}' as line union all select 1, '\\toprule' union all select 2, 'year & entities & rows\\_n & ratio \\\\'
union all select 3, '\\midrule' union all select 3 + row_number() over (order by year), format('{{:,}}', year) || ' & ' || format('{{:,}}', entities) || ' & ' || format('{{:,}}', n) || ' & ' || printf('%.4f', ratio) || ' \\\\' from y
union all select 100000, '\\bottomrule' union all select 100001, '\\end{{tabular}}')
select row_number() over (order by place) as place, line from l""")
def latex_table(spark: SparkSession, path: str) -> DataFrame:
    """A yearly summary as the lines of a LaTeX table."""
    rows = usable(spark, path).groupBy(F.year("date").alias("year")).agg(
        F.count_distinct("entity").alias("entities"), F.count(F.lit(1)).alias("rows_n"), F.avg(F.col("close") / F.col("open")).alias("ratio")
    )
    lines = files.latex(rows.orderBy("year")).split("\n")
    return spark.createDataFrame(list(enumerate(lines, 1)), "place long, line string")


@query(" join ".join(f"({sql})" + (" using (entity, date)" if i else "") for i, sql in enumerate(characteristics.ORACLES[k] for k in characteristics.SHOWN)).join(("select * from ", "")))
def all_characteristics(spark: SparkSession, path: str) -> DataFrame:
    """Every characteristic of the panel in one plan; its SQL joins those of the single queries."""
    df = pipeline.characteristics_panel(clean.clip(clean.simple_return(usable(spark, path))), risk_free(spark, path))
    return df.select("entity", "date", *[c for name in characteristics.SHOWN for c in characteristics.shown(name)])


@query("""with v as (select entity, date_trunc('day', snapped_at) as start, marketcap as v, snapped_at as t from panel_raw where snapped_at is not null and marketcap is not null and isfinite(marketcap))
select entity, strftime(start, '%Y%m%d')::bigint as date_key, format('{:.9e}', arg_min(v, {'a': t, 'b': v})) as open, format('{:.9e}', max(v)) as high,
  format('{:.9e}', min(v)) as low, format('{:.9e}', arg_max(v, {'a': t, 'b': -v})) as close, count(*) as readings from v group by 1, 2, start""")
def event_time_bars(spark: SparkSession, path: str) -> DataFrame:
    """Daily bars of market cap by event time; the same function runs on a stream."""
    bars = daily_bars(table(spark, path, "panel_raw").filter("abs(marketcap) < double('infinity')"))
    return bars.select("entity", F.date_format("start", "yyyyMMdd").cast("long").alias("date_key"), *[sci(c) for c in ("open", "high", "low", "close")], "readings")


@query(f"with {EXCESS}, t as (select date, sum(marketcap) as sample from use group by 1), g as (select snapped_at::date as date, max(case when isfinite(marketcap) and marketcap > 0 then marketcap end) as most from panel_raw group by 1) select date, {qsci('sample', 'sample')}, {qsci('most', 'most')} from t join g using (date)")
def sample_and_total(spark: SparkSession, path: str) -> DataFrame:
    """Market cap of the sample beside a series from another source, by date."""
    sample = usable(spark, path).groupBy("date").agg(F.sum("marketcap").alias("sample"))
    raw = table(spark, path, "panel_raw").select(F.unix_millis("snapped_at").alias("ms"), F.when((F.col("marketcap") > 0) & (F.col("marketcap") < float("inf")), F.col("marketcap")).alias("m"))
    most = files.epoch_series(raw, "ms").groupBy("date").agg(F.max("m").alias("most"))
    return sample.join(most, "date").select("date", sci("sample"), sci("most"))

"""Queries of the data-preparation operators of the core (problems 3 to 7), and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.operators.asof import known_before
from panelmill.operators.impute import Numeric, impute
from panelmill.operators.regular import regular_grid
from panelmill.operators.spikes import Field, spikes
from panelmill.operators.trailing import trailing_totals
from panelmill.session import attach, table


def _key(date: str) -> Column:
    return F.date_format(date, "yyyyMMdd").cast("long")


def _usable(spark: SparkSession, path: str) -> DataFrame:
    return table(spark, path, "panel_clean").filter("close > 0 and close < double('infinity')")


def p3_found(spark: SparkSession, path: str) -> DataFrame:
    grid = regular_grid(_usable(spark, path), "entity", "date", "close", ["read_at", "row_id"])
    return grid.filter("not observed").select("entity", _key("date").alias("date_key"))


def p3_daily_close(spark: SparkSession, path: str) -> DataFrame:
    grid = regular_grid(_usable(spark, path), "entity", "date", "close", ["read_at", "row_id"])
    return grid.select("entity", _key("date").alias("date_key"), F.format_string("%.9e", "close").alias("close"), _key("read_date").alias("read_key"), "observed")


def p3_interpolated(spark: SparkSession, path: str) -> DataFrame:
    grid = regular_grid(_usable(spark, path), "entity", "date", "close", ["read_at", "row_id"], fill="linear")
    return grid.select("entity", _key("date").alias("date_key"), F.format_string("%.9e", "close").alias("close"), "observed")


def _known(spark: SparkSession, path: str, take: list[str]) -> DataFrame:
    names = table(spark, path, "entities").filter("entity_id is not null").groupBy("entity_id").agg(F.min("shortname").alias("name"))
    obs = table(spark, path, "estimation_panel").withColumnRenamed("entity", "entity_id")
    obs = attach(obs, names, ["entity_id"], "inner").withColumnRenamed("name", "entity")
    rows = table(spark, path, "characteristics").filter("marketcap is not null and not isnan(marketcap)")
    return known_before(
        obs, rows, "entity", F.col("as_of"), F.col("known_at"), F.col("date"), F.col("date"), ["date", "known_at", "row_id"], ["obs_id", "ret_excess"], take
    )


def p4_found(spark: SparkSession, path: str) -> DataFrame:
    return _known(spark, path, ["row_id"]).filter("known is not null").select("obs_id", F.col("known.row_id").alias("row_id"))


def p4_excess_with_cap(spark: SparkSession, path: str) -> DataFrame:
    """Every observation with the market cap known at its as_of, null where none was."""
    known = _known(spark, path, ["marketcap"])
    return known.select("obs_id", F.round("ret_excess", 6).alias("ret_excess"), F.round("known.marketcap", 2).alias("marketcap"))


def _trailing(spark: SparkSession, path: str) -> DataFrame:
    return trailing_totals(table(spark, path, "characteristics"), "entity", "date", ["volume", "ret"], ["known_at", "row_id"])


def p7_found(spark: SparkSession, path: str) -> DataFrame:
    days = _trailing(spark, path).filter("age >= 29")
    # Volumes are whole numbers, so the comparison of the two averages is exact without the divisions.
    cases = F.array_compact(
        F.array(F.when(F.col("volume_sum_7") * 10 > F.col("volume_sum_30") * 7, F.lit("volume")), F.when(F.col("ret_sum_30") < -2.0000005, F.lit("ret")))
    )
    return days.select("entity", _key("date").alias("date_key"), F.explode(cases).alias("measure"))


def p7_totals(spark: SparkSession, path: str) -> DataFrame:
    r = lambda c, n: (F.round(c, n) + F.lit(0.0)).alias(c)
    return _trailing(spark, path).select(
        "entity", _key("date").alias("date_key"), "active",
        r("volume_sum_7", 0), r("volume_sum_30", 0), r("ret_sum_7", 6), r("ret_sum_30", 6), r("ret_avg_30", 9),
    )


# The sectors of the panel.
SECTORS = ["settlement", "lending", "gaming", "storage", "oracle", "meme", "privacy", "bridge"]


def _completed(spark: SparkSession, path: str) -> DataFrame:
    return impute(
        table(spark, path, "panel_clean"), "row_id", "entity", "date",
        {"volume": Numeric(log=True)}, {"sector": SECTORS}, {"marketcap": Numeric(log=True), "close": Numeric(log=True)},
    )


def p5_found(spark: SparkSession, path: str) -> DataFrame:
    """The rows and fields that were filled; each must have got a usable value."""
    rows = _completed(spark, path)
    usable = (F.col("volume_filled") > 0) & (F.col("volume_filled") < float("inf"))
    fields = F.array_compact(
        F.array(F.when(F.col("volume_was_missing") & usable, "volume"), F.when(F.col("sector_was_missing") & F.col("sector_filled").isNotNull(), "sector"))
    )
    return rows.select("row_id", F.explode(fields).alias("field"))


def p5_completed(spark: SparkSession, path: str) -> DataFrame:
    return _completed(spark, path).select("row_id", "entity", "date", "volume_filled", "volume_was_missing", "sector_filled", "sector_was_missing")


def p5_masks(spark: SparkSession, path: str) -> DataFrame:
    """The masks of every row and what was not filled; whether each filling is a usable value."""
    rows = _completed(spark, path)
    kept = lambda c: F.when(~F.col(f"{c}_was_missing"), F.col(f"{c}_filled"))
    usable = (F.col("volume_filled") > 0) & (F.col("volume_filled") < float("inf")) & F.col("sector_filled").isin(SECTORS)
    return rows.select(
        "row_id", "volume_was_missing", "sector_was_missing", F.round(kept("volume"), 2).alias("volume"), kept("sector").alias("sector"), usable.alias("usable")
    )


#: What is possible for the measurements of the panels.
FIELDS = {
    "marketcap": Field(least=0.0, least_possible=False, log=True, local=True),
    "volume": Field(least=0.0, least_possible=False, log=True, local=True),
    "ret": Field(least=-1.0, least_possible=True, log=False, local=False),
}


def _spikes(spark: SparkSession, path: str) -> DataFrame:
    raw = table(spark, path, "panel_raw").select("row_id", "entity", F.col("snapped_at").alias("at"), F.explode(F.array(
        F.struct(F.lit("marketcap").alias("field"), F.col("marketcap").alias("value")),
        F.struct(F.lit("volume").alias("field"), F.col("volume").alias("value")),
    )).alias("r")).select("r.field", "entity", "at", "r.value", "row_id")
    clean = table(spark, path, "panel_clean").select(
        F.lit("ret").alias("field"), "entity", F.col("date").cast("timestamp").alias("at"), F.col("ret").alias("value"), "row_id"
    )
    return spikes(raw.unionByName(clean), "field", "entity", "at", "value", "row_id", FIELDS)


def p6_found(spark: SparkSession, path: str) -> DataFrame:
    return _spikes(spark, path).select("field", "row_id")


def p6_kinds(spark: SparkSession, path: str) -> DataFrame:
    """Implausible rows by measurement and kind."""
    return _spikes(spark, path).groupBy("field", "kind").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (p3_found, p3_daily_close, p3_interpolated, p4_found, p4_excess_with_cap, p5_found, p5_completed, p5_masks, p6_found, p6_kinds, p7_found, p7_totals)}

_GRID3 = """u as (select entity, date, arg_max(close, {'a': read_at, 'b': row_id}) as close from panel_clean
  where close > 0 and isfinite(close) group by 1, 2),
s as (select entity, min(date) as a, max(date) as b from u group by 1),
d as (select entity, unnest(generate_series(a::timestamp, b::timestamp, interval 1 day))::date as date from s),
g as (select d.entity, d.date, u.close, u.close is not null as observed,
  case when u.close is not null then d.date end as own from d left join u on u.entity = d.entity and u.date = d.date)"""
_LATEST7 = """v as (select entity, date, arg_max({'v': case when volume is null or isnan(volume) then 0 else volume end,
  'r': case when ret is null or isnan(ret) then 0 else ret end}, {'a': known_at, 'b': row_id}) as x from characteristics group by 1, 2),
s as (select entity, min(date) as a, max(date) as b from v group by 1),
d as (select entity, a, unnest(generate_series(a::timestamp, b::timestamp, interval 1 day))::date as date from s),
g as (select d.entity, d.date, d.a, v.x is not null as active, coalesce(v.x.v, 0) as volume, coalesce(v.x.r, 0) as ret
  from d left join v on v.entity = d.entity and v.date = d.date),
t as (select *, sum(volume) over (partition by entity order by date rows between 6 preceding and current row) as v7,
  sum(volume) over (partition by entity order by date rows between 29 preceding and current row) as v30,
  sum(ret) over (partition by entity order by date rows between 6 preceding and current row) as r7,
  sum(ret) over (partition by entity order by date rows between 29 preceding and current row) as r30 from g)"""
_KNOWN4 = """e as (select entity_id, min(shortname) as name from entities where entity_id is not null group by 1),
k as (select o.obs_id, arg_max({'id': c.row_id, 'cap': c.marketcap}, {'a': c.date, 'b': c.known_at, 'c': c.row_id}) as x
  from estimation_panel o join e on e.entity_id = o.entity join characteristics c
    on c.entity = e.name and c.date < o.date and c.known_at <= o.as_of and c.marketcap is not null and not isnan(c.marketcap)
  group by 1)"""
_SPIKES6 = """l as (select row_id, entity, snapped_at as t, unnest(['marketcap', 'volume']) as field, unnest([marketcap, volume]) as v from panel_raw
  union all select row_id, entity, date::timestamptz, 'ret', ret from panel_clean),
m as (select *, not isfinite(v) or (field <> 'ret' and v <= 0) or (field = 'ret' and v < -1) as bad from l where v is not null),
x as (select field, entity, t, max(case when field = 'ret' then v else ln(v) end) as x, max(v) as v from m where not bad group by 1, 2, 3),
o as (select *, median(x) over (partition by field, entity order by t rows between 15 preceding and 15 following) as near,
  lag(v) over (partition by field, entity order by t) as p, row_number() over (partition by field, entity order by t) as n from x),
a as (select field, entity, median(x) as level from x group by 1, 2),
d as (select o.*, abs(x - case when field = 'ret' then level else near end) as d,
  sum(case when p = v then 0 else 1 end) over (partition by field, entity order by t rows unbounded preceding) as run from o join a using (field, entity)),
s as (select field, entity, median(d) as scale from d group by 1, 2),
r as (select field, entity, run, count(*) as len from d group by 1, 2, 3),
c as (select d.field, d.entity, d.t, case when p = v and len >= 5 then 'stuck' when d > 8 * scale then 'spike' end as kind
  from d join s using (field, entity) join r using (field, entity, run)),
f as (select field, row_id, 'impossible' as kind from m where bad union all
  select m.field, m.row_id, c.kind from m join c on c.field = m.field and c.entity = m.entity and c.t = m.t where not bad and kind is not null)"""

ORACLES = {
    "p5_found": """select row_id, 'volume' as field from panel_clean where volume is null or not (isfinite(volume) and volume > 0)
union all select row_id, 'sector' from panel_clean where sector is null or sector not in
  ('settlement', 'lending', 'gaming', 'storage', 'oracle', 'meme', 'privacy', 'bridge')""",
    "p5_masks": """with m as (select row_id, volume, sector, volume is null or not (isfinite(volume) and volume > 0) as v,
  sector is null or sector not in ('settlement', 'lending', 'gaming', 'storage', 'oracle', 'meme', 'privacy', 'bridge') as s from panel_clean)
select row_id, v as volume_was_missing, s as sector_was_missing, round(case when not v then volume end, 2) as volume, case when not s then sector end as sector, true as usable from m""",
    "p6_found": f"with {_SPIKES6} select field, row_id from f",
    "p6_kinds": f"with {_SPIKES6} select field, kind, count(*) as n from f group by 1, 2",
    "p3_found": f"with {_GRID3} select entity, strftime(date, '%Y%m%d')::bigint as date_key from g where not observed",
    "p3_daily_close": f"""with {_GRID3} select entity, strftime(date, '%Y%m%d')::bigint as date_key,
  format('{{:.9e}}', last_value(close ignore nulls) over w) as close,
  strftime(last_value(own ignore nulls) over w, '%Y%m%d')::bigint as read_key, observed
from g window w as (partition by entity order by date rows unbounded preceding)""",
    "p3_interpolated": f"""with {_GRID3}, n as (select *, last_value(close ignore nulls) over w as c0, last_value(own ignore nulls) over w as d0,
  first_value(close ignore nulls) over f as c1, first_value(own ignore nulls) over f as d1 from g
  window w as (partition by entity order by date rows unbounded preceding),
    f as (partition by entity order by date rows between current row and unbounded following))
select entity, strftime(date, '%Y%m%d')::bigint as date_key,
  format('{{:.9e}}', case when observed then close else c0 + (c1 - c0) * (date - d0) / (d1 - d0) end) as close, observed from n""",
    "p4_found": f"with {_KNOWN4} select obs_id, x.id as row_id from k",
    "p4_excess_with_cap": f"""with {_KNOWN4} select o.obs_id, round(o.ret_excess, 6) as ret_excess, round(k.x.cap, 2) as marketcap
from estimation_panel o join e on e.entity_id = o.entity left join k using (obs_id)""",
    "p7_found": f"""with {_LATEST7} select entity, strftime(date, '%Y%m%d')::bigint as date_key, 'volume' as measure from t
where date >= a + 29 and v7 / 7 > 3 * (v30 / 30)
union all select entity, strftime(date, '%Y%m%d')::bigint, 'ret' from t where date >= a + 29 and r30 < -2.0000005""",
    "p7_totals": f"""with {_LATEST7} select entity, strftime(date, '%Y%m%d')::bigint as date_key, active,
  round(v7, 0) + 0.0 as volume_sum_7, round(v30, 0) + 0.0 as volume_sum_30, round(r7, 6) + 0.0 as ret_sum_7,
  round(r30, 6) + 0.0 as ret_sum_30, round(r30 / 30, 9) + 0.0 as ret_avg_30 from t""",
}

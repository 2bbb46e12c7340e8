"""Queries of the operators in this subpackage, and their DuckDB counterparts."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.llm.mixing import mix
from panelmill.llm.packing import SHARD_ITEMS, pack
from panelmill.llm.percentiles import percentiles, value_runs
from panelmill.llm.skeleton import look_links, skeleton_of
from panelmill.llm.tokens import BLANK, WORD, token_count
from panelmill.llm.topn import top_n
from panelmill.operators.versions import latest_version
from panelmill.session import pinned, table

MEASURES = ["marketcap", "rvol_30d", "ret"]


def _months(spark: SparkSession, path: str) -> DataFrame:
    return table(spark, path, "characteristics").select(F.date_format("date", "yyyyMM").cast("long").alias("month_key"), "date", *MEASURES)


def p1_found(spark: SparkSession, path: str) -> DataFrame:
    got = percentiles(value_runs(_months(spark, path), ["month_key"], MEASURES), ["month_key"], [0.05, 0.25, 0.5])
    hit = (
        ((F.col("measure") == "marketcap") & (F.col("p") == 0.25) & (F.col("value") >= 1.5e8))
        | ((F.col("measure") == "rvol_30d") & (F.col("p") == 0.5) & (F.col("value") >= 0.06))
        | ((F.col("measure") == "ret") & (F.col("p") == 0.05) & (F.col("value") <= -0.15))
    )
    return got.filter(hit).select("month_key", "measure")


def p1_percentiles(spark: SparkSession, path: str) -> DataFrame:
    got = percentiles(value_runs(_months(spark, path), ["month_key"], MEASURES), ["month_key"], [0.05, 0.25, 0.5, 0.75, 0.95])
    return got.select("month_key", "measure", "p", "n", F.format_string("%.9e", "value").alias("value"))


def p1_combined(spark: SparkSession, path: str) -> DataFrame:
    """Monthly medians put together from partial results of separate days."""
    days = value_runs(_months(spark, path), ["date"], MEASURES, compact=True)
    runs = days.select(F.date_format("date", "yyyyMM").cast("long").alias("month_key"), "measure", "value", "n")
    got = percentiles(runs, ["month_key"], [0.5])
    return got.select("month_key", "measure", "n", F.format_string("%.9e", "value").alias("median"))


def _caps(spark: SparkSession, path: str) -> DataFrame:
    return latest_version(table(spark, path, "filtered_panel"), ["date", "entity"], ["loaded_at", "row_id"], keep=["marketcap"])


def p2_found(spark: SparkSession, path: str) -> DataFrame:
    top = top_n(_caps(spark, path), ["date"], "marketcap", ["entity"], 5)
    return top.select(F.date_format("date", "yyyyMMdd").cast("long").alias("date_key"), "entity")


def p2_top_ten(spark: SparkSession, path: str) -> DataFrame:
    top = top_n(_caps(spark, path), ["date"], "marketcap", ["entity"], 10)
    return top.select("date", "rank", "entity", F.round("marketcap", 2).alias("marketcap"))


def _sized(spark: SparkSession, path: str) -> DataFrame:
    return table(spark, path, "documents").select("doc_id", "source", token_count("text").alias("tokens"))


def p8_found(spark: SparkSession, path: str) -> DataFrame:
    return pack(_sized(spark, path), "doc_id", F.col("tokens")).filter("piece = 1").select("doc_id")


def p8_containers(spark: SparkSession, path: str) -> DataFrame:
    return pack(_sized(spark, path), "doc_id", F.col("tokens"))


def p8_fill(spark: SparkSession, path: str) -> DataFrame:
    """Containers, tokens and capacity by container length."""
    boxes = pack(_sized(spark, path), "doc_id", F.col("tokens")).groupBy("container").agg(F.max("capacity").alias("capacity"), F.sum("size").alias("tokens"))
    return boxes.groupBy("capacity").agg(F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"), F.sum("capacity").alias("room"))


def p8_audit(spark: SparkSession, path: str) -> DataFrame:
    """Each document's pieces and tokens as they were placed, and whether its pieces follow one another, each a container's length but the last."""
    placed = pack(_sized(spark, path), "doc_id", F.col("tokens"))
    last = F.max("piece")
    whole = (F.count(F.lit(1)) == last + 1) & (F.count_distinct("piece") == last + 1) & (F.min("piece") == 0)
    cut = F.bool_and((F.col("first") == F.col("piece") * 2048) & (F.col("offset") + F.col("size") <= F.col("capacity")))
    return placed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("size").alias("tokens"), (whole & cut).alias("in_order"))


def p8_totals(spark: SparkSession, path: str) -> DataFrame:
    """What all containers hold: no two pieces overlap, none is over its capacity, and their number is near the least possible."""
    placed = pack(_sized(spark, path), "doc_id", F.col("tokens"))
    boxes = placed.groupBy("container").agg(
        F.sum("size").alias("tokens"), F.count(F.lit(1)).alias("pieces"), F.max(F.col("offset") + F.col("size")).alias("end"), F.max("capacity").alias("capacity")
    )
    got = boxes.agg(
        F.sum("pieces").alias("pieces"), F.sum("tokens").alias("tokens"), F.count_if(F.col("tokens") > F.col("capacity")).alias("overfull"),
        F.count_if(F.col("end") != F.col("tokens")).alias("with_gaps"), F.count(F.lit(1)).alias("n"),
    )
    shards = F.ceil(F.col("pieces") / SHARD_ITEMS)
    near = F.col("n") <= F.ceil(F.col("tokens") / 2048) * 1.02 + 4 * shards
    return got.select("pieces", "tokens", "overfull", "with_gaps", near.alias("near_least"))


def p9_found(spark: SparkSession, path: str) -> DataFrame:
    report = mix(_sized(spark, path), "doc_id", "source", F.col("tokens"), table(spark, path, "mix_targets"))[1]
    return report.filter("short").select("source")


def _report(spark: SparkSession, path: str, places: int, **more) -> DataFrame:
    report = mix(_sized(spark, path), "doc_id", "source", F.col("tokens"), table(spark, path, "mix_targets"), **more)[1]
    r = lambda c, n: (F.round(c, n) + F.lit(0.0)).alias(c)
    return report.select("source", r("weight", 6), "max_repeats", "available", r("wanted", 3), r("target", 3), r("share", places), "short")


def p9_shares(spark: SparkSession, path: str) -> DataFrame:
    """Wanted and target amounts of each source, and the shares reached, to a thousandth."""
    return _report(spark, path, 3)


def p9_exact_shares(spark: SparkSession, path: str) -> DataFrame:
    """The same of the largest mix in which every source has its weight; shares to a hundredth, as that mix is much smaller."""
    return _report(spark, path, 2, keep_weights=True)


def p9_copies(spark: SparkSession, path: str) -> DataFrame:
    """Of each source how often its documents are used at least and at most, whether any is used more than it may or listed twice,
    and whether the amount reached is within the largest document of the target."""
    sized, targets = _sized(spark, path), table(spark, path, "mix_targets")
    selection, report = mix(sized, "doc_id", "source", F.col("tokens"), targets)
    used = sized.filter("tokens > 0").join(selection.select("doc_id", "copies"), "doc_id", "left").groupBy("source").agg(
        F.min(F.coalesce("copies", F.lit(0))).cast("int").alias("least"), F.max(F.coalesce("copies", F.lit(0))).cast("int").alias("most"),
        F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("documents"), F.max("tokens").alias("largest"),
    )
    rows = report.join(used, "source")
    over, listed = F.col("most") > F.col("max_repeats"), F.col("n") > F.col("documents")
    near = F.abs(F.col("reached") - F.col("target")) <= F.col("largest")
    return rows.select("source", "least", "most", over.alias("over"), listed.alias("listed_twice"), near.alias("near"))


def p9_selection(spark: SparkSession, path: str) -> DataFrame:
    return mix(_sized(spark, path), "doc_id", "source", F.col("tokens"), table(spark, path, "mix_targets"))[0]


def p10_found(spark: SparkSession, path: str) -> DataFrame:
    """The classes of texts that look the same, spread into pairs of documents whose texts differ.

    The operator gives classes; only those with links are spread here, form by form, so copies aren't paired with each other.
    """
    rows = pinned(look_links(table(spark, path, "documents"), "doc_id", "text").filter("links > 0").select("doc_id", "look", "form"))
    forms = rows.select("look", "form").distinct()
    pairs = forms.alias("l").join(forms.alias("r"), (F.col("l.look") == F.col("r.look")) & (F.col("l.form") < F.col("r.form")))
    pairs = pairs.select(F.col("l.look").alias("look"), F.col("l.form").alias("f"), F.col("r.form").alias("g"))
    left = rows.select("look", F.col("form").alias("f"), F.col("doc_id").alias("x"))
    right = rows.select("look", F.col("form").alias("g"), F.col("doc_id").alias("y"))
    both = pairs.join(left, ["look", "f"]).join(right, ["look", "g"])
    return both.select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"))


def p10_classes(spark: SparkSession, path: str) -> DataFrame:
    """Each document with its class of texts that look the same, and how many of these differ from it in characters."""
    return look_links(table(spark, path, "documents"), "doc_id", "text").select("doc_id", "class_id", "members", "copies", "links")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p1_found, p1_percentiles, p1_combined, p2_found, p2_top_ten, p8_found, p8_containers, p8_fill, p8_audit, p8_totals,
        p9_found, p9_shares, p9_exact_shares, p9_copies, p9_selection, p10_found, p10_classes,
    )
}

_LONG = """l as (select strftime(date, '%Y%m')::bigint as month_key, unnest(['marketcap', 'rvol_30d', 'ret']) as measure,
  unnest([marketcap, rvol_30d, ret]) as v from characteristics),
v as (select * from l where v is not null and not isnan(v))"""
_CAPS = """f as (select date, entity, arg_max(coalesce(marketcap, 'nan'::double), {'a': loaded_at, 'b': row_id}) as marketcap
  from filtered_panel group by 1, 2),
r as (select *, row_number() over (partition by date order by marketcap desc, entity) as rank from f where not isnan(marketcap))"""
_TOKENS = f"coalesce(len(regexp_extract_all(text, '[{WORD}]+|[^{WORD}{BLANK}]+')), 0)"



def _plain_sql() -> str:
    """The one form of a text in SQL: composed, each character that the table and the rules replace translated, composed again.

    Made from what single characters become, so it is a check on how the operator treats texts, not on the table.
    """
    moved = {}
    for cp in [*range(0x80, 0xD800), *range(0xE000, 0x10000), *range(0xE0000, 0xE0200), 0x1D173, *range(0x1D174, 0x1D17B), *range(0x1BCA0, 0x1BCA4), *range(0x110BD, 0x110CE)]:
        to = unicodedata.normalize("NFC", skeleton_of(chr(cp)))
        if to != unicodedata.normalize("NFC", chr(cp)):
            moved[chr(cp)] = to
    one = {c: to for c, to in moved.items() if len(to) == 1}
    gone = [c for c, to in moved.items() if not to]
    text = "nfc_normalize(text)"
    for c, to in moved.items():
        if len(to) > 1:
            text = f"replace({text}, '{c}', '{to}')"
    quoted = lambda t: t.replace("'", "''")
    return f"nfc_normalize(translate({text}, '{quoted(''.join([*one, *gone]))}', '{quoted(''.join(one.values()))}'))"


_LOOKS = f"""d as (select doc_id, text, {_plain_sql()} as look from documents where text is not null),
c as (select *, min(doc_id) over (partition by look) as class_id, count(*) over (partition by look) as members, count(*) over (partition by look, text) as copies from d)"""

# Water filling in closed form: sources in order of cap by weight; the first k give all they can, the others share the rest by weight.
def _fill(total: str) -> str:
    return f"""d as (select source, {_TOKENS} as n from documents), a as (select sum(n) as whole from d), s as (select source, sum(n) as own from d group by 1),
m0 as (select m.source, weight / sum(weight) over () as weight, max_repeats, coalesce(own, 0)::bigint as available, max_repeats * coalesce(own, 0) as cap,
  whole from mix_targets m cross join a left join s using (source)),
m1 as (select *, weight * whole as wanted, cap < weight * whole as short, {total} as total from m0),
m2 as (select *, row_number() over (order by cap / weight, source) as k, coalesce(sum(cap) over before, 0) as full_cap, sum(weight) over after as rest from m1
  window before as (order by cap / weight, source rows between unbounded preceding and 1 preceding), after as (order by cap / weight, source rows between current row and unbounded following)),
l as (select min(k) as k from m2 where (total - full_cap) / rest <= cap / weight), v as (select (total - full_cap) / rest as level, m2.k from m2 join l on m2.k = l.k),
t as (select m2.*, case when m2.k >= v.k then level * weight else cap end as target from m2 left join v on true)"""


_SHARES = """select source, round(weight, 6) + 0.0 as weight, max_repeats, available, round(wanted, 3) + 0.0 as wanted, round(target, 3) + 0.0 as target,
  round(target / sum(target) over (), 3) + 0.0 as share, short from t"""

ORACLES: dict[str, str] = {
    "p9_shares": f"with {_fill('whole')} {_SHARES}",
    "p9_exact_shares": f"with {_fill('min(least(whole, cap / weight)) over ()')} {_SHARES.replace('over (), 3)', 'over (), 2)')}",
    "p9_copies": f"""with {_fill('whole')} select source, floor(least(target / available, max_repeats))::int as least, ceil(target / available)::int as most,
  false as over, false as listed_twice, true as near from t""",
    "p10_classes": f"with {_LOOKS} select doc_id, class_id, members, copies, members - copies as links from c",
    "p10_found": f"with {_LOOKS} select a.doc_id as doc_a, b.doc_id as doc_b from c a join c b on a.look = b.look and a.text <> b.text and a.doc_id < b.doc_id",
    "p1_found": f"""with {_LONG}, q as (select month_key, measure, quantile_cont(v, 0.05) as p05, quantile_cont(v, 0.25) as p25,
  quantile_cont(v, 0.5) as p50 from v group by 1, 2)
select month_key, measure from q where (measure = 'marketcap' and p25 >= 1.5e8) or (measure = 'rvol_30d' and p50 >= 0.06)
  or (measure = 'ret' and p05 <= -0.15)""",
    "p1_percentiles": f"""with {_LONG}, q as (select month_key, measure, count(*) as n, unnest([0.05, 0.25, 0.5, 0.75, 0.95]::double[]) as p,
  unnest(quantile_cont(v, [0.05, 0.25, 0.5, 0.75, 0.95])) as value from v group by 1, 2)
select month_key, measure, p, n, format('{{:.9e}}', value) as value from q""",
    "p1_combined": f"""with {_LONG} select month_key, measure, count(*) as n, format('{{:.9e}}', quantile_cont(v, 0.5)) as median
from v group by 1, 2""",
    "p2_found": f"with {_CAPS} select strftime(date, '%Y%m%d')::bigint as date_key, entity from r where rank <= 5",
    "p2_top_ten": f"with {_CAPS} select date, rank::int as rank, entity, round(marketcap, 2) as marketcap from r where rank <= 10",
    "p8_found": f"select doc_id from documents where {_TOKENS} > 2048",
    "p8_audit": f"""select doc_id, greatest(1, ceil(n / 2048.0))::bigint as pieces, n as tokens, true as in_order from (select doc_id, {_TOKENS} as n from documents)""",
    "p8_totals": f"""select sum(greatest(1, ceil(n / 2048.0)))::bigint as pieces, sum(n)::bigint as tokens, 0::bigint as overfull, 0::bigint as with_gaps, true as near_least
from (select doc_id, {_TOKENS} as n from documents)""",
    "p9_found": f"""with d as (select source, {_TOKENS} as n from documents), a as (select sum(n) as whole from d),
s as (select source, sum(n) as own from d group by 1)
select m.source from mix_targets m cross join a left join s using (source) where m.max_repeats * coalesce(own, 0) < m.weight * whole""",
}

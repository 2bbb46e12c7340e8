"""Readers and writers of the file formats the panel comes in and goes out as."""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.session import ensure_checkpoint_dir, pinned

# The fields of the landed JSON documents.
ENTITY_FIELDS = "symbol string, name string, shortname string, market_cap_rank int, trading_since long, last_market_cap_usd double"
HISTORY_FIELDS = (
    "time_start string, price_open_usd double, price_close_usd double, price_high_usd double, price_low_usd double, volume_usd double, market_cap_usd double"
)


def entity_list(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """The entity list of landed documents ``{"data": [{...}]}``, distinct, its epoch seconds turned into dates.

    Documents that cannot be read are left out, as a failed request would be.
    """
    docs = spark.read.schema(f"data array<struct<{ENTITY_FIELDS.replace(' ', ':').replace(',:', ',')}>>").json(paths, mode="PERMISSIVE", multiLine=False)
    rows = docs.select(F.explode("data").alias("d")).select("d.*").distinct()
    return rows.withColumn("trading_since", F.to_date(F.timestamp_seconds("trading_since")))


def histories(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Daily rows of landed history documents ``<entity>.json``: renamed, projected, and only where all sizes are above 0.

    Any number of files or folders are read together; unreadable ones are left out.
    """
    docs = spark.read.schema(f"data array<struct<{HISTORY_FIELDS.replace(' ', ':').replace(',:', ',')}>>").json(paths, mode="PERMISSIVE")
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.json[^/]*$", 1)
    rows = docs.select(F.coalesce(F.regexp_extract(F.input_file_name(), r"entity=([^/]+)/", 1), name).alias("e"), name.alias("n"), F.explode("data").alias("d"))
    return rows.select(
        F.to_date(F.substring("d.time_start", 1, 10)).alias("date"),
        F.when(F.col("e") != "", F.url_decode("e")).otherwise(F.col("n")).alias("entity"),
        F.col("d.price_open_usd").alias("open"), F.col("d.price_close_usd").alias("close"), F.col("d.price_high_usd").alias("high"),
        F.col("d.price_low_usd").alias("low"), F.col("d.volume_usd").alias("volume"), F.col("d.market_cap_usd").alias("marketcap"),
    ).filter("close > 0 and volume > 0 and marketcap > 0")


def names(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(entity): the distinct lines of text files; blanks around a name and empty lines are dropped."""
    lines = spark.read.text(paths).select(F.trim("value").alias("entity"))
    return lines.filter("entity <> ''").distinct()


def csv(spark: SparkSession, paths: str | Sequence[str], schema: str) -> DataFrame:
    return spark.read.csv(paths, schema=schema, header=True)


def keyed_csv(spark: SparkSession, glob: str, schema: str, pattern: str = r"^(\d+)_", key: str = "k") -> DataFrame:
    """CSV files with a number in the name: folder or file names that match ``pattern`` give column ``key``."""
    inner = re.sub(r"^\^", "", pattern)
    return csv(spark, glob, schema).withColumn(key, F.regexp_extract(F.input_file_name(), f"/{inner}[^/]*(?:/[^/]*)?$", 1).cast("int"))


def epoch_series(df: DataFrame, millis: str, date: str = "date") -> DataFrame:
    """A series keyed by epoch milliseconds, keyed by date instead."""
    return df.withColumn(date, F.to_date(F.timestamp_millis(millis))).drop(millis)


def append(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows of several frames by column name; missing columns are null, a missing frame (None) is skipped."""
    frames = [f for f in frames if f is not None]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def write_names(df: DataFrame, path: str, col: str = "shortname") -> None:
    df.select(F.col(col).cast("string")).filter(F.col(col).isNotNull()).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_table(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """Parquet, optionally in folders by the given columns."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def latex(df: DataFrame, most: int = 1000) -> str:
    """A LaTeX table of a small result; more than ``most`` rows raise."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    safe = lambda v: "" if v is None else re.sub(r"([&%$#_{}])", r"\\\1", f"{v:,.4f}" if isinstance(v, float) else f"{v:,}" if isinstance(v, int) else str(v))
    line = lambda cells: " & ".join(map(safe, cells)) + r" \\"
    body = [line(df.columns), r"\midrule", *[line(r) for r in rows]]
    return "\n".join([rf"\begin{{tabular}}{{{'l' + 'r' * (len(df.columns) - 1)}}}", r"\toprule", *body, r"\bottomrule", r"\end{tabular}"])


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/files-{uuid.uuid4().hex}"


def taken(df: DataFrame, path: str) -> DataFrame:
    """The rows of ``df``, pinned, after which the folder ``path`` they were read from is deleted."""
    spark = df.sparkSession
    rows = pinned(df)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return rows

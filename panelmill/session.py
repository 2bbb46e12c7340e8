"""Session set-up, checkpoints and size-checked broadcasts."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Most bytes of a table that may be broadcast, as ``byte_size`` counts them.
BROADCAST_BYTES = 32 << 20
ROW_BYTES = 16  # what a row costs besides its values


def get_spark(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the operators are tested with."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("panelmill")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Rolling frames are heavy for their bytes: don't merge partitions until few tasks are left.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.compress", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder of ``spark.checkpoint.dir``. Where none is set a local session gets a temporary one; a cluster
    session raises, as a folder of one machine is no place the others can read."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="panelmill-cp-"))


def pinned(df: DataFrame) -> DataFrame:
    """The rows of ``df`` written to the shared checkpoint folder.

    Later passes read the same rows in the same partitions and order, also after an executor is lost.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def within(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows."""
    return df.limit(rows + 1).count() <= rows


def _value_bytes(value: Column, kind: T.DataType) -> Column:
    """Bytes of one value: eight for a number, the length of a text, the sum of its parts for anything nested."""
    if isinstance(kind, T.StringType | T.BinaryType):
        size = F.octet_length(value)
    elif isinstance(kind, T.StructType):
        size = sum((_value_bytes(value[f.name], f.dataType) for f in kind.fields), F.lit(0))
    elif isinstance(kind, T.ArrayType | T.MapType):
        size = F.octet_length(F.to_json(value))
    else:
        size = F.lit(8)
    return F.coalesce(size, F.lit(0)).cast("long")


def byte_size(df: DataFrame) -> int:
    """Bytes of the rows of ``df``, summed up where they are; ``df`` should be pinned."""
    each = sum((_value_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(ROW_BYTES).cast("long"))
    return df.agg(F.sum(each)).first()[0] or 0


def same(left: DataFrame, right: DataFrame, cols: Sequence[str]):
    """Null-safe equality of the columns of two frames."""
    cond = F.lit(True)
    for c in cols:
        cond = cond & left[c].eqNullSafe(right[c])
    return cond


def attach(big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "left", most: int = BROADCAST_BYTES) -> DataFrame:
    """Join columns of ``small`` (one row per key) to ``big``, null keys matching null keys.

    ``small`` is pinned and its bytes are summed up first. It is broadcast up to ``most`` bytes; beyond that the join is a
    shuffle join, which adaptive execution splits where a key of ``big`` is hot.
    """
    small = pinned(small)
    keys = {c: f"_{c}_key" for c in on}
    right = small.withColumnsRenamed(keys)
    right = F.broadcast(right) if byte_size(small) <= most else right.hint("shuffle_merge")
    cond = F.lit(True)
    for c, k in keys.items():
        cond = cond & big[c].eqNullSafe(right[k])
    return big.join(right, cond, how).drop(*keys.values())


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{path}/{name}.parquet")

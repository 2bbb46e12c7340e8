"""One row per key out of several versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_version(df: DataFrame, keys: Sequence[str], by: Sequence[str | Column], keep: Sequence[str] | None = None) -> DataFrame:
    """Of the rows of each key the one that is last in the order ``by``.

    An aggregate, not a window: versions are reduced before the shuffle, so a key with very many rows is no burden.
    Nulls in ``by`` come first, i.e. lose. Null keys form one key. Rows equal in all of ``by`` are ties; end ``by`` with
    a unique column for a fixed choice. ``keep``: columns to return besides the keys (default all others).
    """
    keep = [c for c in (keep or df.columns) if c not in keys]
    order = F.struct(*[F.col(c) if isinstance(c, str) else c for c in by])
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*keep), order).alias("_best"))
    return best.select(*keys, *[F.col("_best")[c].alias(c) for c in keep])

"""Rolling frames per entity and the rules for nulls in them.

Every rolling value is emitted only where the entity has at least n rows up to the current one (a complete window, counted in
rows). ``strict`` values are null if any input in the frame is; the others skip nulls. The panel has one row per (entity,
date), so an entity is never larger than the calendar, whatever the number of raw readings behind it.
"""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

ENTITY, DATE = "entity", "date"


def along() -> WindowSpec:
    """An entity's rows in order of date."""
    return Window.partitionBy(ENTITY).orderBy(DATE)


def frame(back: int, upto: int = 0) -> WindowSpec:
    """Rows from ``back`` before the current one to ``upto`` (0: the current one, -1: the one before)."""
    return along().rowsBetween(-back, upto)


def complete(n: int, value: Column) -> Column:
    return F.when(F.row_number().over(along()) >= n, value)


def rolling(value: Column, agg, n: int, lag: int = 0, of: int | None = None) -> Column:
    """``agg`` over the n rows that end ``lag`` rows before the current one; complete from ``of`` rows on (default n + lag)."""
    return complete(of or n + lag, agg(value).over(frame(n + lag - 1, -lag)))


def strict(value: Column, agg, n: int, lag: int = 0) -> Column:
    """``agg`` over the n rows that end ``lag`` rows before the current one, null if any of them is missing or null.

    A frame that counts n values has n rows, so no row number is needed to tell that the window is complete.
    """
    w = frame(n + lag - 1, -lag)
    return F.when(F.count(value).over(w) == n, agg(value).over(w))


def compound(ret: Column, n: int, lag: int = 0) -> Column:
    """Return over n rows that end ``lag`` rows before the current one; null returns are skipped."""
    return rolling(1 + ret, F.product, n, lag) - 1


def log(x: Column) -> Column:
    """Natural logarithm, null where it isn't a number."""
    return F.when(x > 0, F.ln(x))


def positive(c: str) -> Column:
    """The value if it is a finite number above 0, else null."""
    return F.when((F.col(c) > 0) & (F.col(c) < float("inf")), F.col(c))

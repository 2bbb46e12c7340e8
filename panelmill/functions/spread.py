"""The published EDGE estimator of the bid-ask spread, over a rolling frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmill.functions.frames import along, complete, frame


def edge_frame(df: DataFrame, n: int) -> DataFrame:
    """Add ``bidask`` from the log prices _o, _h, _l, _c, which are dropped. Rows with a missing price don't count.

    Of the n rows the first only lends its prices to the second. Null if fewer than two rows moved or the prices never
    differ from the extremes.
    """
    c = F.col
    df = df.withColumns({f"_{k}1": F.lag(f"_{k}").over(along()) for k in "hlc"})
    mid, mid1 = (c("_h") + c("_l")) / 2, (c("_h1") + c("_l1")) / 2
    moved = F.when((c("_h") != c("_l")) | (c("_l") != c("_c1")), 1.0).otherwise(0.0)
    flag = lambda cond: F.when(cond, 1.0).otherwise(0.0)
    terms = F.struct(
        (mid - c("_o")).alias("r1"), (c("_o") - mid1).alias("r2"), (mid - c("_c1")).alias("r3"), (c("_c1") - mid1).alias("r4"),
        (c("_o") - c("_c1")).alias("r5"), moved.alias("t"), (moved * flag(c("_o") != c("_h"))).alias("oh"), (moved * flag(c("_o") != c("_l"))).alias("ol"),
        (moved * flag(c("_c1") != c("_h1"))).alias("ch"), (moved * flag(c("_c1") != c("_l1"))).alias("cl"),
    )
    full = (c("_o") + c("_h") + c("_l") + c("_c") + c("_h1") + c("_l1") + c("_c1")).isNotNull()
    df = df.withColumn("_x", F.when(full, terms)).withColumn("_rows", complete(n, F.collect_list("_x").over(frame(n - 2))))

    def field(k: str):
        return lambda v: v[k]

    def mean(f, rows: str = "_rows") -> Column:
        return F.try_divide(F.aggregate(F.transform(rows, f), F.lit(0.0), lambda a, v: a + v), F.size(rows))

    def square_of(k: str, centre: str):
        return lambda v: (v[k] - c(centre)) * (v[k] - c(centre))

    df = df.withColumn(
        "_m",
        F.struct(
            *[mean(field(k)).alias(k) for k in ("r1", "r3", "r5", "t")],
            (mean(field("oh")) + mean(field("ol"))).alias("po"), (mean(field("ch")) + mean(field("cl"))).alias("pc"),
            F.aggregate(F.transform("_rows", field("t")), F.lit(0.0), lambda a, v: a + v).alias("n"),
        ),
    )
    m = lambda k: c(f"_m.{k}")
    lean = lambda v, k: v[k] - v["t"] * F.try_divide(m(k), m("t"))

    def pair(v: Column, late: str, other: str) -> Column:
        return F.try_divide(F.lit(-4.0), m("po")) * lean(v, "r1") * v["r5" if late == "r5" else "r2"] + F.try_divide(F.lit(-4.0), m("pc")) * lean(v, other) * v["r4"]

    df = df.withColumn("_xs", F.transform("_rows", lambda v: F.struct(pair(v, "r2", "r3").alias("a"), pair(v, "r5", "r5").alias("b"))))
    df = df.withColumns({"_e1": mean(field("a"), "_xs"), "_e2": mean(field("b"), "_xs")})
    df = df.withColumns({"_v1": mean(square_of("a", "_e1"), "_xs"), "_v2": mean(square_of("b", "_e2"), "_xs")})
    both = c("_v1") + c("_v2")
    square = F.when(both > 0, F.try_divide(c("_v2") * c("_e1") + c("_v1") * c("_e2"), both)).otherwise((c("_e1") + c("_e2")) / 2)
    ok = (m("n") >= 2) & (m("po") > 0) & (m("pc") > 0)
    df = df.withColumn("bidask", F.when(ok, F.sqrt(F.abs(square))))
    return df.drop("_o", "_h", "_l", "_c", "_h1", "_l1", "_c1", "_x", "_rows", "_m", "_xs", "_e1", "_e2", "_v1", "_v2")

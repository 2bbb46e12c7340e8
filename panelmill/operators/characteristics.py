"""The rolling characteristics of an (entity, date) panel.

Each group of columns is a function from a panel with (entity, date, open, high, low, close, volume, marketcap, ret[, ret_excess,
cmkt]) to the panel with its columns added. All frames share one partitioning and sort order, so a whole set of groups costs
one shuffle. Windows that are short of rows, degenerate or (where the rule is strict) incomplete give null.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmill.functions.frames import along, complete, compound, frame, log, strict
from panelmill.functions.spread import edge_frame
from panelmill.operators.market import value_weighted
from panelmill.session import attach

c = F.col


def size(df: DataFrame) -> DataFrame:
    return df.withColumns({"mcap": log(c("marketcap")), "prc": log(c("close")), "maxdprc": strict(c("close"), F.max, 7)})


def momentum(df: DataFrame) -> DataFrame:
    cols = {f"r{n}_0": compound(c("ret"), n) for n in (7, 14, 21, 30)}
    cols |= {"r30_14": compound(c("ret"), 16, 14), "r180_60": compound(c("ret"), 120, 60)}
    return df.withColumns(cols | {"dh90": F.try_divide(c("close"), strict(c("close"), F.max, 90))})


def volume(df: DataFrame) -> DataFrame:
    traded, scaled = c("close") * c("volume"), F.try_divide(c("close") * c("volume"), c("marketcap"))
    df = df.withColumns(
        {
            "volume_7d": strict(c("volume"), F.avg, 7),
            "volume_30d": strict(c("volume"), F.avg, 30),
            "prcvol": log(strict(traded, F.avg, 7)),
            "volscaled": log(strict(scaled, F.avg, 7)),
        }
    )
    return df.withColumn("logvol", log(c("volume_7d")))


def _products(df: DataFrame, names: tuple[str, ...], w) -> tuple[DataFrame, Column, dict]:
    """Add windowed sums of columns _<name> and of their products; plain sums are the cheapest frames there are.

    Returns the frame, the count and, by pair of names, the centred sums of products. The columns must be null together.
    """
    pairs = [(i, j) for k, i in enumerate(names) for j in names[k:]]
    sums = {"_n": F.count(f"_{names[0]}").over(w)} | {f"_s{k}": F.sum(f"_{k}").over(w) for k in names}
    df = df.withColumns(sums | {f"_s{i}{j}": F.sum(c(f"_{i}") * c(f"_{j}")).over(w) for i, j in pairs})
    centred = {f"_v{i}{j}": c(f"_s{i}{j}") - F.try_divide(c(f"_s{i}") * c(f"_s{j}"), c("_n")) for i, j in pairs}
    return df.withColumns(centred), c("_n"), {(i, j): c(f"_v{i}{j}") for i, j in pairs}


def _without_products(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    pairs = [f"_{what}{i}{j}" for what in "sv" for k, i in enumerate(names) for j in names[k:]]
    return df.drop("_n", *[f"_{k}" for k in names], *[f"_s{k}" for k in names], *pairs)


def capm(df: DataFrame, n: int = 30) -> DataFrame:
    """alpha, beta, ivol and beta2 of ret_excess on cmkt over n rows, from complete pairs."""
    names = ("y", "x")
    both = c("ret_excess").isNotNull() & c("cmkt").isNotNull()
    df = df.withColumns({"_y": F.when(both, c("ret_excess")), "_x": F.when(both, c("cmkt"))})
    df, pairs, v = _products(df, names, frame(n - 1))
    ok = (pairs > 2) & (v["x", "x"] > 1e-18)
    slope = F.try_divide(v["y", "x"], v["x", "x"])
    left = v["y", "y"] - slope * v["y", "x"]
    df = df.withColumns(
        {
            "alpha": complete(n, F.when(ok, F.try_divide(c("_sy") - slope * c("_sx"), pairs))),
            "beta": complete(n, F.when(ok, slope)),
            "ivol": complete(n, F.when(ok, F.sqrt(F.greatest(left, F.lit(0.0)) / (pairs - 1)))),
        }
    )
    return _without_products(df, names).withColumn("beta2", F.pow("beta", F.lit(2.0)))


def yang_zhang(n: int) -> Column:
    """Volatility from open, high, low and close over n rows, of which the first only lends its close."""
    last = F.lag("close").over(along())
    over, up, down, day = log(c("open") / last), log(c("high") / c("open")), log(c("low") / c("open")), log(c("close") / c("open"))
    w = frame(n - 2)
    whole = (F.count(over).over(w) == n - 1) & (F.count(up * down * day).over(w) == n - 1)
    k = 0.34 / (1.34 + (n + 1) / (n - 1))
    rs = F.avg(up * (up - day) + down * (down - day)).over(w)
    var = F.var_samp(over).over(w) + k * F.var_samp(day).over(w) + (1 - k) * rs
    return complete(n, F.when(whole & (var >= 0), F.sqrt(var)))


def risk(df: DataFrame) -> DataFrame:
    """rvol_7d, rvol_30d, retvol, stdprcvol, var and es_5."""
    df = df.withColumns(
        {
            "rvol_7d": yang_zhang(7),
            "rvol_30d": yang_zhang(30),
            "retvol": strict(c("ret"), F.stddev_samp, 7),
            "stdprcvol": log(strict(c("close") * c("volume"), F.stddev_samp, 7)),
            "_seen": complete(90, F.sort_array(F.collect_list("ret").over(frame(89)))),
        }
    )
    df = df.withColumn("var", sorted_quantile("_seen", 0.05))
    low = F.filter("_seen", lambda v: v <= c("var"))
    total = F.aggregate(low, F.lit(0.0), lambda a, v: a + v)
    return df.withColumn("es_5", F.try_divide(total, F.size(low))).drop("_seen")


def sorted_quantile(values: str, p: float) -> Column:
    """Linear quantile of a sorted array, null for an empty one."""
    at = (F.size(values) - 1) * F.lit(p)
    k = F.floor(at).cast("int")
    lo, hi = F.get(values, k), F.get(values, F.ceil(at).cast("int"))
    return F.when(F.size(values) > 0, lo + (hi - lo) * (at - k))


def delay(df: DataFrame, n: int = 30) -> DataFrame:
    """How much of ret_excess two more lags of the market explain: R2(x, x1, x2) - R2(x), from complete rows."""
    x1, x2 = F.lag("cmkt", 1).over(along()), F.lag("cmkt", 2).over(along())
    full = c("ret_excess").isNotNull() & c("cmkt").isNotNull() & x1.isNotNull() & x2.isNotNull()
    names = ("y", "a", "b", "d")
    df = df.withColumns({f"_{k}": F.when(full, v) for k, v in zip(names, (c("ret_excess"), c("cmkt"), x1, x2))})
    df, count, v = _products(df, names, frame(n - 3))
    aa, bb, dd, ab, ad, bd = (v[p] for p in (("a", "a"), ("b", "b"), ("d", "d"), ("a", "b"), ("a", "d"), ("b", "d")))
    ya, yb, yd, yy = (v[p] for p in (("y", "a"), ("y", "b"), ("y", "d"), ("y", "y")))
    # Inverse of the symmetric 3 x 3 matrix by its adjugate.
    m11, m12, m13 = bb * dd - bd * bd, ad * bd - ab * dd, ab * bd - ad * bb
    m22, m23, m33 = aa * dd - ad * ad, ab * ad - aa * bd, aa * bb - ab * ab
    det = aa * m11 + ab * m12 + ad * m13
    quad = ya * ya * m11 + yb * yb * m22 + yd * yd * m33 + 2 * (ya * yb * m12 + ya * yd * m13 + yb * yd * m23)
    ok = (count > 4) & (yy > 1e-16) & (aa > 1e-16) & (det > 1e-9 * aa * bb * dd)
    value = F.try_divide(F.try_divide(quad, det) - F.try_divide(ya * ya, aa), yy)
    return _without_products(df.withColumn("delay", complete(n, F.when(ok, value))), names)


def liquidity(df: DataFrame) -> DataFrame:
    """Each frame is taken once; what several columns need of it is shared."""
    df = df.withColumn("turn", F.try_divide(F.lag("volume").over(along()), c("marketcap")))
    before = partial(strict, c("turn"), n=30, lag=1)
    df = df.withColumns(
        {
            "illiq": strict(F.try_divide(F.abs("ret"), c("volume")), F.avg, 90),
            "turn_7d": strict(c("turn"), F.avg, 7),
            "std_turn": strict(c("turn"), F.stddev_samp, 30),
            "_sd30": strict(c("volume"), F.stddev_samp, 30),
            "_avg30": strict(c("volume"), F.avg, 30),
            "_avg15": strict(c("volume"), F.avg, 15),
            "sat": F.try_divide(F.lag("turn").over(along()) - before(F.avg), before(F.stddev_samp)),
        }
    )
    return df.withColumns(
        {
            "std_vol": log(c("_sd30")),
            "cv_vol": F.try_divide("_sd30", "_avg30"),
            "volsh_15d": log(c("volume")) - log(c("_avg15")),
            "volsh_30d": log(c("volume")) - log(c("_avg30")),
        }
    ).drop("_sd30", "_avg30", "_avg15")


def detrended_turnover(df: DataFrame, n: int = 90) -> DataFrame:
    """dto: turnover over the market's, less its rolling median. Needs turn."""
    market = value_weighted(df, ["date"], "turn", name="_market_turn")
    df = attach(df, market, ["date"]).withColumn("_over", c("turn") - c("_market_turn"))
    df = df.withColumn("_seen", complete(n, F.sort_array(F.collect_list("_over").over(frame(n - 1)))))
    return df.withColumn("dto", c("_over") - sorted_quantile("_seen", 0.5)).drop("_market_turn", "_over", "_seen")


def distribution(df: DataFrame, raw_kurtosis: bool = False) -> DataFrame:
    """Population skewness and excess kurtosis (``raw_kurtosis``: not less 3), greatest and least return over 7 and 30 rows."""
    frames = {n: frame(n - 1) for n in (7, 30)}
    shapes = {"skew": F.skewness, "kurt": F.kurtosis, "maxret": F.max, "minret": F.min}
    counts = {f"_seen{n}": F.count("ret").over(w) for n, w in frames.items()}
    df = df.withColumns(counts | {f"{k}_{n}d": agg("ret").over(w) for n, w in frames.items() for k, agg in shapes.items()})
    more = {"kurt": 3.0 if raw_kurtosis else 0.0}
    return df.withColumns(
        {f"{k}_{n}d": F.when(c(f"_seen{n}") == n, c(f"{k}_{n}d") + more.get(k, 0.0)) for n in frames for k in shapes}
    ).drop(*counts)


def bid_ask(df: DataFrame, n: int = 30) -> DataFrame:
    """Spread estimated from open, high, low and close over n rows."""
    return df.withColumns({"_o": log(c("open")), "_h": log(c("high")), "_l": log(c("low")), "_c": log(c("close"))}).transform(
        lambda d: edge_frame(d, n)
    )


GROUPS = {f.__name__: f for f in (size, momentum, volume, capm, risk, delay, liquidity, detrended_turnover, distribution, bid_ask)}


def build(df: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """The panel with all groups of characteristics, or those named, in order."""
    for g in groups or GROUPS:
        df = GROUPS[g](df)
    return df

"""Filling missing values from similar records."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmill.session import attach, pinned

MOST_CLASSES = 256
PRIOR = 0.1  # weight, in rows, of the overall class shares against an entity's own rows


@dataclass(frozen=True)
class Numeric:
    """A numeric field. ``log``: values must be above 0 and are modelled by their logarithm."""

    log: bool = False

    def observed(self, c: Column) -> Column:
        """The modelled value; null where the field counts as missing: null, NaN, infinite or, for ``log``, not above 0."""
        c = c.cast("double")
        ok = c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
        return F.when(ok & (c > 0), F.ln(c)) if self.log else F.when(ok, c)

    def shown(self, c: Column) -> Column:
        return F.exp(c) if self.log else c


def _uniform(key: str, *what: object) -> Column:
    """A number in (0, 1) that depends on the row's key and on ``what`` alone."""
    return (F.shiftrightunsigned(F.xxhash64(F.col(key), *[F.lit(str(w)) for w in what]), 12) + F.lit(0.5)) / float(1 << 52)


def _normal(key: str, *what: object) -> Column:
    return F.sqrt(-2 * F.ln(_uniform(key, *what, "r"))) * F.cos(2 * math.pi * _uniform(key, *what, "a"))


def impute(
    df: DataFrame,
    key: str,
    entity: str,
    time: str,
    numeric: Mapping[str, Numeric],
    classes: Mapping[str, Sequence[str] | None],
    predictors: Mapping[str, Numeric],
    iterations: int = 3,
    seed: int = 0,
) -> DataFrame:
    """All rows and columns, and for each incomplete field ``<field>_filled`` and ``<field>_was_missing``.

    ``numeric`` and ``classes`` are the incomplete fields; a class field's valid values may be given, anything else then counts
    as missing (default: any non-null value is valid; at most 256 values). ``predictors`` are further numeric columns.

    Method: chained equations. Each numeric field is regressed on its mean over the entity's other rows, its mean over the
    other rows of the time, the predictors, the other numeric fields and the classes; each class field is classified by the
    entity's other rows (a Dirichlet prior) and normal densities of the numeric columns per class. The fits go round
    ``iterations`` times, each round using the fillings of the one before. Masks are kept; fillings are drawn: the
    regression's residual scale times a normal number, and a class by its posterior probability, both seeded by key.

    Every fit follows from sums of products per class. Those of the rows that miss nothing never change, so they are
    taken once, in one aggregation; a round sums up the incomplete rows alone, which are pinned, in one aggregation for
    all fields. Matrices no larger than the number of columns and classes reach the driver.

    Means and counts of entities and times come from one aggregation with map-side combine and are joined back by broadcast
    only if they are few, so an entity with a third of all rows is no burden. The mean over an entity's (a time's) other rows
    is drawn towards the overall mean by the weight of ``within / between`` rows, the ratio of the variances within and
    between entities: where entities differ much, a single other reading counts for nearly all.

    A null entity or time is one of its own. A missing predictor is replaced by its overall mean. A field without any valid value is left null and marked. Input columns with the name
    of an output column are replaced. Equal keys get equal draws. An empty table gives an empty result.
    """
    df = df.drop(*[f"{c}{end}" for c in (*numeric, *classes) for end in ("_filled", "_was_missing")])
    # Working columns begin with "_"; input columns that do so too get out of their way until the end.
    aside = {c: f"input{i}{c}" for i, c in enumerate(df.columns) if c.startswith("_")}
    if aside:
        new = lambda names: {aside.get(c, c): v for c, v in names.items()}
        moved = [aside.get(c, c) for c in (key, entity, time)]
        out = impute(df.withColumnsRenamed(aside), *moved, new(numeric), new(classes), new(predictors), iterations, seed)
        ends = ("", "_filled", "_was_missing")
        return out.withColumnsRenamed({f"{v}{end}": f"{c}{end}" for c, v in aside.items() for end in ends})
    classes = {c: list(v) if v is not None else _values(df, c) for c, v in classes.items()}
    numbers = list(numeric)
    base = df.withColumns(
        {f"_y_{c}": n.observed(F.col(c)) for c, n in numeric.items()}
        | {f"_x_{c}": n.observed(F.col(c)) for c, n in predictors.items()}
        | {f"_c_{c}": F.when(F.col(c).isin(v), F.array_position(F.array(*[F.lit(x) for x in v]), F.col(c)).cast("int")) for c, v in classes.items() if v}
        | {f"_c_{c}": F.lit(None).cast("int") for c, v in classes.items() if not v}
    )
    # Means and counts by entity and by time, from observed values only.
    y = {c: F.col(f"_y_{c}") for c in numbers}
    sums = [x for c, v in y.items() for x in (F.count(v).alias(f"_n_{c}"), F.coalesce(F.sum(v), F.lit(0.0)).alias(f"_s_{c}"), F.coalesce(F.sum(v * v), F.lit(0.0)).alias(f"_q_{c}"))]
    sums += [x for c in predictors for x in (F.count(f"_x_{c}").alias(f"_xn_{c}"), F.coalesce(F.sum(f"_x_{c}"), F.lit(0.0)).alias(f"_xs_{c}"))]
    sums += [F.count_if(F.col(f"_c_{c}") == k + 1).alias(f"_k_{c}_{k}") for c, v in classes.items() for k in range(len(v))]
    by = pinned(base.groupingSets([[F.col(entity)], [F.col(time)]], F.col(entity), F.col(time)).agg(F.grouping_id().alias("_by"), *sums))
    of = {"e": by.filter("_by = 1").drop("_by", time), "t": by.filter("_by = 2").drop("_by", entity)}
    keys = {"e": entity, "t": time}
    whole = of["e"].agg(*[F.sum(c).alias(c) for c in of["e"].columns if c != entity]).first()
    mean = {c: (whole[f"_s_{c}"] or 0.0) / max(whole[f"_n_{c}"] or 0, 1) for c in numbers}
    x_mean = {c: (whole[f"_xs_{c}"] or 0.0) / max(whole[f"_xn_{c}"] or 0, 1) for c in predictors}
    weight = {p: _pull(of[p], numbers, mean) for p in of}
    rows = base
    for p, d in of.items():
        used = [*[f"_{w}_{c}" for c in numbers for w in "ns"], *([f"_k_{c}_{k}" for c, v in classes.items() for k in range(len(v))] if p == "e" else [])]
        rows = attach(rows, d.select(keys[p], *[F.col(c).alias(f"_{p}{c}") for c in used]), [keys[p]])

    shares = {c: _shares([whole[f"_k_{c}_{k}"] or 0 for k in range(len(v))]) for c, v in classes.items()}
    columns = {}
    for c in numbers:
        seen = F.when(y[c].isNotNull(), 1).otherwise(0)
        own = F.coalesce(y[c], F.lit(0.0))
        for p in of:  # the mean over the other rows, drawn towards the overall mean
            others = F.col(f"_{p}_n_{c}") - seen
            columns[f"_m{p}_{c}"] = (F.col(f"_{p}_s_{c}") - own - others * mean[c]) / (others + weight[p][c])
    for c in predictors:
        columns[f"_p_{c}"] = F.coalesce(F.col(f"_x_{c}") - x_mean[c], F.lit(0.0))
    rows = rows.withColumns(columns)
    # First fillings: the entity's mean and its most frequent class.
    rows = rows.withColumns({f"_v_{c}": F.coalesce(y[c] - mean[c], F.col(f"_me_{c}")) for c in numbers})
    for c, v in classes.items():
        if v:
            first = F.array_max(F.array(*[F.struct((F.col(f"_e_k_{c}_{k}") + shares[c][k]).alias("s"), F.lit(k + 1).alias("k")) for k in range(len(v))]))["k"]
            rows = rows.withColumn(f"_g_{c}", F.coalesce(F.col(f"_c_{c}"), first))
        else:
            rows = rows.withColumn(f"_g_{c}", F.col(f"_c_{c}"))

    live = {c: v for c, v in classes.items() if v and sum(whole[f"_k_{c}_{k}"] or 0 for k in range(len(v)))}
    known = [c for c in numbers if whole[f"_n_{c}"]]
    fields = [*[f"_y_{c}" for c in numbers], *[f"_c_{c}" for c in classes]]
    complete = F.lit(True)
    for f in fields:
        complete = complete & F.col(f).isNotNull()
    x = [*[f"_m{p}_{c}" for c in numbers for p in of], *[f"_p_{p}" for p in predictors], *[f"_v_{c}" for c in numbers]]
    have = [f"_y_{c}" for c in known] + [f"_c_{c}" for c in live]
    fixed = _products(rows.filter(complete), x, live, have)
    parts = pinned(rows.filter(~complete))
    for step in range(iterations):
        sums = fixed + _products(parts, x, live, have)
        fills = {}
        for c in known:
            wanted = {f"_me_{c}", f"_mt_{c}", *[f"_p_{p}" for p in predictors], *[f"_v_{o}" for o in numbers if o != c]}
            use = [i for i, name in enumerate(x) if name in wanted]
            model = _regress([s for s in sums if f"_y_{c}" in s.seen], x.index(f"_v_{c}"), use, {g: len(v) for g, v in live.items()})
            guess = F.lit(model.constant) + sum((F.lit(b) * F.col(x[i]) for b, i in zip(model.slopes, use)), F.lit(0.0))
            for g, effects in model.effects.items():
                guess = guess + F.element_at(F.array(*[F.lit(e) for e in effects]), F.col(f"_g_{g}"))
            drawn = guess + model.spread * _normal(key, seed, c, step)
            fills[f"_v_{c}"] = F.when(y[c].isNotNull(), y[c] - mean[c]).otherwise(drawn)
        for c, v in live.items():
            use = [i for i, name in enumerate(x) if name in {*[f"_p_{p}" for p in predictors], *[f"_v_{o}" for o in numbers]}]
            fit = _class_moments([s for s in sums if f"_c_{c}" in s.seen], list(live).index(c), use, len(v))
            scores = []
            for k in range(len(v)):
                score = F.ln(F.col(f"_e_k_{c}_{k}") + PRIOR * max(shares[c][k], 1e-9))
                for j, i in enumerate(use):
                    m, s = fit[k][j]
                    score = score - F.pow((F.col(x[i]) - m) / s, F.lit(2.0)) / 2 - math.log(s)
                draw = -F.ln(-F.ln(_uniform(key, seed, c, k, step)))
                scores.append(F.struct((score + draw).alias("s"), F.lit(k + 1).alias("k")))
            fills[f"_g_{c}"] = F.when(F.col(f"_c_{c}").isNotNull(), F.col(f"_c_{c}")).otherwise(F.array_max(F.array(*scores))["k"])
        parts = parts.withColumns(fills)
        if step < iterations - 1:
            parts = pinned(parts)
    # The complete rows have nothing to be filled, so what is joined to them for the fits is not needed here.
    nothing = {f"_v_{c}": y[c] - mean[c] for c in numbers} | {f"_g_{c}": F.col(f"_c_{c}") for c in classes}
    rest = base.filter(complete).withColumns(nothing)
    rows = rest.unionByName(parts.select(*rest.columns))

    out = [F.col(c) for c in df.columns]
    for c, n in numeric.items():
        missing = F.col(f"_y_{c}").isNull()
        filled = n.shown(F.col(f"_v_{c}") + mean[c]) if c in known else F.lit(None).cast("double")
        out += [F.when(missing, filled).otherwise(F.col(c).cast("double")).alias(f"{c}_filled"), missing.alias(f"{c}_was_missing")]
    for c, v in classes.items():
        missing = F.col(f"_c_{c}").isNull()
        filled = F.element_at(F.array(*[F.lit(x) for x in v]), F.col(f"_g_{c}")) if c in live else F.lit(None).cast("string")
        out += [F.when(missing, filled).otherwise(F.col(c)).alias(f"{c}_filled"), missing.alias(f"{c}_was_missing")]
    return rows.select(*out)


def _values(df: DataFrame, c: str) -> list[str]:
    got = [r[0] for r in df.select(c).distinct().filter(F.col(c).isNotNull()).limit(MOST_CLASSES + 1).collect()]
    if len(got) > MOST_CLASSES:
        raise ValueError(f"{c} has more than {MOST_CLASSES} classes")
    return sorted(got)


def _shares(counts: Sequence[int]) -> list[float]:
    whole = sum(counts)
    return [n / whole if whole else 1.0 / len(counts) for n in counts]


def _pull(groups: DataFrame, numbers: Sequence[str], mean: Mapping[str, float]) -> dict[str, float]:
    """Variance within groups over variance between them, from (n, s, q) of each group: the weight of the overall mean in rows.

    Both are estimated without bias by moments; the ratio is kept between 1e-3 and 1e6.
    """
    each = []
    for c in numbers:
        n, s, q = (F.col(f"_{k}_{c}") for k in "nsq")
        m = F.try_divide(s, n)
        each += [
            F.sum(F.greatest(q - m * s, F.lit(0.0))).alias(f"w_{c}"), F.sum(F.greatest(n - 1, F.lit(0))).alias(f"d_{c}"),
            F.sum(n * F.pow(m - mean[c], F.lit(2.0))).alias(f"b_{c}"), F.count_if(n > 0).alias(f"g_{c}"), F.sum(n).alias(f"n_{c}"), F.sum(n * n).alias(f"nn_{c}"),
        ]
    got = groups.agg(*each).first() if each else {}
    out = {}
    for c in numbers:
        w, d, b, g, n, nn = (float(got[f"{k}_{c}"] or 0) for k in ("w", "d", "b", "g", "n", "nn"))
        within = w / d if d else 0.0
        spread = n - nn / n if n else 0.0
        between = max(b - (g - 1) * within, 0.0) / spread if spread > 0 else 0.0
        out[c] = min(max(within / between, 1e-3), 1e6) if between else 1.0 if not within else 1e6
    return out


@dataclass(frozen=True)
class Sums:
    """Sums of products [1, x]' [1, x] of the rows of one combination of classes, and the fields observed in them."""

    seen: frozenset[str]
    hot: tuple[int, ...]
    p: np.ndarray


def _products(rows: DataFrame, x: Sequence[str], classes: Mapping[str, Sequence[str]], fields: Sequence[str]) -> list[Sums]:
    """The sums of products by combination of classes and of observed fields, in one aggregation with map-side combine."""
    seen = [F.col(f).isNotNull().alias(f"has{i}") for i, f in enumerate(fields)]
    groups = [F.col(f"_g_{g}").alias(f"g{i}") for i, g in enumerate(classes)]
    cols = [F.lit(1.0), *[F.col(c) for c in x]]
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    out = []
    for r in rows.groupBy(*seen, *groups).agg(*[F.sum(cols[i] * cols[j]).alias(f"p{i}_{j}") for i, j in pairs]).collect():  # one row per combination
        p = np.zeros((len(cols),) * 2)
        for i, j in pairs:
            p[i, j] = p[j, i] = r[f"p{i}_{j}"] or 0.0
        out.append(Sums(frozenset(f for i, f in enumerate(fields) if r[f"has{i}"]), tuple(r[f"g{i}"] - 1 for i in range(len(groups))), p))
    return out


@dataclass(frozen=True)
class Regression:
    constant: float
    slopes: list[float]
    effects: dict[str, list[float]]
    spread: float


def _regress(sums: Sequence[Sums], y: int, x: Sequence[int], classes: Mapping[str, int]) -> Regression:
    """Least squares of column ``y`` on the columns ``x`` and an effect per class of each class field."""
    take = [0, *[i + 1 for i in x]]
    width = len(take)
    start, at = {}, width
    for g, k in classes.items():
        start[g], at = at, at + k
    a, b, yy = np.zeros((at, at)), np.zeros(at), 0.0
    for s in sums:
        p, py = s.p[np.ix_(take, take)], s.p[take, y + 1]
        hot = [start[g] + k for g, k in zip(classes, s.hot)]
        a[:width, :width] += p
        b[:width] += py
        yy += s.p[y + 1, y + 1]
        for h in hot:
            a[h, :width] += p[0]
            a[:width, h] += p[0]
            b[h] += py[0]
            for h2 in hot:
                a[h, h2] += p[0, 0]
    n = a[0, 0]
    ridge = np.full(at, 1e-9 * max(n, 1.0))
    ridge[width:] = 1.0  # class effects are drawn towards 0 by the weight of one row
    w = np.linalg.solve(a + np.diag(ridge), b) if n else np.zeros(at)
    spread = math.sqrt(max(yy - 2 * w @ b + w @ a @ w, 0.0) / max(n - width, 1.0))
    return Regression(float(w[0]), [float(v) for v in w[1:width]], {g: [float(v) for v in w[s : s + classes[g]]] for g, s in start.items()}, spread)


def _class_moments(sums: Sequence[Sums], field: int, x: Sequence[int], classes: int) -> list[list[tuple[float, float]]]:
    """Per class mean and deviation of the columns ``x``; where a class has too few rows, ones that rule nothing out."""
    out = []
    for k in range(classes):
        own = [s.p for s in sums if s.hot[field] == k]
        p = sum(own) if own else np.zeros((max(x, default=0) + 2,) * 2)
        n = p[0, 0]
        mean = [p[0, i + 1] / n if n else 0.0 for i in x]
        out.append([(m, max(math.sqrt(max(p[i + 1, i + 1] / n - m * m, 0.0)), 1e-3) if n > 1 else 1e3) for i, m in zip(x, mean)])
    return out

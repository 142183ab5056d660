"""Per-entity transforms of a panel with their inverses.

`Transform.fit(df)` gives an immutable `Fitted`: `transformed` is the panel, `params` a DataFrame with a row per entity
(never collected), `apply(new)` transforms later rows with the same parameters, `invert(df)` undoes it. Panels are
read positionally (entity, time, values); null values stay null. Order is by time, which must be unique per entity.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.functions import features
from tidegrid.spec import Freq, PanelSpec, numeric_columns

Step = Callable[[DataFrame], DataFrame]


def _not_invertible(_: DataFrame) -> DataFrame:
    raise NotImplementedError("this transform has no inverse")


@dataclass(frozen=True)
class Fitted:
    transformed: DataFrame
    apply: Step
    invert: Step = _not_invertible
    params: DataFrame | None = None


@dataclass(frozen=True)
class Transform:
    name: str
    fit: Callable[[DataFrame], Fitted]

    def __call__(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transformed


def _stateless(name: str, step: Step, invert: Step = _not_invertible) -> Transform:
    return Transform(name, lambda df: Fitted(step(df), step, invert))


def _along(p: PanelSpec) -> Window:
    return Window.partitionBy(p.entity).orderBy(p.time)


def _with_params(df: DataFrame, params: DataFrame, entity: str, new: dict[str, Column]) -> DataFrame:
    """Joins one row of parameters per entity (Spark broadcasts them where their size allows) and replaces columns."""
    out = df.join(params, entity, "left")
    return out.select(*[new[c].alias(c) if c in new else F.col(c) for c in df.columns])


def reindex(drop_duplicates: bool = False) -> Transform:
    """Every entity at every time of the panel; values are null where there was no row. Duplicate (entity, time) rows
    are all kept, or only one of them (the least) where drop_duplicates."""

    def step(df: DataFrame) -> DataFrame:
        p = PanelSpec.of(df)
        if drop_duplicates:
            best = df.groupBy(p.entity, p.time).agg(F.min(F.struct(*p.values)).alias("r__"))
            df = best.select(p.entity, p.time, *[F.col(f"r__.{v}").alias(v) for v in p.values])
        entities, times = df.select(p.entity).distinct(), df.select(p.time).distinct()
        # the product of entities and times is the result itself
        return entities.crossJoin(times).join(df, [p.entity, p.time], "left").select(*df.columns)

    return _stateless("reindex", step)


def coerce_dtypes(schema: dict[str, str]) -> Transform:
    return _stateless("coerce_dtypes", lambda df: df.withColumns({c: F.col(c).cast(t) for c, t in schema.items()}))


def time_to_arange() -> Transform:
    """Time replaced by 0, 1, ... per entity."""

    def step(df: DataFrame) -> DataFrame:
        p = PanelSpec.of(df)
        return df.withColumn(p.time, F.row_number().over(_along(p)) - 1)

    return _stateless("time_to_arange", step)


def bucket(time: Column, freq: str) -> Column:
    """Start of the period of `freq` that holds the time: calendar units by month, others from 1970."""
    f = Freq.parse(freq)
    if f.is_integer:
        return time - F.pmod(time, F.lit(f.n))
    if f.months:
        month = F.year(time) * 12 + F.month(time) - 1
        start = month - F.pmod(month, F.lit(f.months))
        return F.make_timestamp_ntz(F.floor(start / 12).cast("int"), (F.pmod(start, F.lit(12)) + 1).cast("int"), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    from tidegrid.functions.clean import floor_to, from_micros, micros

    return from_micros(floor_to(micros(time), F.lit(f.micros)))


def resample(freq: str, agg_method: str = "mean", impute_method: str | float | None = None) -> Transform:
    """One row per entity and period that has rows; then imputed as told, and remaining nulls set to 0."""
    if agg_method not in ("sum", "mean", "median"):
        raise ValueError(f"agg_method is sum, mean or median, not {agg_method!r}")

    def step(df: DataFrame) -> DataFrame:
        p = PanelSpec.of(df)
        agg = {"sum": F.sum, "mean": F.avg, "median": lambda c: F.percentile(c, 0.5)}[agg_method]
        out = df.groupBy(p.entity, bucket(F.col(p.time), freq).alias(p.time)).agg(*[agg(v).alias(v) for v in p.values])
        if impute_method is not None:
            out = impute(impute_method)(out)
        return out.fillna(0, subset=list(p.values))

    return _stateless("resample", step)


def trim(direction: str = "both") -> Transform:
    """Rows from the latest start on (`left`), up to the earliest end (`right`), or `both`."""
    if direction not in ("both", "left", "right"):
        raise ValueError(f"direction is both, left or right, not {direction!r}")

    def step(df: DataFrame) -> DataFrame:
        p = PanelSpec.of(df)
        bounds = df.groupBy(p.entity).agg(F.min(p.time).alias("a"), F.max(p.time).alias("b")).agg(F.max("a").alias("a__"), F.min("b").alias("b__"))
        out = df.join(F.broadcast(bounds))  # a single row
        if direction != "right":
            out = out.where(F.col(p.time) >= F.col("a__"))
        if direction != "left":
            out = out.where(F.col(p.time) <= F.col("b__"))
        return out.drop("a__", "b__")

    return _stateless("trim", step)


def lag(lags: Sequence[int]) -> Transform:
    """Columns {value}__lag_{k} in place of the values; the first max(lags) rows of an entity fall away."""

    def step(df: DataFrame) -> DataFrame:
        p = PanelSpec.of(df)
        w = _along(p)
        cols = [F.lag(v, k).over(w).alias(f"{v}__lag_{k}") for k in lags for v in p.values]
        return df.select(p.entity, p.time, F.row_number().over(w).alias("i__"), *cols).where(F.col("i__") > max(lags)).drop("i__")

    return _stateless("lag", step)


def one_hot_encode(columns: Sequence[str], drop_first: bool = False) -> Transform:
    """0/1 columns {column}__{category} in place of each of `columns`, for the categories met when fitted, in order.
    `apply` raises ValueError if a category is met that wasn't fitted."""

    def fit(df: DataFrame) -> Fitted:
        kinds = {c: sorted(str(r[0]) for r in df.select(c).where(F.col(c).isNotNull()).distinct().limit(1001).collect()) for c in columns}
        if any(len(v) > 1000 for v in kinds.values()):
            raise ValueError("more than 1000 categories")

        def step(new: DataFrame) -> DataFrame:
            dummies = [(F.col(c).cast("string") == v).cast("int").alias(f"{c}__{v}") for c in columns for v in kinds[c][1 if drop_first else 0 :]]
            return new.select(*[c for c in new.columns if c not in columns], *dummies)

        def apply(new: DataFrame) -> DataFrame:
            for c in columns:
                if new.where(~F.col(c).cast("string").isin(kinds[c])).limit(1).count():
                    raise ValueError(f"{c} has categories that weren't there when fitted")
            return step(new)

        def invert(new: DataFrame) -> DataFrame:
            for c in columns:
                kept = kinds[c][1 if drop_first else 0 :]
                back = F.coalesce(*[F.when(F.col(f"{c}__{v}") == 1, F.lit(v)) for v in kept], F.lit(kinds[c][0]) if drop_first else F.lit(None))
                new = new.withColumn(c, back).drop(*[f"{c}__{v}" for v in kept])
            return new

        return Fitted(step(df), apply, invert)

    return Transform("one_hot_encode", fit)


def roll(window_sizes: Sequence[int], stats: Sequence[str]) -> Transform:
    """{value}__rolling_{stat}_{w} over the w rows before each row (its own left out), null where there are fewer."""
    made: dict[str, Callable[[str], Column]] = {
        "mean": F.avg, "min": F.min, "max": F.max, "sum": F.sum, "std": F.stddev_samp,
        "mlm": lambda v: F.max(v) - F.min(v), "cv": lambda v: F.try_divide(F.stddev_samp(v), F.avg(v)),
    }
    if unknown := set(stats) - set(made):
        raise ValueError(f"unknown statistics {sorted(unknown)}")

    def step(df: DataFrame) -> DataFrame:
        p = PanelSpec.of(df)
        w = _along(p)
        cols = []
        for size in window_sizes:
            before = w.rowsBetween(-size, -1)
            for stat in stats:
                for v in p.values:
                    if stat == "mlm":
                        x = F.max(v).over(before) - F.min(v).over(before)
                    elif stat == "cv":
                        x = F.try_divide(F.stddev_samp(v).over(before), F.avg(v).over(before))
                    else:
                        x = made[stat](v).over(before)
                    cols.append(F.when(F.row_number().over(w) > size, x).alias(f"{v}__rolling_{stat}_{size}"))
        return df.select(p.entity, p.time, *cols)

    return _stateless("roll", step)


def scale(use_mean: bool = True, use_std: bool = True, rescale_bool: bool = False) -> Transform:
    """(x - mean) / sample standard deviation per entity; booleans to -1/1 where told. A constant is divided by 1."""

    def fit(df: DataFrame) -> Fitted:
        p = PanelSpec.of(df)
        nums = numeric_columns(df, p.values)
        flags = [f.name for f in df.schema.fields if isinstance(f.dataType, T.BooleanType)] if rescale_bool else []
        params = df.groupBy(p.entity).agg(*[F.avg(v).alias(f"m__{v}") for v in nums], *[F.stddev_samp(v).alias(f"s__{v}") for v in nums])
        mid = lambda v: F.col(f"m__{v}") if use_mean else F.lit(0.0)
        size = lambda v: F.when(F.col(f"s__{v}") > 0, F.col(f"s__{v}")).otherwise(1.0) if use_std else F.lit(1.0)

        def step(new: DataFrame) -> DataFrame:
            return _with_params(new, params, p.entity, {v: (F.col(v) - mid(v)) / size(v) for v in nums} | {b: F.when(F.col(b), 1).when(~F.col(b), -1) for b in flags})

        def invert(new: DataFrame) -> DataFrame:
            return _with_params(new, params, p.entity, {v: F.col(v) * size(v) + mid(v) for v in nums if v in new.columns} | {b: F.col(b) == 1 for b in flags if b in new.columns})

        return Fitted(step(df), step, invert, params)

    return Transform("scale", fit)


def impute(method: str | float) -> Transform:
    """Nulls and NaNs of numeric values filled per entity: mean, median, fill (mean of doubles, median of integers),
    ffill, bfill, interpolate (alias linear; by row position, between neighbours only), or a number."""

    def step(df: DataFrame) -> DataFrame:
        p = PanelSpec.of(df)
        e, w = Window.partitionBy(p.entity), _along(p)
        back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
        kinds = {f.name: f.dataType for f in df.schema.fields}
        nums = numeric_columns(df, p.values)
        rows = df.withColumns({v: F.when(~F.isnan(v), F.col(v)) for v in nums if isinstance(kinds[v], (T.DoubleType, T.FloatType))})
        if method in ("interpolate", "linear"):
            rows = rows.withColumn("i__", F.row_number().over(w))
        new = {}
        for v in nums:
            x = F.col(v)
            whole = isinstance(kinds[v], T.IntegralType)
            if isinstance(method, (int, float)) and not isinstance(method, bool):
                fill = F.lit(method)
            elif method == "mean" or method == "fill" and not whole:
                fill = F.avg(x).over(e)
            elif method in ("median", "fill"):
                fill = F.percentile(x, 0.5).over(e)
            elif method == "ffill":
                fill = F.last(x, True).over(back)
            elif method == "bfill":
                fill = F.first(x, True).over(ahead)
            elif method in ("interpolate", "linear"):
                at = F.when(x.isNotNull(), F.struct(F.col("i__").alias("i"), x.cast("double").alias("x")))
                a, b = F.last(at, True).over(back), F.first(at, True).over(ahead)
                fill = a["x"] + (b["x"] - a["x"]) * (F.col("i__") - a["i"]) / F.nullif(b["i"] - a["i"], F.lit(0))
            else:
                raise ValueError(f"unknown method {method!r}")
            new[v] = F.coalesce(x, fill)
        return rows.withColumns(new).drop("i__")

    return _stateless("impute", step)


def diff(order: int = 1, sp: int = 1) -> Transform:
    """`order` times the difference to the row sp before; the first order*sp rows of an entity fall away. `invert` takes
    either the transformed rows or rows that follow them in time (forecasts), and restores the rows given."""

    def fit(df: DataFrame) -> Fitted:
        p = PanelSpec.of(df)
        w = _along(p)

        def step(new: DataFrame) -> DataFrame:
            for _ in range(order):
                new = new.withColumns({v: F.col(v) - F.lag(v, sp).over(w) for v in p.values})
            return new.withColumn("i__", F.row_number().over(w)).where(F.col("i__") > order * sp).drop("i__")

        def invert(new: DataFrame) -> DataFrame:
            # levels[k]: the panel differenced k times, of which each step back needs the first rows
            levels = [df]
            for _ in range(order - 1):
                prev = levels[-1].withColumns({v: F.col(v) - F.lag(v, sp).over(w) for v in p.values}).withColumn("i__", F.row_number().over(w))
                levels.append(prev.where(F.col("i__") > sp).drop("i__"))
            first = new.groupBy(p.entity).agg(F.min(p.time).alias("from__"))
            for level in reversed(levels):
                # anchors: the last sp rows of this level before the first row given
                before = level.join(first, p.entity).where(F.col(p.time) < F.col("from__"))
                last = before.withColumn("k__", F.row_number().over(Window.partitionBy(p.entity).orderBy(F.col(p.time).desc()))).where(F.col("k__") <= sp)
                rows = last.select(p.entity, p.time, *p.values, F.lit(True).alias("anchor__")).unionByName(new.select(p.entity, p.time, *p.values, F.lit(False).alias("anchor__")))
                rows = rows.withColumn("phase__", (F.row_number().over(w) - 1) % sp)
                total = Window.partitionBy(p.entity, "phase__").orderBy(p.time).rowsBetween(Window.unboundedPreceding, 0)
                rows = rows.withColumns({v: F.sum(v).over(total) for v in p.values})
                if level is not levels[0]:
                    first = first.select(p.entity, "from__")
                new = rows.where(~F.col("anchor__")).select(p.entity, p.time, *p.values)
            return new

        return Fitted(step(df), step, invert)

    return Transform("diff", fit)


def _golden(score: Callable[[float], float], a: float, b: float, steps: int = 60) -> float:
    """Place of the minimum of a unimodal function on [a, b] by golden section."""
    g = (5**0.5 - 1) / 2
    c, d = b - g * (b - a), a + g * (b - a)
    fc, fd = score(c), score(d)
    for _ in range(steps):
        if fc < fd:
            b, d, fd = d, c, fc
            c = b - g * (b - a)
            fc = score(c)
        else:
            a, c, fc = c, d, fd
            d = a + g * (b - a)
            fd = score(d)
    return (a + b) / 2


def _boxcox_lambda(x: np.ndarray) -> float:
    x = x[np.isfinite(x) & (x > 0)]
    if len(x) < 2 or np.ptp(x) == 0:
        return 1.0
    logs = np.log(x)
    # the likelihood doesn't depend on the unit of x: dividing by the geometric mean keeps powers in range
    z = logs - logs.mean()
    return _golden(lambda m: float(np.log(np.var(np.expm1(m * z) / m if abs(m) > 1e-9 else z))), -2, 2)


def _yeojohnson(x: np.ndarray, m: float) -> np.ndarray:
    out = np.empty(len(x))
    pos = x >= 0
    out[pos] = np.expm1(m * np.log1p(x[pos])) / m if abs(m) > 1e-9 else np.log1p(x[pos])
    out[~pos] = -np.expm1((2 - m) * np.log1p(-x[~pos])) / (2 - m) if abs(m - 2) > 1e-9 else -np.log1p(-x[~pos])
    return out


def _yeojohnson_lambda(x: np.ndarray) -> float:
    x = x[np.isfinite(x)]
    if len(x) < 2 or np.ptp(x) == 0:
        return 1.0
    slope = float((np.sign(x) * np.log1p(np.abs(x))).mean())
    return _golden(lambda m: float(0.5 * np.log(max(np.var(_yeojohnson(x, m)), 1e-300)) - (m - 1) * slope), -2, 2)


def _power(name: str, find: Callable[[np.ndarray], float], forward: Callable[[Column, Column], Column], back: Callable[[Column, Column], Column]) -> Transform:
    def fit(df: DataFrame) -> Fitted:
        p = PanelSpec.of(df)
        nums = numeric_columns(df, p.values)
        kind = dict(df.dtypes)[p.entity]

        def search(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({p.entity: [key[0]], **{f"m__{v}": [find(pdf[v].to_numpy(float))] for v in nums}})

        params = df.select(p.entity, *nums).groupBy(p.entity).applyInPandas(search, ", ".join([f"`{p.entity}` {kind}", *[f"`m__{v}` double" for v in nums]]))
        step = lambda new: _with_params(new, params, p.entity, {v: forward(F.col(v), F.col(f"m__{v}")) for v in nums})
        invert = lambda new: _with_params(new, params, p.entity, {v: back(F.col(v), F.col(f"m__{v}")) for v in nums if v in new.columns})
        return Fitted(step(df), step, invert, params)

    return Transform(name, fit)


def boxcox() -> Transform:
    """Box-Cox with a lambda per entity in [-2, 2] by maximum likelihood; values must be positive (others become null)."""
    forward = lambda x, m: F.when(x > 0, F.when(F.abs(m) > 1e-9, (F.pow(x, m) - 1) / m).otherwise(F.log(x)))
    back = lambda y, m: F.when(F.abs(m) > 1e-9, F.pow(F.greatest(y * m + 1, F.lit(0.0)), 1 / m)).otherwise(F.exp(y))
    return _power("boxcox", _boxcox_lambda, forward, back)


def yeojohnson() -> Transform:
    """Yeo-Johnson with a lambda per entity in [-2, 2] by maximum likelihood; any real value."""

    def forward(x: Column, m: Column) -> Column:
        up = F.when(F.abs(m) > 1e-9, (F.pow(x + 1, m) - 1) / m).otherwise(F.log1p(x))
        down = F.when(F.abs(m - 2) > 1e-9, -(F.pow(1 - x, 2 - m) - 1) / (2 - m)).otherwise(-F.log1p(-x))
        return F.when(x >= 0, up).otherwise(down)

    def back(y: Column, m: Column) -> Column:
        up = F.when(F.abs(m) > 1e-9, F.pow(F.greatest(y * m + 1, F.lit(0.0)), 1 / m) - 1).otherwise(F.expm1(y))
        down = F.when(F.abs(m - 2) > 1e-9, 1 - F.pow(F.greatest(1 - y * (2 - m), F.lit(0.0)), 1 / (2 - m))).otherwise(-F.expm1(-y))
        return F.when(y >= 0, up).otherwise(down)

    return _power("yeojohnson", _yeojohnson_lambda, forward, back)


def log1p() -> Transform:
    """ln(1 + x) of every numeric value; inverse exp(x) - 1."""
    every = lambda g: lambda df: df.withColumns({v: g(v) for v in numeric_columns(df, PanelSpec.of(df).values)})
    return _stateless("log1p", every(F.log1p), every(F.expm1))


def _elapsed(time: Column, since: Column, freq: str) -> Column:
    """Steps of `freq` between two times."""
    f = Freq.parse(freq)
    if f.is_integer:
        return (time - since) / f.n
    if f.months:
        return F.months_between(time, since) / f.months
    from tidegrid.functions.clean import micros

    return (micros(time) - micros(since)) / f.micros


def detrend(freq: str = "1d", method: str = "linear") -> Transform:
    """The panel less its least squares line over steps of `freq` since the first row (`linear`), or less its mean. The
    inverse adds the line at any time, so it extrapolates for forecasts."""
    if method not in ("linear", "mean"):
        raise ValueError(f"method is linear or mean, not {method!r}")

    def fit(df: DataFrame) -> Fitted:
        p = PanelSpec.of(df)
        nums = numeric_columns(df, p.values)
        start = F.min(p.time).over(Window.partitionBy(p.entity))
        rows = df.withColumn("t__", _elapsed(F.col(p.time), start, freq)).withColumn("z__", start)
        line = [x for v in nums for x in (F.avg(v).alias(f"a__{v}"), *([F.coalesce(F.regr_slope(v, "t__"), F.lit(0.0)).alias(f"b__{v}"), F.coalesce(F.regr_intercept(v, "t__"), F.avg(v)).alias(f"c__{v}")] if method == "linear" else []))]
        params = rows.groupBy(p.entity).agg(F.min("z__").alias("z__"), *line)
        at = _elapsed(F.col(p.time), F.col("z__"), freq)
        level = lambda v: F.col(f"c__{v}") + F.col(f"b__{v}") * at if method == "linear" else F.col(f"a__{v}")
        step = lambda new: _with_params(new, params, p.entity, {v: F.col(v) - level(v) for v in nums})
        invert = lambda new: _with_params(new, params, p.entity, {v: F.col(v) + level(v) for v in nums if v in new.columns})
        return Fitted(step(df), step, invert, params)

    return Transform("detrend", fit)


def deseasonalize_fourier(sp: int, K: int, robust: bool = False) -> Transform:
    """The panel less its regression on K Fourier pairs of period sp (in rows since the first) and a constant; robust
    repeats it with Huber weights. The inverse counts rows on from the first time of the fitted panel by the rows given,
    which must begin where the fitted rows begin or end."""

    def fit(df: DataFrame) -> Fitted:
        p = PanelSpec.of(df)
        nums = numeric_columns(df, p.values)
        w = _along(p)
        kind = dict(df.dtypes)[p.entity]

        def design(i: np.ndarray) -> np.ndarray:
            k = np.arange(1, K + 1)
            a = 2 * np.pi * np.outer(i % sp, k) / sp
            return np.c_[np.ones(len(i)), np.cos(a), np.sin(a)]

        def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            out = {p.entity: [key[0]], "n__": [len(pdf)], "last__": [pdf[p.time].max()]}
            x = design(pdf["i__"].to_numpy())
            for v in nums:
                y = pdf[v].to_numpy(float)
                ok = np.isfinite(y)
                weight = np.ones(ok.sum())
                for _ in range(20 if robust else 1):
                    beta = np.linalg.lstsq(x[ok] * weight[:, None], y[ok] * weight, rcond=None)[0]
                    r = np.abs(y[ok] - x[ok] @ beta)
                    cut = 1.345 * 1.4826 * np.median(r) if len(r) else 0.0
                    weight = np.sqrt(np.minimum(1.0, cut / np.maximum(r, 1e-300))) if cut > 0 else np.ones(len(r))
                out[f"c__{v}"] = [beta]
            return pd.DataFrame(out)

        rows = df.select(p.entity, p.time, *nums).withColumn("i__", F.row_number().over(w) - 1)
        params = rows.groupBy(p.entity).applyInPandas(solve, ", ".join([f"`{p.entity}` {kind}", "n__ bigint", f"last__ {dict(df.dtypes)[p.time]}", *[f"`c__{v}` array<double>" for v in nums]]))

        def season(v: str, i: Column) -> Column:
            out = F.col(f"c__{v}")[0]
            for k in range(1, K + 1):
                a = 2 * np.pi * k * (i % sp) / sp
                out = out + F.col(f"c__{v}")[k] * F.cos(a) + F.col(f"c__{v}")[K + k] * F.sin(a)
            return out

        def with_sign(new: DataFrame, sign: int) -> DataFrame:
            rows = new.withColumn("i__", F.row_number().over(w) - 1).join(params, p.entity, "left")
            late = F.min(p.time).over(Window.partitionBy(p.entity)) > F.col("last__")
            rows = rows.withColumn("i__", F.col("i__") + F.when(late, F.col("n__")).otherwise(0))
            return rows.select(*[(F.col(c) + sign * season(c, F.col("i__"))).alias(c) if c in nums else F.col(c) for c in new.columns])

        return Fitted(with_sign(df, -1), lambda new: with_sign(new, -1), lambda new: with_sign(new, 1), params)

    return Transform("deseasonalize_fourier", fit)


def fractional_diff(d: float, min_weight: float | None = None, window_size: int | None = None) -> Transform:
    """Fractional differencing of fixed width per entity (see features.fractional_difference)."""

    def step(df: DataFrame) -> DataFrame:
        p = PanelSpec.of(df)
        for v in numeric_columns(df, p.values):
            df = features.fractional_difference(df, p.entity, p.time, v, d, min_weight, window_size)
        return df

    return _stateless("fractional_diff", step)

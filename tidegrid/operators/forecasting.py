"""Global autoregressive forecasters over panels: one model for all entities, fitted by one distributed aggregation.

Linear models rest on Gram matrices summed over partitions (the driver sees p x p figures only), and forecast
recursively by folding an array per entity, without a shuffle a step. Tree, neighbour and censored models forecast
directly: a model (or a set of neighbours) for each step ahead. Lag 1 of the first forecast is the last known value.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import BucketedRandomProjectionLSH, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression, LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.operators import metrics
from tidegrid.operators.seasonality import future_of
from tidegrid.operators.splits import expanding_window_split, long_enough, sliding_window_split
from tidegrid.operators.transforms import Fitted, Transform
from tidegrid.plans.session import written
from tidegrid.spec import PanelSpec

# -- design -------------------------------------------------------------------------------------------------------


def joined_features(y: DataFrame, X: DataFrame | None) -> tuple[DataFrame, list[str]]:
    """y with the features of X, which may be keyed by entity and time, by entity only, or by time only."""
    if X is None:
        return y, []
    p = PanelSpec.of(y)
    on = [c for c in (p.entity, p.time) if c in X.columns]
    if not on:
        raise ValueError("X shares neither the entity nor the time column with y")
    names = [c for c in X.columns if c not in on]
    return y.join(X, on, "inner").select(*y.columns, *names), names


def design(y: DataFrame, lags: int, features: Sequence[str] = (), ahead: int = 1) -> DataFrame:
    """Rows with all of y, lag_1..lag_{lags+ahead-1} and the features: entity, time, y, lags, features."""
    p = PanelSpec.of(y)
    target = p.values[0]
    w = Window.partitionBy(p.entity).orderBy(p.time)
    most = lags + ahead - 1
    cols = [F.lag(target, k).over(w).cast("double").alias(f"lag_{k}") for k in range(1, most + 1)]
    rows = y.select(p.entity, p.time, F.col(target).cast("double").alias("y"), *cols, *[F.col(f).cast("double").alias(f) for f in features])
    return rows.where(F.col(f"lag_{most}").isNotNull() & F.col("y").isNotNull()).na.drop(subset=[f"lag_{k}" for k in range(1, most + 1)] + list(features))


def gram(rows: DataFrame, columns: Sequence[str], folds: int = 1) -> list[np.ndarray]:
    """Sums over all rows of z z' with z = (1, columns), one matrix a fold (rows dealt by hash). Partitions sum their own
    rows in numpy, and the figures of all partitions are added up by one small aggregate."""
    m, names = len(columns) + 1, list(columns)
    fold = F.pmod(F.xxhash64(*names), F.lit(folds)).cast("int")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((folds, m, m))
        for pdf in batches:
            z = np.c_[np.ones(len(pdf)), pdf[names].to_numpy(float)]
            for k in range(folds):
                zk = z[pdf["fold__"].to_numpy() == k] if folds > 1 else z
                total[k] += zk.T @ zk
        flat = total.reshape(-1)
        yield pd.DataFrame({"at": np.arange(len(flat)), "x": flat})

    parts = rows.select(*names, fold.alias("fold__")).mapInPandas(run, "at bigint, x double")
    sums = parts.groupBy("at").agg(F.sum("x").alias("x")).toPandas()
    out = np.zeros(folds * m * m)
    out[sums["at"].to_numpy()] = sums["x"].to_numpy()
    return list(out.reshape(folds, m, m))


# -- linear solutions from a Gram matrix of (1, y, features) ------------------------------------------------------


def _centred(g: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray, float]:
    n = g[0, 0]
    mean = g[0, 1:] / n
    c = g[1:, 1:] - n * np.outer(mean, mean)
    return n, mean, c[1:, 1:], c[1:, 0], c[0, 0]


def solve(g: np.ndarray, kind: str = "ols", alpha: float = 1.0, l1_ratio: float = 0.5, steps: int = 2000) -> np.ndarray:
    """(intercept, coefficients). ridge adds alpha to the diagonal; lasso and elastic_net minimise
    1/(2n) squared error + alpha (l1_ratio l1 + (1 - l1_ratio)/2 l2) by coordinate descent."""
    n, mean, a, b, _ = _centred(g)
    if n < 1:
        raise ValueError("there are no complete rows: series are shorter than the lags")
    if kind == "ols":
        w = np.linalg.lstsq(a, b, rcond=1e-12)[0]
    elif kind == "ridge":
        w = np.linalg.solve(a + alpha * np.eye(len(b)), b)
    elif kind in ("lasso", "elastic_net"):
        share = 1.0 if kind == "lasso" else l1_ratio
        l1, l2 = alpha * share, alpha * (1 - share)
        a, b, w = a / n, b / n, np.zeros(len(b))
        for _ in range(steps):
            old = w.copy()
            for j in range(len(w)):
                r = b[j] - a[j] @ w + a[j, j] * w[j]
                w[j] = np.sign(r) * max(abs(r) - l1, 0.0) / (a[j, j] + l2) if a[j, j] + l2 > 0 else 0.0
            if np.abs(w - old).max() <= 1e-10 * max(1.0, np.abs(w).max()):
                break
    else:
        raise ValueError(f"unknown kind {kind!r}")
    return np.r_[mean[0] - mean[1:] @ w, w]


def squared_error(g: np.ndarray, w: np.ndarray) -> float:
    """Sum of squared errors of weights (intercept, coefficients) on the rows of a Gram matrix."""
    v = np.r_[-w[0], 1.0, -w[1:]]
    return float(v @ g @ v)


def cross_validated(folds: list[np.ndarray], kind: str, alphas: Sequence[float], l1_ratio: float = 0.5) -> tuple[float, np.ndarray]:
    """(alpha, weights on all rows) of the least cross-validated error; Gram matrices being sums, folds cost no pass."""
    whole = sum(folds)
    best = min(alphas, key=lambda x: sum(squared_error(f, solve(whole - f, kind, x, l1_ratio)) for f in folds))
    return best, solve(whole, kind, best, l1_ratio)


ALPHAS = tuple(float(x) for x in 10.0 ** np.arange(-4, 3))


@dataclass(frozen=True)
class Linear:
    """A way to weights; `cv` picks alpha among `alphas` over `cv` folds."""

    kind: str = "ols"
    alpha: float = 1.0
    l1_ratio: float = 0.5
    cv: int = 0
    alphas: tuple[float, ...] = ALPHAS

    def weights(self, folds: list[np.ndarray], pick: list[int]) -> np.ndarray:
        some = [f[np.ix_(pick, pick)] for f in folds]
        if self.cv:
            return cross_validated(some, self.kind, self.alphas, self.l1_ratio)[1]
        return solve(sum(some), self.kind, self.alpha, self.l1_ratio)


# -- forecasters --------------------------------------------------------------------------------------------------


def last_values(y: DataFrame, size: int) -> DataFrame:
    """entity, last__ (array of the last `size` values in order), from one exchange."""
    p = PanelSpec.of(y)
    k = F.row_number().over(Window.partitionBy(p.entity).orderBy(F.col(p.time).desc()))
    rows = y.select(p.entity, p.time, F.col(p.values[0]).cast("double").alias("v__"), k.alias("k__")).where(F.col("k__") <= size)
    return rows.groupBy(p.entity).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(p.time).alias("t"), F.col("v__").alias("v")))), lambda s: s["v"]).alias("last__"))


@dataclass(frozen=True)
class Model:
    """A fitted forecaster: `forecast(fh, X_future)` gives entity, time, value; `residuals()` what the fitted values miss
    of the training rows (entity, time, y_resid), None for models without fitted values."""

    forecast: Callable[[int, DataFrame | None], DataFrame]
    weights: dict[int, np.ndarray] = field(default_factory=dict)
    residuals: Callable[[], DataFrame] | None = None


@dataclass(frozen=True)
class Forecaster:
    """A way to fit a Model to y (entity, time, value) and features X; called, it fits.

    lags: rows of history that a forecast needs. local: an entity's forecast rests on its own values alone, so that many
    training sets can be forecast in one pass."""

    fit: Callable[..., Model]
    lags: int = 0
    local: bool = False

    def __call__(self, y: DataFrame, X: DataFrame | None = None) -> Model:
        return self.fit(y, X)

    def backtest(
        self, y: DataFrame, X: DataFrame | None = None, test_size: int = 1, step_size: int = 1, n_splits: int = 5, window_size: int = 10, strategy: str = "expanding", drop_short: bool = False, drop_tolerance: float = 2.0
    ) -> tuple[DataFrame, DataFrame]:
        """`backtest` with in-sample residuals over expanding or sliding windows; see `check_backtest_lengths`."""
        y = check_backtest_lengths(y, self.lags, test_size, drop_short, drop_tolerance)
        return backtest(self, y, test_size, n_splits, step_size, X, windows(strategy, test_size, n_splits, step_size, window_size), residualize=True)

    def conformalize(self, fh: int, y: DataFrame, X: DataFrame | None = None, X_future: DataFrame | None = None, alphas: Sequence[float] = (0.1, 0.9), drop_tolerance: float = 5.0, **kw) -> DataFrame:
        """Forecast intervals from in-sample residuals of a backtest; `kw` as for `backtest`."""
        ahead = self(y, X).forecast(fh, X_future)
        told, resid = self.backtest(y, X, drop_tolerance=drop_tolerance, **kw)
        return conformalize(ahead, told, resid.select(*resid.columns[:3]), alphas)


def _with_steps(y: DataFrame, freq: str, fh: int, path: DataFrame) -> DataFrame:
    """Joins an array of fh values per entity (`path__`) to the future times."""
    p = PanelSpec.of(y)
    rows = future_of(y.select(p.entity, p.time), fh, freq).join(path, p.entity)
    return rows.select(p.entity, p.time, F.get("path__", F.col("step") - 1).alias(p.values[0]))


def naive(freq: str) -> Forecaster:
    """The last value, again and again."""

    def fit(y: DataFrame, X: DataFrame | None = None) -> Model:
        p = PanelSpec.of(y)
        last = y.groupBy(p.entity).agg(F.max_by(p.values[0], p.time).alias("v__"))
        return Model(lambda fh, _=None: future_of(y, fh, freq).join(last, p.entity).select(p.entity, p.time, F.col("v__").alias(p.values[0])))

    return Forecaster(fit, 1, local=True)


def snaive(freq: str, sp: int) -> Forecaster:
    """The last season, again and again."""

    def fit(y: DataFrame, X: DataFrame | None = None) -> Model:
        p = PanelSpec.of(y)
        last = last_values(y, sp)
        value = F.get("last__", F.pmod(F.col("step") - 1, F.size("last__")).cast("int"))
        return Model(lambda fh, _=None: future_of(y, fh, freq).join(last, p.entity).select(p.entity, p.time, value.alias(p.values[0])))

    return Forecaster(fit, sp, local=True)


def _future_features(y: DataFrame, X_future: DataFrame | None, names: Sequence[str], fh: int, freq: str) -> DataFrame:
    """entity, step, features of the future times (joined by the keys X_future has)."""
    p = PanelSpec.of(y)
    times = future_of(y.select(p.entity, p.time), fh, freq)
    if not names:
        return times
    if X_future is None:
        raise ValueError("the model was fitted with features: X_future is needed")
    on = [c for c in (p.entity, p.time) if c in X_future.columns]
    future = times.join(X_future.select(*on, *names), on, "left")
    if not future.where(F.lit(False) if not names else F.greatest(*[future[f].isNull().cast("int") for f in names], F.lit(0)) > 0).isEmpty():
        raise ValueError(f"X_future lacks {', '.join(names)} for some of the times to forecast")
    return future


def _known(future: DataFrame, names: Sequence[str]) -> list[Column]:
    """Features of future times as doubles."""
    return [future[f].cast("double").alias(f) for f in names]


def autoregressive(freq: str, lags: int, how: Linear = Linear(), strategy: str = "recursive", max_horizons: int = 12) -> Forecaster:
    """Linear model of `lags` lags and features. recursive: one step ahead, folded; direct: a model for each of
    max_horizons steps (their rows are those with all lags+max_horizons-1 lags); ensemble: the mean of both."""
    if strategy not in ("recursive", "direct", "ensemble"):
        raise ValueError(f"strategy is recursive, direct or ensemble, not {strategy!r}")

    def fit(y: DataFrame, X: DataFrame | None = None) -> Model:
        p = PanelSpec.of(y)
        rows, names = joined_features(y, X)
        ahead = 1 if strategy == "recursive" else max_horizons
        columns = ["y", *[f"lag_{k}" for k in range(1, lags + ahead)], *names]
        # sums of figures near zero keep the digits that those of a high level would lose
        about = rows.agg(F.avg(F.col(p.values[0]).cast("double")).alias("y"), *[F.avg(F.col(f).cast("double")).alias(f) for f in names]).first().asDict()
        middle = {c: float(about[c if c in names else "y"] or 0.0) for c in columns}
        middle = {c: m if np.isfinite(m) else 0.0 for c, m in middle.items()}
        near = design(rows, lags, names, ahead).select(*[(F.col(c) - middle[c]).alias(c) for c in columns])
        folds = gram(near, columns, max(1, how.cv))
        at = {c: i + 1 for i, c in enumerate(columns)}
        weights = {}
        for h in range(1, ahead + 1):
            used = [*[f"lag_{k}" for k in range(h, h + lags)], *names]
            w = how.weights(folds, [0, 1, *[at[c] for c in used]])
            weights[h] = np.r_[w[0] + middle["y"] - sum(b * middle[c] for b, c in zip(w[1:], used, strict=True)), w[1:]]
        last = last_values(y, lags)

        def effect(w: np.ndarray) -> Column:
            """Intercept and features' part of a step."""
            return sum((F.col(f).cast("double") * float(b) for f, b in zip(names, w[1 + lags :], strict=True)), F.lit(float(w[0])))

        def recursive(fh: int, X_future: DataFrame | None) -> DataFrame:
            w = weights[1]
            future = _future_features(y, X_future, names, fh, freq)
            outer = future.groupBy(p.entity).agg(F.transform(F.array_sort(F.collect_list(F.struct("step", effect(w).alias("x")))), lambda s: s["x"]).alias("ex__"))
            dot = lambda a, x: sum((F.element_at(a, -k) * float(w[k]) for k in range(1, lags + 1)), x)
            path = F.aggregate("ex__", F.col("last__"), lambda a, x: F.concat(a, F.array(dot(a, x))))
            told = outer.join(last.where(F.size("last__") >= lags), p.entity).select(p.entity, F.slice(path, lags + 1, fh).alias("path__"))
            return _with_steps(y, freq, fh, told)

        def direct(fh: int, X_future: DataFrame | None) -> DataFrame:
            if fh > max_horizons:
                raise ValueError(f"fh {fh} exceeds max_horizons {max_horizons}")
            future = _future_features(y, X_future, names, fh, freq).join(last.where(F.size("last__") >= lags), p.entity)
            value = F.lit(None).cast("double")
            for h in range(1, fh + 1):
                w = weights[h]
                value = F.when(F.col("step") == h, sum((F.element_at("last__", -k) * float(w[k]) for k in range(1, lags + 1)), effect(w))).otherwise(value)
            return future.select(p.entity, p.time, value.alias(p.values[0]))

        def both(fh: int, X_future: DataFrame | None) -> DataFrame:
            a, b = recursive(fh, X_future), direct(fh, X_future).withColumnRenamed(p.values[0], "b__")
            return a.join(b, [p.entity, p.time]).select(p.entity, p.time, ((F.col(p.values[0]) + F.col("b__")) / 2).alias(p.values[0]))

        def missed(ahead: int) -> DataFrame:
            """Residuals of the rows with all lags; with several steps ahead, of the mean of their fitted values."""
            fitted = [sum((F.col(f"lag_{h - 1 + k}") * float(weights[h][k]) for k in range(1, lags + 1)), effect(weights[h])) for h in range(1, ahead + 1)]
            return design(rows, lags, names, ahead).select(p.entity, p.time, (F.col("y") - sum(fitted[1:], fitted[0]) / ahead).alias("y_resid"))

        def residuals() -> DataFrame:
            if strategy != "ensemble":
                return missed(ahead)
            other = missed(ahead).withColumnRenamed("y_resid", "r__")
            return missed(1).join(other, [p.entity, p.time]).select(p.entity, p.time, ((F.col("y_resid") + F.col("r__")) / 2).alias("y_resid"))

        chosen = {"recursive": recursive, "direct": direct, "ensemble": both}[strategy]
        return Model(lambda fh, X_future=None: chosen(fh, X_future), weights, residuals)

    return Forecaster(fit, lags if strategy == "recursive" else lags + max_horizons - 1)


def linear_model(freq: str, lags: int, **kw) -> Forecaster:
    return autoregressive(freq, lags, Linear(), **kw)


def ridge(freq: str, lags: int, alpha: float = 1.0, **kw) -> Forecaster:
    return autoregressive(freq, lags, Linear("ridge", alpha), **kw)


def lasso(freq: str, lags: int, alpha: float = 1.0, **kw) -> Forecaster:
    return autoregressive(freq, lags, Linear("lasso", alpha), **kw)


def elastic_net(freq: str, lags: int, alpha: float = 1.0, l1_ratio: float = 0.5, **kw) -> Forecaster:
    return autoregressive(freq, lags, Linear("elastic_net", alpha, l1_ratio), **kw)


def ridge_cv(freq: str, lags: int, cv: int = 5, **kw) -> Forecaster:
    return autoregressive(freq, lags, Linear("ridge", cv=cv), **kw)


def lasso_cv(freq: str, lags: int, cv: int = 5, **kw) -> Forecaster:
    return autoregressive(freq, lags, Linear("lasso", cv=cv), **kw)


def elastic_net_cv(freq: str, lags: int, cv: int = 5, **kw) -> Forecaster:
    return autoregressive(freq, lags, Linear("elastic_net", cv=cv), **kw)


def _last_rows(y: DataFrame, lags: int) -> DataFrame:
    """entity, lag_1..lag_{lags} as seen from the first future step; entities too short fall away."""
    p = PanelSpec.of(y)
    last = last_values(y, lags).where(F.size("last__") >= lags)
    return last.select(p.entity, *[F.element_at("last__", -k).alias(f"lag_{k}") for k in range(1, lags + 1)])


def _direct_rows(y: DataFrame, lags: int, h: int, names: Sequence[str] = ()) -> DataFrame:
    """Training rows of step h: y, lag_1..lag_{lags}, where lag_1 is the value h rows before, features of y's time."""
    rows = design(y, lags, names, h)
    return rows.select("y", *[F.col(f"lag_{k + h - 1}").alias(f"lag_{k}") for k in range(1, lags + 1)], *names)


StepFit = Callable[[DataFrame, list[str]], Callable[[DataFrame], DataFrame]]


def direct(freq: str, lags: int, max_horizons: int, fit_step: StepFit, extra: Sequence[str] = ()) -> Forecaster:
    """A fitted model for each step: `fit_step(rows, inputs)` gives a function that adds `prediction` (and `extra`)."""

    def fit(y: DataFrame, X: DataFrame | None = None) -> Model:
        p = PanelSpec.of(y)
        rows, names = joined_features(y, X)
        inputs = [*[f"lag_{k}" for k in range(1, lags + 1)], *names]
        steps = {h: fit_step(_direct_rows(rows, lags, h, names), inputs) for h in range(1, max_horizons + 1)}
        last = _last_rows(y, lags)

        def forecast(fh: int, X_future: DataFrame | None = None) -> DataFrame:
            if fh > max_horizons:
                raise ValueError(f"fh {fh} exceeds max_horizons {max_horizons}")
            future = _future_features(y, X_future, names, fh, freq)
            told: DataFrame | None = None
            for h in range(1, fh + 1):
                now = last.join(future.where(F.col("step") == h).select(p.entity, *_known(future, names)), p.entity) if names else last
                one = steps[h](now).select(p.entity, F.lit(h).alias("step"), F.col("prediction").alias(p.values[0]), *extra)
                told = one if told is None else told.unionByName(one)
            return future_of(y.select(p.entity, p.time), fh, freq).join(told, [p.entity, "step"]).select(p.entity, p.time, p.values[0], *extra)

        def residuals() -> DataFrame:
            whole = design(rows, lags, names, max_horizons)
            fitted: DataFrame | None = None
            for h in range(1, max_horizons + 1):
                one = steps[h](whole.select(p.entity, p.time, "y", *[F.col(f"lag_{k + h - 1}").alias(f"lag_{k}") for k in range(1, lags + 1)], *names)).select(p.entity, p.time, "y", "prediction")
                fitted = one if fitted is None else fitted.unionByName(one)
            return fitted.groupBy(p.entity, p.time).agg((F.max("y") - F.avg("prediction")).alias("y_resid"))

        return Model(forecast, residuals=residuals)

    return Forecaster(fit, lags + max_horizons - 1)


def boosted_trees(freq: str, lags: int, max_horizons: int = 1, **params) -> Forecaster:
    """Gradient boosted trees for each step; `params` are those of pyspark.ml's GBTRegressor."""

    def fit_step(rows: DataFrame, inputs: list[str]) -> Callable[[DataFrame], DataFrame]:
        to = VectorAssembler(inputCols=inputs, outputCol="x__")
        model = GBTRegressor(featuresCol="x__", labelCol="y", **({"maxIter": 20, "maxDepth": 4, "seed": 1} | params)).fit(to.transform(rows))
        return lambda new: model.transform(to.transform(new))

    return direct(freq, lags, max_horizons, fit_step)


#: Forecasters known by the names of boosting libraries run on the trees of pyspark.ml.
lightgbm = xgboost = catboost = boosted_trees


def glm(freq: str, lags: int, family: str = "poisson", max_horizons: int = 1, **params) -> Forecaster:
    """Generalised linear model for each step: family gaussian, poisson, gamma or tweedie (log link but for gaussian).
    Labels the family can't take are clamped: below zero to 0 (poisson, tweedie), zero and below to 1 (gamma)."""
    if family not in ("gaussian", "poisson", "gamma", "tweedie"):
        raise ValueError(f"unknown family {family!r}")

    def fit_step(rows: DataFrame, inputs: list[str]) -> Callable[[DataFrame], DataFrame]:
        if family in ("poisson", "tweedie"):
            rows = rows.withColumn("y", F.greatest("y", F.lit(0.0)))
        elif family == "gamma":
            rows = rows.withColumn("y", F.when(F.col("y") > 0, F.col("y")).otherwise(1.0))
        # a log link needs inputs of moderate size: lags by that of lag_1, features each by its own
        own = inputs[lags:]
        most = rows.agg(*[F.max(F.abs(c)).alias(c) for c in ("lag_1", *own)]).first()
        size = {c: max(float(most[c if c in own else "lag_1"] or 1.0), 1e-12) for c in inputs}
        shrunk = lambda new: new.withColumns({c: F.col(c) / size[c] for c in inputs})
        to = VectorAssembler(inputCols=inputs, outputCol="x__")
        link = {"tweedie": {"variancePower": 1.5, "linkPower": 0.0}}.get(family, {"link": "identity" if family == "gaussian" else "log"})
        model = GeneralizedLinearRegression(featuresCol="x__", labelCol="y", family=family, regParam=1e-6, maxIter=50, **(link | params)).fit(to.transform(shrunk(rows)))
        return lambda new: model.transform(to.transform(shrunk(new)))

    return direct(freq, lags, max_horizons, fit_step)


def _linear(rows: DataFrame, inputs: list[str]) -> Callable[[DataFrame], DataFrame]:
    to = VectorAssembler(inputCols=inputs, outputCol="x__")
    model = LinearRegression(featuresCol="x__", labelCol="y", regParam=1e-6).fit(to.transform(rows))
    return lambda new: model.transform(to.transform(new))


def _logistic(rows: DataFrame, inputs: list[str]) -> Callable[[DataFrame], DataFrame]:
    to = VectorAssembler(inputCols=inputs, outputCol="x__")
    model = LogisticRegression(featuresCol="x__", labelCol="over__", probabilityCol="proba__", rawPredictionCol="raw__", predictionCol="class__").fit(to.transform(rows))
    return lambda new: model.transform(to.transform(new)).withColumn("prediction", vector_to_array("proba__")[1])


def censored_model(freq: str, lags: int, threshold: float = 0.0, max_horizons: int = 1, regress: StepFit | None = None, classify: StepFit | None = None) -> Forecaster:
    """P(y > threshold) times the regression on values above it, plus, unless the threshold is 0, P(y <= threshold)
    times the regression on those below. The forecast has `threshold_proba` besides.

    `regress(rows, inputs)` fits y and gives a function that adds `prediction`, by default a linear regression;
    `classify(rows, inputs)` fits over__ (1 above the threshold) and adds `prediction`, the probability, by default a
    logistic regression."""

    def fit_step(rows: DataFrame, inputs: list[str]) -> Callable[[DataFrame], DataFrame]:
        rows = rows.withColumn("over__", (F.col("y") > threshold).cast("double"))
        share = rows.agg(F.avg("over__")).first()[0] or 0.0
        proba = (classify or _logistic)(rows, inputs) if 0 < share < 1 else None
        part = lambda over: (regress or _linear)(rows.where(F.col("over__") == over).drop("over__"), inputs)
        above = part(1.0) if share > 0 else None
        below = part(0.0) if threshold != 0 and share < 1 else None

        def told(fitted: Callable[[DataFrame], DataFrame] | None, new: DataFrame, name: str, other: float) -> DataFrame:
            if fitted is None:
                return new.withColumn(name, F.lit(other))
            return fitted(new).select(*new.columns, F.col("prediction").cast("double").alias(name))

        def predict(new: DataFrame) -> DataFrame:
            out = told(below, told(above, told(proba, new, "threshold_proba", float(share)), "above__", 0.0), "below__", 0.0)
            return out.withColumn("prediction", F.col("threshold_proba") * F.col("above__") + (1 - F.col("threshold_proba")) * F.col("below__"))

        return predict

    return direct(freq, lags, max_horizons, fit_step, ["threshold_proba"])


def zero_inflated_model(freq: str, lags: int, max_horizons: int = 1) -> Forecaster:
    return censored_model(freq, lags, 0.0, max_horizons)


def _stretches(y: DataFrame, lags: int, max_horizons: int, names: Sequence[str] = ()) -> DataFrame:
    """Training stretches: x (array of `lags` values, the last first), next (array of the max_horizons values behind)
    and known (array of the features at the times of `next`, step by step)."""
    p = PanelSpec.of(y)
    w = Window.partitionBy(p.entity).orderBy(p.time)
    each = {f"known_{h}_{i}": F.lag(f, max_horizons - h).over(w) for h in range(1, max_horizons + 1) for i, f in enumerate(names)}
    rows = design(y.withColumns(each) if each else y, lags, list(each), max_horizons)
    ahead = [F.col(f"lag_{max_horizons - h}") if h < max_horizons else F.col("y") for h in range(1, max_horizons + 1)]
    return rows.select(F.array(*[f"lag_{j}" for j in range(max_horizons, max_horizons + lags)]).alias("x"), F.array(*ahead).alias("next"), F.array(*each).cast("array<double>").alias("known"))


def _meeting(y: DataFrame, X: DataFrame | None, freq: str, lags: int, max_horizons: int) -> Callable[[int, DataFrame | None], tuple[DataFrame, DataFrame]]:
    """(fh, X_future) -> (entity, x) of the last stretches and (x, next) of the training ones, where x holds the lags and
    the features of the fh steps ahead, all on the scale they come in."""
    p = PanelSpec.of(y)
    rows, names = joined_features(y, X)
    train, last = _stretches(rows, lags, max_horizons, names), _last_rows(y, lags)
    now = last.select(p.entity, F.array(*[f"lag_{j}" for j in range(1, lags + 1)]).alias("x"))

    def meet(fh: int, X_future: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        if fh > max_horizons:
            raise ValueError(f"fh {fh} exceeds max_horizons {max_horizons}")
        if not names:
            return now, train.select("x", "next")
        future = _future_features(y, X_future, names, fh, freq)
        steps = F.array_sort(F.collect_list(F.struct("step", F.array(*_known(future, names)).alias("f"))))
        known = future.groupBy(p.entity).agg(F.flatten(F.transform(steps, lambda s: s["f"])).alias("known"))
        longer = F.concat("x", F.slice("known", 1, fh * len(names))).alias("x")
        return now.join(known, p.entity).select(p.entity, longer), train.select(longer, "next")

    return meet


def _nearest(now: DataFrame, train: DataFrame, k: int, block: int) -> DataFrame | None:
    """entity, d (squared distance), next: the k training stretches nearest to each query, and more; None without queries.

    Queries go to the workers in blocks and meet all training rows, each partition keeping its k nearest per query."""
    entity = now.columns[0]
    kind = dict(now.dtypes)[entity]

    def nearest(queries: pd.DataFrame) -> DataFrame:
        q, names = np.stack([np.array(x, float) for x in queries.iloc[:, 1]]), queries.iloc[:, 0].to_numpy()

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best_d = np.full((len(q), k), np.inf)
            best_y: np.ndarray | None = None
            for pdf in batches:
                if not len(pdf):
                    continue
                x, nxt = np.stack(pdf["x"].to_list()), np.stack(pdf["next"].to_list())
                if best_y is None:
                    best_y = np.full((len(q), k, nxt.shape[1]), np.nan)
                size = max(16, 4_000_000 // max(1, len(q) * q.shape[1]))
                for a in range(0, len(x), size):
                    some, after = x[a : a + size], nxt[a : a + size]
                    d = ((q[:, None, :] - some[None]) ** 2).sum(2)
                    all_d = np.c_[best_d, d]
                    all_y = np.concatenate([best_y, np.broadcast_to(after, (len(q), *after.shape))], 1)
                    keep = np.argsort(all_d, 1, kind="stable")[:, :k]
                    best_d, best_y = np.take_along_axis(all_d, keep, 1), np.take_along_axis(all_y, keep[:, :, None], 1)
            i, j = np.nonzero(np.isfinite(best_d))
            yield pd.DataFrame({entity: names[i], "d": best_d[i, j], "next": list(best_y[i, j]) if len(i) else []})

        return train.mapInPandas(run, f"`{entity}` {kind}, d double, next array<double>")

    found: DataFrame | None = None
    for queries in blocks_of(now, block):
        one = nearest(queries)
        found = one if found is None else found.unionByName(one)
    return found


def knn(freq: str, lags: int, k: int = 5, max_horizons: int = 1, block: int = 2000) -> Forecaster:
    """Mean of what followed the k training stretches nearest (Euclidean) to an entity's last values.

    The entities' last stretches are the stated queries of an exact search, of which one aggregate keeps the k nearest."""

    def fit(y: DataFrame, X: DataFrame | None = None) -> Model:
        p = PanelSpec.of(y)
        meet = _meeting(y, X, freq, lags, max_horizons)

        def forecast(fh: int, X_future: DataFrame | None = None) -> DataFrame:
            found = _nearest(*meet(fh, X_future), k, block)
            if found is None:
                return y.select(p.entity, p.time, F.col(p.values[0]).cast("double").alias(p.values[0])).limit(0)
            w = Window.partitionBy(p.entity).orderBy("d", "next")
            kept = found.withColumn("r__", F.row_number().over(w)).where(F.col("r__") <= k)
            mean = kept.groupBy(p.entity).agg(F.array(*[F.avg(F.col("next")[h]) for h in range(fh)]).alias("path__"))
            return _with_steps(y, freq, fh, mean)

        return Model(forecast)

    return Forecaster(fit, lags + max_horizons - 1)


def blocks_of(df: DataFrame, size: int) -> Iterator[pd.DataFrame]:
    """Rows of a query table in blocks of `size`; the driver holds one block at a time."""
    held: list[tuple] = []
    for r in df.toLocalIterator():
        held.append(tuple(r))
        if len(held) == size:
            yield pd.DataFrame(held, columns=df.columns)
            held = []
    if held:
        yield pd.DataFrame(held, columns=df.columns)


def ann(freq: str, lags: int, tables: int = 4, width: float | None = None, max_horizons: int = 1, block: int = 2000) -> Forecaster:
    """What followed the nearest training stretch found by random projections (buckets met by equality). Entities that
    share a bucket with no stretch take the exact search of `knn`, so every one that is long enough is forecast."""

    def fit(y: DataFrame, X: DataFrame | None = None) -> Model:
        p = PanelSpec.of(y)
        meet = _meeting(y, X, freq, lags, max_horizons)

        def forecast(fh: int, X_future: DataFrame | None = None) -> DataFrame:
            now, stretches = meet(fh, X_future)
            inputs = [f"x{i}__" for i in range(lags + fh * len(joined_features(y, X)[1]))]
            apart = VectorAssembler(inputCols=inputs, outputCol="x__")
            to = lambda df: apart.transform(df.select("*", *[F.col("x")[i].alias(c) for i, c in enumerate(inputs)]))
            train = to(stretches)
            size = width or max(float(train.agg(F.stddev_pop(F.element_at("next", -1))).first()[0] or 1.0), 1e-6)
            model = BucketedRandomProjectionLSH(inputCol="x__", outputCol="h__", numHashTables=tables, bucketLength=size, seed=1).fit(train)
            pairs = model.approxSimilarityJoin(to(now), train, float("inf"), "d__")
            first = lambda d, v: F.min_by(v, F.struct(d, v)).alias("path__")
            near = written(pairs.groupBy(F.col(f"datasetA.{p.entity}").alias(p.entity)).agg(first(F.col("d__"), F.col("datasetB.next"))))
            rest = _nearest(now.join(near, p.entity, "left_anti"), stretches, 1, block)
            if rest is not None:
                near = near.unionByName(rest.groupBy(p.entity).agg(first(F.col("d"), F.col("next"))))
            return _with_steps(y, freq, fh, near)

        return Model(forecast)

    return Forecaster(fit, lags + max_horizons - 1)


def transformed(base: Forecaster, steps: Sequence[Transform] = (), feature_transform: Callable[[DataFrame], DataFrame] | None = None) -> Forecaster:
    """The forecaster on the transformed target and features; forecasts are transformed back in reverse order."""
    of = lambda X: X if X is None or feature_transform is None else feature_transform(X)

    def fit(y: DataFrame, X: DataFrame | None = None) -> Model:
        done: list[Fitted] = []
        for s in steps:
            done.append(s.fit(y))
            y = done[-1].transformed
        model = base(y, of(X))

        def forecast(fh: int, X_future: DataFrame | None = None) -> DataFrame:
            out = model.forecast(fh, of(X_future))
            for s in reversed(done):
                out = s.invert(out)
            return out

        return Model(forecast, model.weights)

    return Forecaster(fit, base.lags)


# -- backtests, intervals, selection ------------------------------------------------------------------------------


def check_backtest_lengths(y: DataFrame, max_lags: int, test_size: int, drop_short: bool = False, drop_tolerance: float = 2.0) -> DataFrame:
    """Entities with more rows than max_lags + test_size * drop_tolerance; shorter ones are dropped, or raise ValueError."""
    return long_enough(y, int(max_lags + test_size * drop_tolerance) + 1, drop_short)


def windows(strategy: str, test_size: int, n_splits: int, step_size: int, window_size: int = 10) -> Callable[[DataFrame], DataFrame]:
    """A split by name: `expanding` or `sliding`."""
    if strategy == "expanding":
        return lambda y: expanding_window_split(y, test_size, n_splits, step_size)
    if strategy == "sliding":
        return lambda y: sliding_window_split(y, test_size, n_splits, step_size, window_size)
    raise ValueError(f"strategy is expanding or sliding, not {strategy!r}")


def changes(y: DataFrame) -> DataFrame:
    """What the last value misses of each row but the first: entity, time, y_resid."""
    p = PanelSpec.of(y)
    step = F.col(p.values[0]) - F.lag(p.values[0]).over(Window.partitionBy(p.entity).orderBy(p.time))
    return y.select(p.entity, p.time, step.alias("y_resid")).where("y_resid is not null")


def backtest(
    forecaster: Forecaster, y: DataFrame, fh: int, n_splits: int = 5, step_size: int = 1, X: DataFrame | None = None, cv: Callable[[DataFrame], DataFrame] | None = None, residualize: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(predictions, residuals) over the splits of `cv`, expanding windows if none is given: entity, time, value, split and
    entity, time, y_resid, split.

    Residuals are those of the predictions or, with `residualize`, what the models miss of their own training rows, of a
    model of all rows besides (split n_splits); models without fitted values miss the change since the row before.
    Predictions and actual rows meet by (entity, position in the test), as real calendars may have gaps. Training sets of
    a local forecaster are forecast in one pass, each entity and split as one of its own; others take a fit a split."""
    p = PanelSpec.of(y)
    flat = (cv or windows("expanding", fh, n_splits, step_size))(y.select(p.entity, p.time, p.values[0]))
    train, test = flat.where(~F.col("is_test")), flat.where("is_test")
    keys = [p.entity, "split"]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(p.time))
    inside: list[DataFrame] = []
    if getattr(forecaster, "local", False):
        own = train.select(F.struct(*keys).alias(p.entity), p.time, p.values[0])
        ahead = forecaster(own, None).forecast(fh, None)
        pred = ahead.select(F.col(f"{p.entity}.{p.entity}").alias(p.entity), F.col(f"{p.entity}.split").alias("split"), p.time, p.values[0])
        if residualize:
            inside.append(changes(own).select(F.col(f"{p.entity}.{p.entity}").alias(p.entity), p.time, "y_resid", F.col(f"{p.entity}.split").alias("split")))
    else:
        pred = None
        for i in range(n_splits):
            part = train.where(F.col("split") == i).select(p.entity, p.time, p.values[0])
            model = forecaster(part, X)
            one = model.forecast(fh, X).select(p.entity, F.lit(i).alias("split"), p.time, p.values[0])
            pred = one if pred is None else pred.unionByName(one)
            if residualize:
                inside.append((model.residuals() if model.residuals else changes(part)).withColumn("split", F.lit(i)))
    pred = pred.select(*keys, F.col(p.values[0]).alias("p__"), place.alias("k__"))
    real = test.select(*keys, p.time, F.col(p.values[0]).alias("a__"), place.alias("k__"))
    told = real.join(pred, [*keys, "k__"])
    predictions = told.select(p.entity, p.time, F.col("p__").alias(p.values[0]), "split")
    if not residualize:
        return predictions, told.select(p.entity, p.time, (F.col("a__") - F.col("p__")).alias("y_resid"), "split")
    whole = forecaster(y.select(p.entity, p.time, p.values[0]), X)
    inside.append((whole.residuals() if whole.residuals else changes(y)).withColumn("split", F.lit(n_splits)))
    residuals = inside[0]
    for one in inside[1:]:
        residuals = residuals.unionByName(one)
    return predictions, residuals


def enbpi(y_pred: DataFrame, y_resid: DataFrame, alphas: Sequence[float] = (0.1, 0.9)) -> DataFrame:
    """Forecast plus each quantile of its entity's residuals: entity, time, value, quantile (0 to 1)."""
    p = PanelSpec.of(y_pred)
    e, r = y_resid.columns[0], "y_resid"
    quantiles = y_resid.groupBy(F.col(e).alias(p.entity)).agg(*[F.percentile(r, a).alias(f"q{i}__") for i, a in enumerate(alphas)])
    rows = y_pred.select(p.entity, p.time, p.values[0]).join(quantiles, p.entity)
    each = F.explode(F.array(*[F.struct(F.lit(float(a)).alias("q"), F.col(f"q{i}__").alias("r")) for i, a in enumerate(alphas)]))
    return rows.withColumn("x__", each).select(p.entity, p.time, (F.col(p.values[0]) + F.col("x__.r")).alias(p.values[0]), F.col("x__.q").alias("quantile"))


def conformalize(y_pred: DataFrame, y_preds: DataFrame, y_resid: DataFrame, alphas: Sequence[float] = (0.1, 0.9)) -> DataFrame:
    """enbpi over the forecast and all backtest forecasts; quantile in percent."""
    p = PanelSpec.of(y_pred)
    both = y_preds.select(*y_preds.columns[:3]).toDF(p.entity, p.time, p.values[0]).unionByName(y_pred.select(p.entity, p.time, p.values[0]))
    return enbpi(both, y_resid, alphas).withColumn("quantile", F.round(F.col("quantile") * 100).cast("smallint"))


def cv_error(forecaster: Forecaster, y: DataFrame, fh: int, n_splits: int = 3, X: DataFrame | None = None) -> float:
    """Mean over entities of the mean absolute error in backtests."""
    _, resid = backtest(forecaster, y, fh, n_splits, fh, X)
    e = PanelSpec.of(y).entity
    score = resid.groupBy(e).agg(F.avg(F.abs("y_resid")).alias("m")).agg(F.avg("m")).first()[0]
    return float("inf") if score is None else float(score)


def auto(make: Callable[..., Forecaster], freq: str, lags: Sequence[int], fh: int, n_splits: int = 3, grid: Sequence[dict] = ({},)) -> Forecaster:
    """The number of lags and parameters of least backtest error, fitted on all rows. Settings that can't be fitted (as
    too many lags for the series) are passed over with a warning; ValueError if none can."""

    def fit(y: DataFrame, X: DataFrame | None = None) -> Model:
        p = PanelSpec.of(y)
        y = long_enough(y, max(lags) + fh * n_splits + 1)
        scored = []
        for n in lags:
            for params in grid:
                try:
                    scored.append((cv_error(make(freq, n, **params), y.select(p.entity, p.time, p.values[0]), fh, n_splits, X), n, params))
                except (ValueError, np.linalg.LinAlgError) as e:
                    warnings.warn(f"lags {n}, {params}: {e}", stacklevel=2)
        if not scored:
            raise ValueError("no setting could be fitted")
        _, n, params = min(scored, key=lambda s: (s[0], s[1]))
        return make(freq, n, **params)(y, X)

    return Forecaster(fit, max(lags))


def auto_linear_model(freq: str, lags: Sequence[int] = (3, 6, 12), fh: int = 1, **kw) -> Forecaster:
    return auto(linear_model, freq, lags, fh, **kw)


def auto_ridge(freq: str, lags: Sequence[int] = (3, 6, 12), fh: int = 1, alphas: Sequence[float] = (0.1, 1.0, 10.0), **kw) -> Forecaster:
    return auto(ridge, freq, lags, fh, grid=[{"alpha": a} for a in alphas], **kw)


def auto_lasso(freq: str, lags: Sequence[int] = (3, 6, 12), fh: int = 1, alphas: Sequence[float] = (0.01, 0.1, 1.0), **kw) -> Forecaster:
    return auto(lasso, freq, lags, fh, grid=[{"alpha": a} for a in alphas], **kw)


def auto_elastic_net(freq: str, lags: Sequence[int] = (3, 6, 12), fh: int = 1, alphas: Sequence[float] = (0.01, 0.1, 1.0), **kw) -> Forecaster:
    return auto(elastic_net, freq, lags, fh, grid=[{"alpha": a} for a in alphas], **kw)


def auto_knn(freq: str, lags: Sequence[int] = (3, 6), fh: int = 1, ks: Sequence[int] = (1, 5), **kw) -> Forecaster:
    return auto(knn, freq, lags, fh, grid=[{"k": k, "max_horizons": fh} for k in ks], **kw)


def auto_boosted_trees(freq: str, lags: Sequence[int] = (3, 6), fh: int = 1, depths: Sequence[int] = (3, 5), **kw) -> Forecaster:
    return auto(boosted_trees, freq, lags, fh, grid=[{"maxDepth": d, "max_horizons": fh} for d in depths], **kw)


auto_lightgbm = auto_boosted_trees


def elite(base: dict[str, Forecaster], fh: int, top_k: int = 3, n_splits: int = 3, strategy: str = "mean") -> Forecaster:
    """For each entity the forecasts of the top_k base models of least backtest error, put together by their mean or
    (`lasso`) by one regression of all entities' backtests on the forecasts by rank and the step ahead."""
    if strategy not in ("mean", "lasso"):
        raise ValueError(f"strategy is mean or lasso, not {strategy!r}")
    ranks = [f"model_{k}" for k in range(1, top_k + 1)]

    def side_by_side(told: DataFrame, winners: DataFrame, p: PanelSpec, keys: list[str]) -> DataFrame:
        """keys, step__ (position in its window) and a column for each rank, for rows with all of them."""
        rows = told.join(winners, [p.entity, "model"])
        wide = rows.groupBy(*keys).agg(*[F.max(F.when(F.col("r__") == k, F.col(p.values[0]))).alias(c) for k, c in enumerate(ranks, 1)])
        window = Window.partitionBy(*[k for k in keys if k != p.time]).orderBy(p.time)
        return wide.withColumn("step__", F.row_number().over(window).cast("double"))

    def fit(y: DataFrame, X: DataFrame | None = None) -> Model:
        p = PanelSpec.of(y)
        tests: DataFrame | None = None
        for name, f in base.items():
            told, resid = backtest(f, y, fh, n_splits, fh, X)
            one = told.join(resid, [p.entity, p.time, "split"]).withColumn("model", F.lit(name))
            tests = one if tests is None else tests.unionByName(one)
        tests = written(tests)
        scores = tests.groupBy(p.entity, "model").agg(F.avg(F.abs("y_resid")).alias("score"))
        rank = F.row_number().over(Window.partitionBy(p.entity).orderBy("score", "model"))
        winners = written(scores.withColumn("r__", rank).where(F.col("r__") <= top_k).select(p.entity, "model", "r__"))
        weights = None
        if strategy == "lasso":
            real = tests.groupBy(p.entity, p.time, "split").agg(F.first(F.col(p.values[0]) + F.col("y_resid")).alias("y"))
            stack = side_by_side(tests, winners, p, [p.entity, "split", p.time]).join(real, [p.entity, p.time, "split"])
            columns = ["y", *ranks, "step__"]
            weights = informed_lasso(gram(stack.select(*columns).na.drop(), columns)[0])
        models = {name: f(y, X) for name, f in base.items()}

        def forecast(fh: int, X_future: DataFrame | None = None) -> DataFrame:
            told: DataFrame | None = None
            for name, m in models.items():
                one = m.forecast(fh, X_future).select(p.entity, p.time, p.values[0]).withColumn("model", F.lit(name))
                told = one if told is None else told.unionByName(one)
            if weights is None:
                return told.join(winners, [p.entity, "model"]).groupBy(p.entity, p.time).agg(F.avg(p.values[0]).alias(p.values[0]))
            wide = side_by_side(told, winners, p, [p.entity, p.time])
            value = sum((F.col(c) * float(b) for c, b in zip([*ranks, "step__"], weights[1:], strict=True)), F.lit(float(weights[0])))
            return wide.select(p.entity, p.time, value.alias(p.values[0]))

        return Model(forecast, {} if weights is None else {1: weights})

    return Forecaster(fit, max((getattr(f, "lags", 0) for f in base.values()), default=0))


def informed_lasso(g: np.ndarray, steps: int = 30) -> np.ndarray:
    """(intercept, coefficients) of the lasso of least Akaike criterion, from the weakest penalty that leaves no
    coefficient down to none; columns are scaled alike."""
    n, _, a, b, _ = _centred(g)
    scale = np.r_[1.0, 1.0, np.sqrt(np.maximum(np.diag(a) / n, 1e-300))]
    h = g / np.outer(scale, scale)
    most = float(np.abs(b / scale[2:] / n).max())
    best, found = np.inf, None
    for alpha in [*np.geomspace(most, most * 1e-5, steps), 0.0]:
        w = solve(h, "lasso", alpha)
        error = max(squared_error(h, w), 1e-300)
        told = n * np.log(error / n) + 2 * np.count_nonzero(w[1:])
        if told < best:
            best, found = told, np.r_[w[0], w[1:] / scale[2:]]
    return found


def score(model: Model, y_train: DataFrame, y_test: DataFrame, fh: int) -> DataFrame:
    """Eight metrics per entity of a fitted model against what came."""
    return metrics.score_forecast(y_test, model.forecast(fh, None), y_train)

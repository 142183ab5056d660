"""Forecast metrics per entity. Actual and predicted values meet by (entity, time); all metrics of a call share one
join and one aggregate."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.functions.numbers import fdiv
from tidegrid.spec import PanelSpec


def _a() -> Column:
    return F.col("a__")


def _p() -> Column:
    return F.col("p__")


# name -> aggregate over actual a__ and predicted p__
POINT: dict[str, Callable[[], Column]] = {
    "mae": lambda: F.avg(F.abs(_p() - _a())),
    "bias": lambda: F.avg(_p() - _a()),
    "mape": lambda: F.avg(fdiv(F.abs(_a() - _p()), F.abs(_a()))),
    "mse": lambda: F.avg((_p() - _a()) * (_p() - _a())),
    "rmse": lambda: F.sqrt(F.avg((_p() - _a()) * (_p() - _a()))),
    "smape": lambda: fdiv(F.sum(F.abs(_p() - _a())), F.sum(_p() + _a())),
    "smape_original": lambda: 100 * F.avg(2 * F.abs(_p() - _a()) / (F.lit(1e-4) + F.abs(_a()) + F.abs(_p()))),
    "overforecast": lambda: F.coalesce(F.sum(F.when(_p() > _a(), _p())), F.lit(0.0)),
    "underforecast": lambda: F.coalesce(F.sum(F.when(_p() < _a(), _p())), F.lit(0.0)),
}


def matched(y_true: DataFrame, y_pred: DataFrame) -> DataFrame:
    """entity, time, a__, p__: every actual row with the prediction for it (null where there is none)."""
    t, p = PanelSpec.of(y_true), PanelSpec.of(y_pred)
    actual = y_true.select(F.col(t.entity), F.col(t.time), F.col(t.target).cast("double").alias("a__"))
    told = y_pred.select(F.col(p.entity).alias(t.entity), F.col(p.time).alias(t.time), F.col(p.target).cast("double").alias("p__"))
    return actual.join(told, [t.entity, t.time], "left")


def point_metrics(y_true: DataFrame, y_pred: DataFrame, names: Sequence[str]) -> DataFrame:
    e = PanelSpec.of(y_true).entity
    return matched(y_true, y_pred).groupBy(e).agg(*[POINT[n]().alias(n) for n in names])


def _single(name: str) -> Callable[[DataFrame, DataFrame], DataFrame]:
    return lambda y_true, y_pred: point_metrics(y_true, y_pred, [name])


mae, mfe, mape, mse, rmse = map(_single, ("mae", "bias", "mape", "mse", "rmse"))
smape, smape_original, overforecast, underforecast = map(_single, ("smape", "smape_original", "overforecast", "underforecast"))


def _naive_errors(y_train: DataFrame, sp: int) -> DataFrame:
    """Mean absolute and mean squared seasonal difference of the training rows."""
    t = PanelSpec.of(y_train)
    d = F.col(t.target) - F.lag(t.target, sp).over(Window.partitionBy(t.entity).orderBy(t.time))
    rows = y_train.select(t.entity, d.cast("double").alias("d__"))
    return rows.groupBy(t.entity).agg(F.avg(F.abs("d__")).alias("abs__"), F.avg(F.col("d__") * F.col("d__")).alias("sq__"))


def scaled_metrics(y_true: DataFrame, y_pred: DataFrame, y_train: DataFrame, names: Sequence[str], sp: int = 1) -> DataFrame:
    """Point metrics, and mase and rmsse, which relate errors to those of the seasonal naive forecast in training."""
    e = PanelSpec.of(y_true).entity
    plain = list(dict.fromkeys([*[n for n in names if n in POINT], *(["mae"] if "mase" in names else []), *(["mse"] if "rmsse" in names else [])]))
    scale = _naive_errors(y_train, sp).withColumnRenamed(PanelSpec.of(y_train).entity, e)
    out = point_metrics(y_true, y_pred, plain).join(scale, e, "left")
    own = {"mase": lambda: fdiv(F.col("mae"), F.col("abs__")), "rmsse": lambda: F.sqrt(fdiv(F.col("mse"), F.col("sq__")))}
    return out.select(e, *[own[n]().alias(n) if n in own else F.col(n) for n in names])


def mase(y_true: DataFrame, y_pred: DataFrame, y_train: DataFrame, sp: int = 1) -> DataFrame:
    return scaled_metrics(y_true, y_pred, y_train, ["mase"], sp)


def rmsse(y_true: DataFrame, y_pred: DataFrame, y_train: DataFrame, sp: int = 1) -> DataFrame:
    return scaled_metrics(y_true, y_pred, y_train, ["rmsse"], sp)


def _phi(z: pd.Series) -> pd.Series:
    """Distribution function of the standard normal."""
    return pd.Series(np.fromiter((0.5 * (1 + math.erf(x / math.sqrt(2))) for x in z.to_numpy(float)), float, len(z)))


def crps(y_true: DataFrame, y_pred: DataFrame, y_pred_std: DataFrame) -> DataFrame:
    """Mean continuous ranked probability score of normal forecasts (means and standard deviations by key). Keys without
    a forecast, or with a deviation that is null or not positive, have no distribution and don't count."""
    t, s = PanelSpec.of(y_true), PanelSpec.of(y_pred_std)
    spread = y_pred_std.select(F.col(s.entity).alias(t.entity), F.col(s.time).alias(t.time), F.col(s.target).cast("double").alias("s__"))
    rows = matched(y_true, y_pred).join(spread, [t.entity, t.time], "left").where("p__ is not null and s__ > 0").withColumn("z__", (_a() - _p()) / F.col("s__"))
    z = F.col("z__")
    density = F.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    rows = rows.withColumn("phi__", F.pandas_udf(_phi, T.DoubleType())("z__"))
    return rows.groupBy(t.entity).agg(F.avg(F.col("s__") * (z * (2 * F.col("phi__") - 1) + 2 * density - 1 / math.sqrt(math.pi))).alias("crps"))


def _bounded(y_true: DataFrame, lower: DataFrame, upper: DataFrame) -> DataFrame:
    t = PanelSpec.of(y_true)
    side = lambda d, n: d.select(F.col(d.columns[0]).alias(t.entity), F.col(d.columns[1]).alias(t.time), F.col(d.columns[-1]).cast("double").alias(n))
    actual = y_true.select(t.entity, t.time, F.col(t.target).cast("double").alias("a__"))
    return actual.join(side(lower, "l__"), [t.entity, t.time], "left").join(side(upper, "u__"), [t.entity, t.time], "left")


def interval_coverage(y_true: DataFrame, lower: DataFrame, upper: DataFrame) -> DataFrame:
    """Share of actual values inside their interval, bounds included."""
    rows = _bounded(y_true, lower, upper)
    return rows.groupBy(rows.columns[0]).agg(F.avg(_a().between(F.col("l__"), F.col("u__")).cast("double")).alias("interval_coverage"))


def winkler_score(y_true: DataFrame, lower: DataFrame, upper: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Mean interval width, plus 2/alpha times what a value lies outside."""
    rows = _bounded(y_true, lower, upper)
    lo, hi = F.col("l__"), F.col("u__")
    outside = F.when(_a() < lo, lo - _a()).when(_a() > hi, _a() - hi).otherwise(0.0)
    return rows.groupBy(rows.columns[0]).agg(F.avg(hi - lo + 2 / alpha * outside).alias("winkler"))


SCORES = ("mae", "mase", "mse", "overforecast", "rmse", "rmsse", "smape", "underforecast")


def score_forecast(y_true: DataFrame, y_pred: DataFrame, y_train: DataFrame, sp: int = 1) -> DataFrame:
    """Eight metrics per entity from one join and one aggregate."""
    return scaled_metrics(y_true, y_pred, y_train, SCORES, sp)


def score_backtest(y_true: DataFrame, y_preds: DataFrame, y_train: DataFrame, agg_method: str = "mean", sp: int = 1) -> DataFrame:
    """score_forecast of a backtest (entity, time, value, split), splits reduced by mean, median, first or last."""
    e, t, v = y_preds.columns[:3]
    how = {"mean": F.avg(v), "median": F.percentile(v, 0.5), "first": F.min_by(v, "split"), "last": F.max_by(v, "split")}
    if agg_method not in how:
        raise ValueError(f"unknown method {agg_method!r}")
    return score_forecast(y_true, y_preds.groupBy(e, t).agg(how[agg_method].alias(v)), y_train, sp)


def summarize_scores(scores: DataFrame, method: str = "mean") -> DataFrame:
    """One row: mean or median of each metric over entities."""
    f = F.avg if method == "mean" else lambda c: F.percentile(c, 0.5)
    return scores.agg(*[f(c).alias(c) for c in scores.columns[1:]])

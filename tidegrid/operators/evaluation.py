"""Residual checks and rankings of entities."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions.numbers import fdiv
from tidegrid.operators import metrics
from tidegrid.spec import PanelSpec


def _autocorrelations(df: DataFrame, max_lags: int) -> DataFrame:
    """entity, n, rho: array of the textbook autocorrelations of lags 0..max_lags."""
    p = PanelSpec.of(df)
    e, w = Window.partitionBy(p.entity), Window.partitionBy(p.entity).orderBy(p.time)
    rows = df.select(p.entity, p.time, (F.col(p.target) - F.avg(p.target).over(e)).cast("double").alias("d__"))
    rows = rows.select(p.entity, "d__", *[F.lag("d__", k).over(w).alias(f"l{k}__") for k in range(1, max_lags + 1)])
    total = F.sum(F.col("d__") * F.col("d__"))
    rho = F.array(F.lit(1.0), *[fdiv(F.coalesce(F.sum(F.col("d__") * F.col(f"l{k}__")), F.lit(0.0)), total) for k in range(1, max_lags + 1)])
    return rows.groupBy(p.entity).agg(F.count("d__").alias("n"), rho.alias("rho"))


def acf(df: DataFrame, max_lags: int, z: float = 1.959963984540054) -> DataFrame:
    """entity, lag, acf, lower, upper: autocorrelations with Bartlett bounds (z: normal quantile of the level)."""
    a = _autocorrelations(df, max_lags)
    e = a.columns[0]
    rows = a.select(e, "n", "rho", F.posexplode("rho").alias("lag", "acf"))
    before = F.aggregate(F.slice("rho", 2, F.greatest(F.col("lag") - 1, F.lit(0))), F.lit(0.0), lambda s, r: s + r * r)
    half = F.when(F.col("lag") > 0, F.lit(z) * F.sqrt((1 + 2 * before) / F.col("n"))).otherwise(0.0)
    return rows.select(e, "lag", "acf", (F.col("acf") - half).alias("lower"), (F.col("acf") + half).alias("upper"))


def ljung_box_test(df: DataFrame, max_lags: int) -> DataFrame:
    """entity, lag, q: n(n+2) times the running sum of rho_k^2/(n-k)."""
    a = _autocorrelations(df, max_lags)
    e = a.columns[0]
    term = F.transform(F.slice("rho", 2, max_lags), lambda r, k: F.try_divide(r * r, (F.col("n") - k - 1).cast("double")))
    rows = a.select(e, "n", F.posexplode(term).alias("k", "x"))
    w = Window.partitionBy(e).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(e, (F.col("k") + 1).alias("lag"), (F.col("n") * (F.col("n") + 2) * F.sum("x").over(w)).alias("q"))


def normality_test(df: DataFrame) -> DataFrame:
    """entity, k2: D'Agostino and Pearson's K^2; null for fewer than 8 rows or a constant."""
    p = PanelSpec.of(df)
    some = df.groupBy(p.entity).agg(F.count(p.target).cast("double").alias("n"), F.skewness(p.target).alias("b1"), F.kurtosis(p.target).alias("g2"), F.var_pop(p.target).alias("v"))
    n = F.col("n")
    rows = some.withColumn("n", F.when((n >= 8) & (F.col("v") > 0), n))
    # each step is a projection of its own: written out in one expression they'd be too long to compile
    steps = [
        ("y", F.col("b1") * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))),
        ("b2", 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))),
        ("w2", F.sqrt(2 * (F.col("b2") - 1)) - 1),
        ("u", F.col("y") / F.sqrt(2 / (F.col("w2") - 1))),
        ("z1", F.log(F.col("u") + F.sqrt(F.col("u") * F.col("u") + 1)) / F.sqrt(0.5 * F.log("w2"))),
        ("x", (F.col("g2") + 3 - 3 * (n - 1) / (n + 1)) / F.sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5)))),
        ("s", 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))),
        ("a", 6 + 8 / F.col("s") * (2 / F.col("s") + F.sqrt(1 + 4 / (F.col("s") * F.col("s"))))),
        ("t", (1 - 2 / F.col("a")) / (1 + F.col("x") * F.sqrt(2 / (F.col("a") - 4)))),
        ("z2", (1 - 2 / (9 * F.col("a")) - F.signum("t") * F.pow(F.abs("t"), F.lit(1 / 3))) / F.sqrt(2 / (9 * F.col("a")))),
    ]
    for name, column in steps:
        rows = rows.withColumn(name, column)
    return rows.select(p.entity, (F.col("z1") * F.col("z1") + F.col("z2") * F.col("z2")).alias("k2"))


def rank_point_forecasts(y_true: DataFrame, y_pred: DataFrame, sort_by: str = "smape", descending: bool = False) -> DataFrame:
    """Entities in order of a metric of the forecast, or of mean, median, std or cv of the actual values; ties by entity."""
    p = PanelSpec.of(y_true)
    of = {"mean": F.avg(p.target), "median": F.percentile(p.target, 0.5), "std": F.stddev_samp(p.target), "cv": fdiv(F.stddev_samp(p.target), F.avg(p.target))}
    if sort_by not in of and sort_by not in metrics.POINT:
        raise ValueError(f"unknown order {sort_by!r}")
    scores = y_true.groupBy(p.entity).agg(of[sort_by].alias(sort_by)) if sort_by in of else metrics.point_metrics(y_true, y_pred, [sort_by])
    return scores.orderBy(F.desc(sort_by) if descending else F.asc(sort_by), p.entity)


def rank_residuals(y_resids: DataFrame, sort_by: str = "abs_bias", descending: bool = False, max_lags: int = 10) -> DataFrame:
    """Entities in order of bias (mean residual), abs_bias, normality (K^2) or autocorr (Ljung-Box at max_lags)."""
    p = PanelSpec.of(y_resids)
    if sort_by in ("bias", "abs_bias"):
        mean = F.avg(p.target)
        out = y_resids.groupBy(p.entity).agg((mean if sort_by == "bias" else F.abs(mean)).alias(sort_by))
    elif sort_by == "normality":
        out = normality_test(y_resids).withColumnRenamed("k2", "normality")
    elif sort_by == "autocorr":
        out = ljung_box_test(y_resids, max_lags).where(F.col("lag") == max_lags).select(p.entity, F.col("q").alias("autocorr"))
    else:
        raise ValueError(f"unknown order {sort_by!r}")
    return out.orderBy(F.desc(sort_by) if descending else F.asc(sort_by), p.entity)


def rank_fva(y_true: DataFrame, y_pred: DataFrame, y_pred_bench: DataFrame, scoring: str | Callable[[DataFrame, DataFrame], DataFrame] = "smape", descending: bool = False) -> DataFrame:
    """Forecast value added over a benchmark forecast: entity, score, bench, uplift, has_uplift, in order of uplift."""
    score = metrics._single(scoring) if isinstance(scoring, str) else scoring
    a, b = score(y_true, y_pred), score(y_true, y_pred_bench)
    e = a.columns[0]
    both = a.toDF(e, "score").join(b.toDF(e, "bench"), e)
    uplift = F.col("bench") - F.col("score")
    return both.select(e, "score", "bench", uplift.alias("uplift"), (uplift > 0).alias("has_uplift")).orderBy(F.desc("uplift") if descending else F.asc("uplift"), e)

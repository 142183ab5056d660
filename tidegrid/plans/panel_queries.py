"""Queries of transforms, time axis, splits, metrics, forecasts and rankings, with their DuckDB statements.

Panel `m`: monthly order value per nation (25 dense series). Panel `b`: daily closes of `bars`, one row per day."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegrid.operators import evaluation, forecasting, metrics, presentation, seasonality, splits, transforms
from tidegrid.plans.least_squares_sql import least_squares
from tidegrid.sources.panels import table

NATIONS = range(25)  # fixed values: the nation keys

Q = Callable[[SparkSession, str], DataFrame]

M = """WITH m AS (SELECT c_nationkey AS entity, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""
B = """WITH b AS (SELECT series_id, CAST("time" AS DATE) AS day, max(CASE WHEN isnan(close) THEN NULL ELSE close END) AS close FROM bars WHERE "time" IS NOT NULL AND series_id IS NOT NULL GROUP BY 1, 2)"""


def monthly(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    total = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double")
    return rows.groupBy(F.col("c_nationkey").alias("entity"), F.trunc("o_orderdate", "month").alias("month")).agg(total.alias("value"))


def bars(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "bars").where("`time` is not null and series_id is not null")
    return rows.groupBy("series_id", F.col("time").cast("date").alias("day")).agg(F.max(F.when(~F.isnan("close"), F.col("close"))).alias("close"))


def rounded(df: DataFrame, digits: int = 4, *names: str) -> DataFrame:
    """Doubles rounded, so that the order of summation doesn't show."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" and (not names or c in names) else F.col(c) for c, t in df.dtypes])


def lagged(df: DataFrame) -> DataFrame:
    """The naive one-step forecast of every row but the first."""
    e, t, v = df.columns
    return df.withColumn(v, F.lag(v).over(Window.partitionBy(e).orderBy(t))).where(F.col(v).isNotNull())


def _on_m(transform: Callable[[], transforms.Transform], digits: int = 4) -> Q:
    return lambda s, d: rounded(transform()(monthly(s, d)), digits)


def _back(transform: Callable[[], transforms.Transform], digits: int = 3) -> Q:
    def run(s: SparkSession, d: str) -> DataFrame:
        fitted = transform().fit(monthly(s, d))
        return rounded(fitted.invert(fitted.transformed), digits)

    return run


def _lambda(transform: Callable[[], transforms.Transform], s: SparkSession, d: str) -> DataFrame:
    """The likeliest power per entity."""
    return rounded(transform().fit(monthly(s, d)).params.select("entity", F.col("m__value").alias("lambda")), 3)


def _golden_sql(score: str, of: str, rows: str = "", value: str = "") -> str:
    """Golden section on [-2, 2] of a score of x over each entity's list zs, 60 steps; with `rows`, those standardised."""
    score = f"(SELECT {score} FROM (SELECT {{}} AS x))"
    found = f""", z AS ({of}), r AS (WITH RECURSIVE t AS (SELECT entity, zs, 0 AS k, -2.0::DOUBLE AS a, 2.0::DOUBLE AS b FROM z
  UNION ALL SELECT entity, zs, k + 1, CASE WHEN fc < fd THEN a ELSE c END, CASE WHEN fc < fd THEN d ELSE b END FROM (SELECT *, {score.format("c")} AS fc, {score.format("d")} AS fd FROM (SELECT *, b - 0.6180339887498949 * (b - a) AS c, a + 0.6180339887498949 * (b - a) AS d FROM t WHERE k < 60))) SELECT * FROM t)"""
    if not rows:
        return found + " SELECT entity, round((a + b) / 2, 3) + 0.0 AS lambda FROM r WHERE k = 60"
    return found + f", p AS (SELECT entity, (a + b) / 2 AS likely FROM r WHERE k = 60), q AS (SELECT entity, month, {value} AS x FROM ({rows})) SELECT entity, month, round((x - avg(x) OVER e) / stddev_samp(x) OVER e, 4) + 0.0 AS value FROM q WINDOW e AS (PARTITION BY entity)"


POWER_SPREAD = "list_aggregate(list_transform(zs, lambda z: CASE WHEN abs(x) > 1e-9 THEN (exp(x * z) - 1) / x ELSE z END), 'var_pop')"


def _boxcox_sql(rows: str = "", value: str = "") -> str:
    return _golden_sql(f"ln({POWER_SPREAD})", "SELECT entity, list(ln(value) - g) AS zs FROM (SELECT *, avg(ln(value)) OVER (PARTITION BY entity) AS g FROM m WHERE value > 0) GROUP BY 1", rows, value)


def _yeojohnson_sql(rows: str = "", value: str = "") -> str:
    return _golden_sql(f"0.5 * ln({POWER_SPREAD}) - (x - 1) * list_avg(zs)", "SELECT entity, list(ln(1 + value)) AS zs FROM m GROUP BY 1", rows, value)


def _impute(method: str) -> Q:
    return lambda s, d: rounded(transforms.impute(method)(bars(s, d)), 5)


def _metric(f: Callable[[DataFrame, DataFrame], DataFrame], digits: int) -> Q:
    def run(s: SparkSession, d: str) -> DataFrame:
        m = monthly(s, d)
        return rounded(f(m, lagged(m)), digits)

    return run


PAIRS = M + ", p AS (SELECT *, lag(value) OVER (PARTITION BY entity ORDER BY month) AS pred FROM m) "
METRICS = {
    "mae": (metrics.mae, "avg(abs(pred - value))", 8), "mfe": (metrics.mfe, "avg(pred - value)", 8), "mape": (metrics.mape, "avg(abs(value - pred) / abs(value))", 6), "mse": (metrics.mse, "avg((pred - value) * (pred - value))", -3),
    "rmse": (metrics.rmse, "sqrt(avg((pred - value) * (pred - value)))", 2), "smape": (metrics.smape, "sum(abs(pred - value)) / sum(pred + value)", 6), "smape_original": (metrics.smape_original, "100 * avg(2 * abs(pred - value) / (1e-4 + abs(value) + abs(pred)))", 4),
    "overforecast": (metrics.overforecast, "coalesce(sum(pred) FILTER (WHERE pred > value), 0)", 2), "underforecast": (metrics.underforecast, "coalesce(sum(pred) FILTER (WHERE pred < value), 0)", 2),
}
SCALE = "d AS (SELECT entity, avg(abs(value - pred)) AS a, avg((value - pred) * (value - pred)) AS s FROM p GROUP BY 1), l AS (SELECT entity, avg(abs(value - y12)) AS a12, avg((value - y12) * (value - y12)) AS s12 FROM (SELECT *, lag(value, 12) OVER (PARTITION BY entity ORDER BY month) AS y12 FROM m) GROUP BY 1)"


def _wide(s: SparkSession, d: str) -> DataFrame:
    return seasonality.long_to_wide(monthly(s, d), NATIONS)


def prep_one_hot(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "events").select("user_id", "ts", "event_type", "value")
    return transforms.one_hot_encode(["event_type"])(rows)


def cv(kind: str) -> Q:
    def run(s: SparkSession, d: str) -> DataFrame:
        m = monthly(s, d)
        return splits.expanding_window_split(m, 3, 4, 2) if kind == "expanding" else splits.sliding_window_split(m, 3, 4, 2, 12)

    return run


CV = M + """, k AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY month DESC) AS k FROM m), s AS (SELECT unnest(range(4)) AS split), c AS (SELECT split, 3 + 2 * (3 - split) AS cut FROM s)
SELECT entity, month, value, CAST(split AS INT) AS split, (k <= cut) AS is_test FROM k CROSS JOIN c WHERE k > cut - 3 {}"""  # fmt: skip


def _naive_interval(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    m = monthly(s, d)
    p = lagged(m)
    return m, p.withColumn("value", F.col("value") * 0.9), p.withColumn("value", F.col("value") * 1.1)


def metric_crps(s: SparkSession, d: str) -> DataFrame:
    m = monthly(s, d)
    return rounded(metrics.crps(m, lagged(m), m.withColumn("value", F.col("value") * 0.1)), 1)


def score_backtest(s: SparkSession, d: str) -> DataFrame:
    m = monthly(s, d)
    told, _ = forecasting.backtest(forecasting.naive("1mo"), m, 3, 4, 2)
    out = metrics.score_backtest(m, told, m)
    return rounded(out, 4, *[c for c in out.columns if c != "mse"]).withColumn("mse", F.round("mse", -3))


def _forecast(make: Callable[[], forecasting.Forecaster], fh: int, digits: int = 2) -> Q:
    def run(s: SparkSession, d: str) -> DataFrame:
        return rounded(make()(monthly(s, d), None).forecast(fh, None), digits)

    return run


def fc_exogenous(s: SparkSession, d: str) -> DataFrame:
    """Ridge with Fourier terms of the month as features known ahead."""
    m = monthly(s, d)
    months = m.select("month").distinct().unionByName(seasonality.future_of(m, 6, "1mo").select("month").distinct()).distinct()
    k = F.month("month") - 1
    X = months.select("month", F.cos(k * 0.5235987755982988).alias("cos"), F.sin(k * 0.5235987755982988).alias("sin"))
    return rounded(forecasting.ridge("1mo", 6, 1.0)(m, X).forecast(6, X), 0)


def fc_transformed(s: SparkSession, d: str) -> DataFrame:
    f = forecasting.transformed(forecasting.linear_model("1mo", 6), [transforms.detrend("1mo"), transforms.scale()])
    return rounded(f(monthly(s, d), None).forecast(6, None), 2)


def bt(part: int) -> Q:
    def run(s: SparkSession, d: str) -> DataFrame:
        return rounded(forecasting.backtest(forecasting.naive("1mo"), monthly(s, d), 3, 4, 2)[part], 2)

    return run


def conformal_naive(s: SparkSession, d: str) -> DataFrame:
    m = monthly(s, d)
    told, resid = forecasting.backtest(forecasting.naive("1mo"), m, 3, 4, 2)
    ahead = forecasting.naive("1mo")(m, None).forecast(3, None)
    return rounded(forecasting.conformalize(ahead, told, resid), 4)


BT = M + """, k AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY month DESC) AS k FROM m), c AS (SELECT split, 3 + 2 * (3 - split) AS cut FROM (SELECT unnest(range(4)) AS split)),
t AS (SELECT entity, month, value, CAST(split AS INT) AS split, cut FROM k CROSS JOIN c WHERE k <= cut AND k > cut - 3), l AS (SELECT k.entity, split, value AS pred FROM k JOIN c ON k.k = c.cut + 1),
r AS (SELECT t.entity, t.month, t.value, t.split, l.pred FROM t JOIN l ON t.entity = l.entity AND t.split = l.split)"""  # fmt: skip
FUTURE = ", f AS (SELECT entity, max(month) AS last, arg_max(value, month) AS v FROM m GROUP BY 1), h AS (SELECT unnest(range(1, {} + 1)) AS h)"

E = "SELECT entity, month, "
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")  # fixed values: the types that occur
W = "(PARTITION BY entity ORDER BY month)"



def recursive(lags: int, fh: int, ridge: float = 0.0, features: tuple[str, ...] = ()) -> str:
    """One model of `lags` lags (and of `features` of the month) for all nations, forecasts fed back as lags for fh steps."""
    names = [f"l{k}" for k in range(1, lags + 1)]
    extra = [f"x{k}" for k in range(1, len(features) + 1)]
    given = "".join(f", {f} AS {x}" for f, x in zip(features, extra, strict=True))
    rows = ", ".join(f"lag(value, {k}) OVER {W} AS l{k}" for k in range(1, lags + 1))
    step = " + ".join(["b0", *[f"b{k} * l[{k}]" for k in range(1, lags + 1)], *[f"b{lags + k} * {f}" for k, f in enumerate(features, 1)]])
    return f""", d AS (SELECT value AS y, {rows}{given} FROM m), {least_squares("d", "y", [*names, *extra], (), ridge)},
    f AS (SELECT entity, max(month) AS month, list(value ORDER BY month DESC)[1:{lags}] AS l FROM m GROUP BY 1),
    t AS (WITH RECURSIVE t AS (SELECT entity, month, 0 AS h, l FROM f UNION ALL SELECT entity, month, h, list_prepend({step}, l)[1:{lags}] FROM (SELECT entity, CAST(month + INTERVAL 1 MONTH AS DATE) AS month, h + 1 AS h, l FROM t WHERE h < {fh}) CROSS JOIN w) SELECT * FROM t)
    SELECT entity, month, round(l[1], 0) AS value FROM t WHERE h > 0"""


# models of 3 lags on rows that have 6: fed back, and one for each of four steps; the mean of both
ENSEMBLE = f""", d AS (SELECT value AS y, {", ".join(f"lag(value, {k}) OVER {W} AS l{k}" for k in range(1, 7))} FROM m), c AS (SELECT * FROM d WHERE l6 IS NOT NULL), {", ".join(least_squares("c", "y", [f"l{k}" for k in range(h, h + 3)], (), 0.0, f"w{h}") for h in range(1, 5))},
    f AS (SELECT entity, max(month) AS month, list(value ORDER BY month DESC)[1:3] AS l FROM m GROUP BY 1),
    t AS (WITH RECURSIVE t AS (SELECT entity, month, 0 AS h, l FROM f UNION ALL SELECT entity, month, h, list_prepend(b0 + b1 * l[1] + b2 * l[2] + b3 * l[3], l)[1:3] FROM (SELECT entity, CAST(month + INTERVAL 1 MONTH AS DATE) AS month, h + 1 AS h, l FROM t WHERE h < 4) CROSS JOIN w1) SELECT * FROM t),
    g AS ({" UNION ALL ".join(f"SELECT entity, {h} AS h, b0 + b1 * l[1] + b2 * l[2] + b3 * l[3] AS v FROM f CROSS JOIN w{h}" for h in range(1, 5))}) SELECT entity, month, round((l[1] + v) / 2, 0) AS value FROM t JOIN g USING (entity, h)"""

# the five stretches of six months nearest to a nation's last six, and the mean of the three months behind them
KNN = f""", d AS (SELECT {", ".join(f"lag(value, {k}) OVER {W} AS l{k}" for k in range(0, 9))} FROM m), c AS (SELECT * FROM d WHERE l8 IS NOT NULL), f AS (SELECT entity, max(month) AS month, list(value ORDER BY month DESC)[1:6] AS q FROM m GROUP BY 1),
    n AS (SELECT entity, month, l0, l1, l2, row_number() OVER (PARTITION BY entity ORDER BY {" + ".join(f"pow(q[{j}] - l{j + 2}, 2)" for j in range(1, 7))}, l2, l1, l0) AS k FROM f CROSS JOIN c), a AS (SELECT entity, max(month) AS month, [avg(l2), avg(l1), avg(l0)] AS v FROM n WHERE k <= 5 GROUP BY 1)
    SELECT entity, CAST(month + CAST(h AS INT) * INTERVAL 1 MONTH AS DATE) AS month, round(v[h], 2) AS value FROM a CROSS JOIN (SELECT unnest(range(1, 4)) AS h)"""


# Every order; movable days by their span of days in the month (isodow: 1 is Monday).
US_HOLIDAYS = """SELECT o_orderkey, o_orderdate, CASE WHEN m = 1 AND d = 1 THEN 'new_years_day' WHEN m = 1 AND w = 1 AND d BETWEEN 15 AND 21 THEN 'martin_luther_king_jr_day' WHEN m = 2 AND w = 1 AND d BETWEEN 15 AND 21 THEN 'washingtons_birthday'
  WHEN m = 5 AND w = 1 AND d >= 25 THEN 'memorial_day' WHEN m = 6 AND d = 19 AND y >= 2021 THEN 'juneteenth_national_independence_day' WHEN m = 7 AND d = 4 THEN 'independence_day' WHEN m = 9 AND w = 1 AND d <= 7 THEN 'labor_day'
  WHEN m = 10 AND w = 1 AND d BETWEEN 8 AND 14 THEN 'columbus_day' WHEN m = 11 AND d = 11 THEN 'veterans_day' WHEN m = 11 AND w = 4 AND d BETWEEN 22 AND 28 THEN 'thanksgiving_day' WHEN m = 12 AND d = 25 THEN 'christmas_day' END AS "holiday__US"
  FROM (SELECT *, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, isodow(o_orderdate) AS w FROM orders)"""

QUERIES: dict[str, tuple[Q, str | None]] = {
    "prep_reindex": (lambda s, d: transforms.reindex()(bars(s, d)), B + " SELECT e.series_id, t.day, b.close FROM (SELECT DISTINCT series_id FROM b) e CROSS JOIN (SELECT DISTINCT day FROM b) t LEFT JOIN b ON b.series_id = e.series_id AND b.day = t.day"),
    "prep_coerce_dtypes": (lambda s, d: transforms.coerce_dtypes({"entity": "string", "value": "decimal(20,2)"})(monthly(s, d)).withColumn("value", F.col("value").cast("double")), M + " SELECT CAST(entity AS VARCHAR) AS entity, month, value FROM m"),
    "prep_time_to_arange": (lambda s, d: transforms.time_to_arange()(monthly(s, d)), M + f" SELECT entity, CAST(row_number() OVER {W} - 1 AS INT) AS month, value FROM m"),
    "prep_resample": (lambda s, d: rounded(transforms.resample("1d", "sum")(table(s, d, "events").select("user_id", "ts", "value")), 4), "SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS ts, round(sum(value), 4) AS value FROM events GROUP BY 1, 2"),
    "prep_trim": (lambda s, d: transforms.trim("both")(bars(s, d)), B + ", x AS (SELECT series_id, min(day) AS a, max(day) AS z FROM b GROUP BY 1), y AS (SELECT max(a) AS a, min(z) AS z FROM x) SELECT b.* FROM b, y WHERE day >= a AND day <= z"),
    "prep_lag": (lambda s, d: transforms.lag([1, 3])(monthly(s, d)), M + f" SELECT entity, month, value__lag_1, value__lag_3 FROM (SELECT *, lag(value, 1) OVER {W} AS value__lag_1, lag(value, 3) OVER {W} AS value__lag_3, row_number() OVER {W} AS i FROM m) WHERE i > 3"),
    "prep_one_hot_encode": (prep_one_hot, "SELECT user_id, ts, value, " + ", ".join(f"CAST(event_type = '{k}' AS INT) AS event_type__{k}" for k in EVENT_TYPES) + " FROM events"),
    "prep_roll": (
        lambda s, d: rounded(transforms.roll([3, 6], ["mean", "min", "max", "sum", "std", "mlm", "cv"])(monthly(s, d)), 3),
        M + " " + E + ", ".join(f"CASE WHEN i > {w} THEN round({x}, 3) END AS value__rolling_{n}_{w}" for w in (3, 6) for n, x in {"mean": f"avg(value) OVER w{w}", "min": f"min(value) OVER w{w}", "max": f"max(value) OVER w{w}", "sum": f"sum(value) OVER w{w}", "std": f"stddev_samp(value) OVER w{w}", "mlm": f"max(value) OVER w{w} - min(value) OVER w{w}", "cv": f"stddev_samp(value) OVER w{w} / avg(value) OVER w{w}"}.items())
        + f" FROM (SELECT *, row_number() OVER {W} AS i FROM m) WINDOW w3 AS (PARTITION BY entity ORDER BY month ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), w6 AS (PARTITION BY entity ORDER BY month ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)",
    ),
    "prep_scale": (_on_m(transforms.scale, 5), M + " " + E + "round((value - avg(value) OVER e) / stddev_samp(value) OVER e, 5) AS value FROM m WINDOW e AS (PARTITION BY entity)"),
    "prep_scale_inverse": (_back(transforms.scale, 2), M + " SELECT entity, month, round(value, 2) AS value FROM m"),
    "prep_impute_mean": (_impute("mean"), B + " SELECT series_id, day, round(coalesce(close, avg(close) OVER (PARTITION BY series_id)), 5) AS close FROM b"),
    "prep_impute_median": (_impute("median"), B + " SELECT series_id, day, round(coalesce(close, quantile_cont(close, 0.5) OVER (PARTITION BY series_id)), 5) AS close FROM b"),
    "prep_impute_ffill": (_impute("ffill"), B + " SELECT series_id, day, round(last_value(close IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY day), 5) AS close FROM b"),
    "prep_impute_bfill": (_impute("bfill"), B + " SELECT series_id, day, round(first_value(close IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 5) AS close FROM b"),
    "prep_impute_interpolate": (
        _impute("interpolate"),
        B + """, i AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY day) AS i FROM b), j AS (SELECT *, last_value(close IGNORE NULLS) OVER p AS a, last_value(CASE WHEN close IS NOT NULL THEN i END IGNORE NULLS) OVER p AS ai, first_value(close IGNORE NULLS) OVER f AS z, first_value(CASE WHEN close IS NOT NULL THEN i END IGNORE NULLS) OVER f AS zi
        FROM i WINDOW p AS (PARTITION BY series_id ORDER BY day ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY series_id ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) SELECT series_id, day, round(coalesce(close, a + (z - a) * (i - ai) / nullif(zi - ai, 0)), 5) AS close FROM j""",
    ),
    "prep_diff": (_on_m(lambda: transforms.diff(1, 12), 2), M + f" SELECT entity, month, round(v, 2) AS value FROM (SELECT *, value - lag(value, 12) OVER {W} AS v, row_number() OVER {W} AS i FROM m) WHERE i > 12"),
    "prep_diff_inverse": (_back(lambda: transforms.diff(2, 3), 2), M + f" SELECT entity, month, round(value, 2) AS value FROM (SELECT *, row_number() OVER {W} AS i FROM m) WHERE i > 6"),
    "prep_boxcox": (_on_m(transforms.boxcox), None),
    "prep_boxcox_lambda": (lambda s, d: _lambda(transforms.boxcox, s, d), M + _boxcox_sql()),
    "prep_yeojohnson_lambda": (lambda s, d: _lambda(transforms.yeojohnson, s, d), M + _yeojohnson_sql()),
    # standardised afterwards, so that the last digits of the power don't show
    "prep_boxcox_scaled": (lambda s, d: rounded(transforms.scale()(transforms.boxcox()(monthly(s, d))), 4), M + _boxcox_sql("SELECT m.*, likely FROM m JOIN p USING (entity)", "pow(value, likely) * sign(likely)")),
    "prep_yeojohnson_scaled": (lambda s, d: rounded(transforms.scale()(transforms.yeojohnson()(monthly(s, d))), 4), M + _yeojohnson_sql("SELECT m.*, likely FROM m JOIN p USING (entity)", "pow(1 + value, likely) * sign(likely)")),
    "prep_boxcox_inverse": (_back(transforms.boxcox, 2), M + " SELECT entity, month, round(value, 2) AS value FROM m"),
    "prep_yeojohnson": (_on_m(transforms.yeojohnson), None),
    "prep_yeojohnson_inverse": (_back(transforms.yeojohnson, 2), M + " SELECT entity, month, round(value, 2) AS value FROM m"),
    "prep_log1p": (_on_m(transforms.log1p, 8), M + " SELECT entity, month, round(ln(1 + value), 8) AS value FROM m"),
    "prep_detrend": (_on_m(lambda: transforms.detrend("1d"), 1), M + ", t AS (SELECT *, date_diff('day', min(month) OVER (PARTITION BY entity), month) AS t FROM m) SELECT entity, month, round(value - (regr_intercept(value, t) OVER e + regr_slope(value, t) OVER e * t), 1) AS value FROM t WINDOW e AS (PARTITION BY entity)"),
    "prep_detrend_inverse": (_back(lambda: transforms.detrend("1d"), 2), M + " SELECT entity, month, round(value, 2) AS value FROM m"),
    "prep_deseasonalize_fourier": (
        _on_m(lambda: transforms.deseasonalize_fourier(12, 2), 2),
        M + f", x AS (SELECT entity, month, value, cos(2 * pi() * i / 12) AS c1, sin(2 * pi() * i / 12) AS s1, cos(4 * pi() * i / 12) AS c2, sin(4 * pi() * i / 12) AS s2 FROM (SELECT *, (row_number() OVER {W} - 1) % 12 AS i FROM m)), " + least_squares("x", "value", ["c1", "s1", "c2", "s2"], ["entity"])
        + " SELECT entity, month, round(value - b0 - b1 * c1 - b2 * s1 - b3 * c2 - b4 * s2, 2) + 0.0 AS value FROM x JOIN w USING (entity)",
    ),
    "prep_deseasonalize_fourier_inverse": (_back(lambda: transforms.deseasonalize_fourier(12, 2), 2), M + " SELECT entity, month, round(value, 2) AS value FROM m"),
    "prep_fractional_diff": (_on_m(lambda: transforms.fractional_diff(0.5, window_size=3), 5), M + f" SELECT entity, month, round(value - 0.5 * lag(value, 1) OVER {W} - 0.125 * lag(value, 2) OVER {W}, 5) AS value FROM m"),
    "cal_calendar_effects": (
        lambda s, d: seasonality.add_calendar_effects(table(s, d, "events").select("event_id", "ts"), ["minute", "hour", "day", "weekday", "week", "month", "quarter", "year"]),
        "SELECT event_id, ts, " + ", ".join(f"CAST({x} AS VARCHAR) AS {n}" for n, x in {"minute": "minute(ts)", "hour": "hour(ts)", "day": "day(ts)", "weekday": "isodow(ts)", "week": "weekofyear(ts)", "month": "month(ts)", "quarter": "quarter(ts)", "year": "year(ts)"}.items()) + " FROM events",
    ),
    "cal_calendar_dummies": (lambda s, d: seasonality.add_calendar_effects(monthly(s, d), ["quarter"], True), M + " SELECT entity, month, value, " + ", ".join(f"CAST(quarter(month) = {k} AS INT) AS quarter_{k}" for k in range(1, 5)) + " FROM m"),
    "cal_holiday_effects": (lambda s, d: seasonality.add_holiday_effects(table(s, d, "orders").select("o_orderkey", "o_orderdate"), ["US"]), US_HOLIDAYS),
    "cal_future_calendar_effects": (
        lambda s, d: seasonality.make_future_calendar_effects(monthly(s, d).withColumnRenamed("month", "start"), ["month", "year"], 14, "1mo"),
        M + FUTURE.format(14) + ", x AS (SELECT entity, CAST(last + CAST(h AS INT) * INTERVAL 1 MONTH AS DATE) AS start FROM f CROSS JOIN h) SELECT entity, start, CAST(month(start) AS VARCHAR) AS month, CAST(year(start) AS VARCHAR) AS year FROM x",
    ),
    "cal_future_holiday_effects": (lambda s, d: seasonality.make_future_holiday_effects(table(s, d, "events").select(F.col("event_type"), F.col("ts").cast("date").alias("day")), ["US", "UK", "DE", "FR"], 30, "1d"), None),
    "cal_future_ranges": (lambda s, d: seasonality.future_of(monthly(s, d), 14, "1mo"), M + FUTURE.format(14) + " SELECT entity, CAST(last + CAST(h AS INT) * INTERVAL 1 MONTH AS DATE) AS month, CAST(h AS INT) AS step FROM f CROSS JOIN h"),
    "cal_fourier_terms": (
        lambda s, d: rounded(seasonality.add_fourier_terms(monthly(s, d), 12, 2), 6, "cos_12_1", "sin_12_1", "cos_12_2", "sin_12_2"),
        M + " SELECT entity, month, value, " + ", ".join(f"round({f}(2 * pi() * {k} * (i % 12) / 12), 6) + 0.0 AS {f}_12_{k}" for k in (1, 2) for f in ("cos", "sin")) + f" FROM (SELECT *, row_number() OVER {W} - 1 AS i FROM m)",
    ),
    "long_to_wide": (_wide, M + " SELECT month, " + ", ".join(f'max(value) FILTER (WHERE entity = {k}) AS "{k}"' for k in NATIONS) + " FROM m GROUP BY 1"),
    # the entities are looked up
    "wide_to_long": (lambda s, d: seasonality.wide_to_long(seasonality.long_to_wide(monthly(s, d)), "month"), M + ", t AS (SELECT DISTINCT month FROM m), e AS (SELECT DISTINCT entity FROM m) SELECT CAST(e.entity AS VARCHAR) AS entity, t.month, value FROM t CROSS JOIN e LEFT JOIN m ON m.month = t.month AND m.entity = e.entity"),
    "cv_train_test_split": (lambda s, d: splits.train_test_split(monthly(s, d), 0.25)[1], M + ", k AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY month DESC) AS k, count(*) OVER (PARTITION BY entity) AS n FROM m) SELECT entity, month, value FROM k WHERE k <= n - CAST(floor(n * 0.75) AS BIGINT)"),
    "cv_expanding_window_split": (cv("expanding"), CV.format("")),
    "cv_sliding_window_split": (cv("sliding"), CV.format("AND k <= cut + 12")),
    "cv_long_enough": (lambda s, d: splits.long_enough(bars(s, d), 90), B + " SELECT b.* FROM b JOIN (SELECT series_id FROM b GROUP BY 1 HAVING count(*) >= 90) USING (series_id)"),
    "metric_mase": (lambda s, d: (lambda m: rounded(metrics.mase(m, lagged(m), m, 12), 5))(monthly(s, d)), PAIRS + "," + SCALE + " SELECT entity, round(a / a12, 5) AS mase FROM d JOIN l USING (entity)"),
    "metric_rmsse": (lambda s, d: (lambda m: rounded(metrics.rmsse(m, lagged(m), m, 12), 5))(monthly(s, d)), PAIRS + "," + SCALE + " SELECT entity, round(sqrt(s / s12), 5) AS rmsse FROM d JOIN l USING (entity)"),
    # the normal distribution by Simpson's rule over 2000 pieces
    "metric_crps": (
        metric_crps,
        PAIRS + """, z AS (SELECT entity, month, 0.1 * value AS sd, (value - pred) / (0.1 * value) AS z FROM p WHERE pred IS NOT NULL AND value > 0), h AS (SELECT k, CASE WHEN k IN (0, 2000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END AS c FROM (SELECT unnest(range(0, 2001)) AS k)),
        f AS (SELECT entity, month, max(sd) AS sd, max(z) AS z, 0.5 + max(zc) / 6000 * sum(c * exp(-pow(zc * k / 2000, 2) / 2)) / sqrt(2 * pi()) AS phi FROM (SELECT *, greatest(-10, least(10, z)) AS zc FROM z) CROSS JOIN h GROUP BY 1, 2) SELECT entity, round(avg(sd * (z * (2 * phi - 1) + 2 * exp(-z * z / 2) / sqrt(2 * pi()) - 1 / sqrt(pi()))), 1) AS crps FROM f GROUP BY 1""",
    ),
    "metric_interval_coverage": (lambda s, d: rounded(metrics.interval_coverage(*_naive_interval(s, d)), 6), PAIRS + " SELECT entity, round(avg(CASE WHEN pred IS NULL THEN NULL WHEN value BETWEEN pred * 0.9 AND pred * 1.1 THEN 1.0 ELSE 0.0 END), 6) AS interval_coverage FROM p GROUP BY 1"),
    "metric_winkler_score": (lambda s, d: rounded(metrics.winkler_score(*_naive_interval(s, d), 0.1), 6), PAIRS + " SELECT entity, round(avg(pred * 1.1 - pred * 0.9 + 20 * CASE WHEN value < pred * 0.9 THEN pred * 0.9 - value WHEN value > pred * 1.1 THEN value - pred * 1.1 ELSE 0 END), 6) AS winkler FROM p WHERE pred IS NOT NULL GROUP BY 1"),
    "score_forecast": (
        lambda s, d: (lambda m: rounded(metrics.score_forecast(m, lagged(m), m, 12), 6, "mae", "mase", "overforecast", "rmse", "rmsse", "smape", "underforecast").withColumn("mse", F.round("mse", -3)))(monthly(s, d)),
        PAIRS + "," + SCALE + " SELECT entity, round(avg(abs(pred - value)), 6) AS mae, round(max(a) / max(a12), 6) AS mase, round(coalesce(sum(pred) FILTER (WHERE pred > value), 0), 6) AS overforecast, round(avg((pred - value) * (pred - value)), -3) AS mse, round(sqrt(avg((pred - value) * (pred - value))), 6) AS rmse, round(sqrt(max(s) / max(s12)), 6) AS rmsse, round(sum(abs(pred - value)) / sum(pred + value), 6) AS smape, round(coalesce(sum(pred) FILTER (WHERE pred < value), 0), 6) AS underforecast FROM p JOIN d USING (entity) JOIN l USING (entity) GROUP BY 1",
    ),
    "score_backtest": (
        score_backtest,
        BT + f""", p AS (SELECT entity, month, avg(pred) AS pred FROM r GROUP BY 1, 2), q AS (SELECT entity, m.value, pred FROM m JOIN p USING (entity, month)), g AS (SELECT entity, avg(abs(value - y1)) AS a1, avg(pow(value - y1, 2)) AS s1 FROM (SELECT *, lag(value) OVER {W} AS y1 FROM m) GROUP BY 1)
        SELECT entity, round(avg(abs(pred - value)), 4) AS mae, round(avg(abs(pred - value)) / max(a1), 4) AS mase, round(avg(pow(pred - value, 2)), -3) AS mse, round(coalesce(sum(pred) FILTER (WHERE pred > value), 0), 4) AS overforecast, round(sqrt(avg(pow(pred - value, 2))), 4) AS rmse, round(sqrt(avg(pow(pred - value, 2)) / max(s1)), 4) AS rmsse,
          round(sum(abs(pred - value)) / sum(pred + value), 4) AS smape, round(coalesce(sum(pred) FILTER (WHERE pred < value), 0), 4) AS underforecast FROM q JOIN g USING (entity) GROUP BY 1""",
    ),
    "score_summary": (lambda s, d: (lambda m: rounded(metrics.summarize_scores(metrics.point_metrics(m, lagged(m), ["mae", "smape"])), 6))(monthly(s, d)), PAIRS + ", x AS (SELECT entity, avg(abs(pred - value)) AS mae, sum(abs(pred - value)) / sum(pred + value) AS smape FROM p GROUP BY 1) SELECT round(avg(mae), 6) AS mae, round(avg(smape), 6) AS smape FROM x"),
    "eval_acf": (
        lambda s, d: rounded(evaluation.acf(monthly(s, d), 3), 5),
        M + f""", d AS (SELECT entity, month, value - avg(value) OVER (PARTITION BY entity) AS d FROM m), l AS (SELECT *, lag(d, 1) OVER {W} AS l1, lag(d, 2) OVER {W} AS l2, lag(d, 3) OVER {W} AS l3 FROM d),
        a AS (SELECT entity, count(*) AS n, sum(d*d) AS t, [sum(d*d), sum(d*l1), sum(d*l2), sum(d*l3)] AS r FROM l GROUP BY 1), k AS (SELECT unnest(range(4)) AS k),
        h AS (SELECT entity, k, r[k + 1] / t AS x, CASE WHEN k > 0 THEN 1.959963984540054 * sqrt((1 + 2 * (CASE WHEN k > 1 THEN pow(r[2] / t, 2) ELSE 0 END + CASE WHEN k > 2 THEN pow(r[3] / t, 2) ELSE 0 END)) / n) ELSE 0 END AS half FROM a CROSS JOIN k)
        SELECT entity, CAST(k AS INT) AS lag, round(x, 5) AS acf, round(x - half, 5) AS lower, round(x + half, 5) AS upper FROM h""",
    ),
    "eval_ljung_box": (lambda s, d: rounded(evaluation.ljung_box_test(monthly(s, d), 2), 3), M + f", d AS (SELECT entity, month, value - avg(value) OVER (PARTITION BY entity) AS d FROM m), l AS (SELECT *, lag(d, 1) OVER {W} AS l1, lag(d, 2) OVER {W} AS l2 FROM d), a AS (SELECT entity, count(*) AS n, sum(d*l1) / sum(d*d) AS r1, sum(d*l2) / sum(d*d) AS r2 FROM l GROUP BY 1) SELECT entity, 1 AS lag, round(n * (n + 2) * r1 * r1 / (n - 1), 3) AS q FROM a UNION ALL SELECT entity, 2, round(n * (n + 2) * (r1 * r1 / (n - 1) + r2 * r2 / (n - 2)), 3) FROM a"),
    "eval_normality": (
        lambda s, d: rounded(evaluation.normality_test(monthly(s, d)), 4),
        M + """, d AS (SELECT entity, value - avg(value) OVER (PARTITION BY entity) AS d FROM m), a AS (SELECT entity, count(*)::DOUBLE AS n, avg(d*d) AS m2, avg(d*d*d) AS m3, avg(d*d*d*d) AS m4 FROM d GROUP BY 1), b AS (SELECT entity, n, m3 / pow(m2, 1.5) AS g1, m4 / m2 / m2 AS b2 FROM a WHERE n >= 8 AND m2 > 0),
        c AS (SELECT *, g1 * sqrt((n+1)*(n+3)/(6*(n-2))) AS y, 3*(n*n+27*n-70)*(n+1)*(n+3)/((n-2)*(n+5)*(n+7)*(n+9)) AS be, 3*(n-1)/(n+1) AS e, 24*n*(n-2)*(n-3)/((n+1)*(n+1)*(n+3)*(n+5)) AS va, 6*(n*n-5*n+2)/((n+7)*(n+9))*sqrt(6*(n+3)*(n+5)/(n*(n-2)*(n-3))) AS sk FROM b),
        f AS (SELECT *, sqrt(2*(be-1))-1 AS w2, (b2 - e) / sqrt(va) AS x, 6 + 8/sk*(2/sk + sqrt(1 + 4/(sk*sk))) AS ka FROM c), g AS (SELECT *, asinh(y / sqrt(2/(w2-1))) / sqrt(0.5*ln(w2)) AS z1, (1 - 2/ka) / (1 + x*sqrt(2/(ka-4))) AS t FROM f)
        SELECT entity, round(z1*z1 + pow((1 - 2/(9*ka) - sign(t)*pow(abs(t), 1.0/3)) / sqrt(2/(9*ka)), 2), 4) AS k2 FROM g""",
    ),
    "rank_point_forecasts": (lambda s, d: (lambda m: rounded(evaluation.rank_point_forecasts(m, lagged(m), "smape"), 6))(monthly(s, d)), PAIRS + " SELECT entity, round(sum(abs(pred - value)) / sum(pred + value), 6) AS smape FROM p GROUP BY 1"),
    "rank_residuals": (lambda s, d: (lambda m: rounded(evaluation.rank_residuals(forecasting.backtest(forecasting.naive("1mo"), m, 3, 4, 2)[1].select("entity", "month", "y_resid"), "abs_bias"), 8))(monthly(s, d)), BT + " SELECT entity, round(abs(avg(value - pred)), 8) AS abs_bias FROM r GROUP BY 1"),
    "rank_fva": (
        lambda s, d: (lambda m: rounded(evaluation.rank_fva(m, lagged(m), m.withColumn("value", F.col("value") * 1.3), "mae"), 7))(monthly(s, d)),
        PAIRS + ", x AS (SELECT entity, avg(abs(pred - value)) AS score, avg(abs(value * 1.3 - value)) AS bench FROM p GROUP BY 1) SELECT entity, round(score, 7) AS score, round(bench, 7) AS bench, round(bench - score, 7) AS uplift, bench - score > 0 AS has_uplift FROM x",
    ),
    "fc_naive": (_forecast(lambda: forecasting.naive("1mo"), 6), M + FUTURE.format(6) + " SELECT entity, CAST(last + CAST(h AS INT) * INTERVAL 1 MONTH AS DATE) AS month, round(v, 2) AS value FROM f CROSS JOIN h"),
    "fc_snaive": (_forecast(lambda: forecasting.snaive("1mo", 12), 14), M + FUTURE.format(14) + f", k AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY month DESC) AS k FROM m) SELECT f.entity, CAST(last + CAST(h AS INT) * INTERVAL 1 MONTH AS DATE) AS month, round(k.value, 2) AS value FROM f CROSS JOIN h JOIN k ON k.entity = f.entity AND k.k = 12 - (h - 1) % 12"),
    "fc_linear_model": (_forecast(lambda: forecasting.linear_model("1mo", 3), 6, 0), M + recursive(3, 6)),
    "fc_linear_direct": (
        _forecast(lambda: forecasting.linear_model("1mo", 1, strategy="direct", max_horizons=2), 2, 1),
        M + FUTURE.format(2) + f", x AS (SELECT value AS y, lag(value, 1) OVER {W} AS l1, lag(value, 2) OVER {W} AS l2 FROM m), w AS (SELECT 1 AS h, regr_slope(y, l1) AS b, regr_intercept(y, l1) AS a FROM x WHERE l2 IS NOT NULL UNION ALL SELECT 2, regr_slope(y, l2), regr_intercept(y, l2) FROM x WHERE l2 IS NOT NULL) SELECT entity, CAST(last + CAST(w.h AS INT) * INTERVAL 1 MONTH AS DATE) AS month, round(a + b * v, 1) AS value FROM f CROSS JOIN w",
    ),
    "fc_linear_ensemble": (_forecast(lambda: forecasting.linear_model("1mo", 3, strategy="ensemble", max_horizons=4), 4, 0), M + ENSEMBLE),
    "fc_ridge": (_forecast(lambda: forecasting.ridge("1mo", 6), 6, 0), M + recursive(6, 6, 1.0)),
    "fc_lasso": (_forecast(lambda: forecasting.lasso("1mo", 6), 6), None),
    "fc_elastic_net": (_forecast(lambda: forecasting.elastic_net("1mo", 6), 6), None),
    "fc_ridge_cv": (_forecast(lambda: forecasting.ridge_cv("1mo", 6), 6), None),
    "fc_lasso_cv": (_forecast(lambda: forecasting.lasso_cv("1mo", 6), 6), None),
    "fc_elastic_net_cv": (_forecast(lambda: forecasting.elastic_net_cv("1mo", 6), 6), None),
    "fc_exogenous": (fc_exogenous, M + recursive(6, 6, 1.0, ("cos((month(month) - 1) * 0.5235987755982988)", "sin((month(month) - 1) * 0.5235987755982988)"))),
    "fc_transformed": (fc_transformed, None),
    "fc_boosted_trees": (_forecast(lambda: forecasting.boosted_trees("1mo", 6, 2, maxIter=5), 2), None),
    "fc_glm_poisson": (_forecast(lambda: forecasting.glm("1mo", 3, "poisson"), 1), None),
    "fc_glm_gamma": (_forecast(lambda: forecasting.glm("1mo", 3, "gamma"), 1), None),
    "fc_glm_tweedie": (_forecast(lambda: forecasting.glm("1mo", 3, "tweedie"), 1), None),
    "fc_knn": (_forecast(lambda: forecasting.knn("1mo", 6, 5, 3), 3), M + KNN),
    "fc_ann": (_forecast(lambda: forecasting.ann("1mo", 6), 1), None),
    "fc_censored": (_forecast(lambda: forecasting.censored_model("1mo", 3, 1e6), 1), None),
    "fc_zero_inflated": (_forecast(lambda: forecasting.zero_inflated_model("1mo", 3), 1), None),
    "fc_auto_linear_model": (_forecast(lambda: forecasting.auto_linear_model("1mo", (3, 6), 3, n_splits=2), 3), None),
    "fc_auto_ridge": (_forecast(lambda: forecasting.auto_ridge("1mo", (3,), 3, (0.1, 10.0), n_splits=2), 3), None),
    "fc_auto_lasso": (_forecast(lambda: forecasting.auto_lasso("1mo", (3,), 3, (0.1, 1.0), n_splits=2), 3), None),
    "fc_auto_elastic_net": (_forecast(lambda: forecasting.auto_elastic_net("1mo", (3,), 3, (0.1, 1.0), n_splits=2), 3), None),
    "fc_auto_knn": (_forecast(lambda: forecasting.auto_knn("1mo", (3,), 2, (1, 5), n_splits=2), 2), None),
    "fc_auto_boosted_trees": (_forecast(lambda: forecasting.auto_boosted_trees("1mo", (3,), 1, (3,), n_splits=1), 1), None),
    "fc_elite": (_forecast(lambda: forecasting.elite({"naive": forecasting.naive("1mo"), "snaive": forecasting.snaive("1mo", 12), "ridge": forecasting.ridge("1mo", 6)}, 3, 2, 2), 3), None),
    "bt_naive": (bt(0), BT + " SELECT entity, month, round(pred, 2) AS value, split FROM r"),
    "bt_naive_residuals": (bt(1), BT + " SELECT entity, month, round(value - pred, 2) AS y_resid, split FROM r"),
    "conformal_naive": (
        conformal_naive,
        BT + FUTURE.format(3) + ", q AS (SELECT entity, quantile_cont(value - pred, 0.1) AS q10, quantile_cont(value - pred, 0.9) AS q90 FROM r GROUP BY 1), a AS (SELECT entity, month, pred AS v FROM r UNION ALL SELECT entity, CAST(last + CAST(h AS INT) * INTERVAL 1 MONTH AS DATE), v FROM f CROSS JOIN h) SELECT entity, month, round(v + q10, 4) AS value, CAST(10 AS SMALLINT) AS quantile FROM a JOIN q USING (entity) UNION ALL SELECT entity, month, round(v + q90, 4), CAST(90 AS SMALLINT) FROM a JOIN q USING (entity)",
    ),
    "plot_entity_counts": (lambda s, d: presentation.entity_counts(bars(s, d)), B + " SELECT series_id, count(*) AS n FROM b GROUP BY 1"),
    "plot_panel_tails": (lambda s, d: presentation.panel_tails(monthly(s, d), presentation.chosen_entities(monthly(s, d), 5), 12), M + " SELECT entity, month, value FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY month DESC) AS k FROM m) WHERE k <= 12 AND entity IN (SELECT DISTINCT entity FROM m ORDER BY 1 LIMIT 5)"),
    "plot_residual_histogram": (lambda s, d: presentation.residual_histogram(forecasting.backtest(forecasting.naive("1mo"), monthly(s, d), 3, 4, 2)[1].select("entity", "month", "y_resid"), 10), BT + ", top AS (SELECT max(abs(value - pred)) AS t FROM r) SELECT entity, CAST(least(floor((value - pred + t) * 10 / (2 * t)), 9) AS INT) AS bin, count(*) AS n FROM r CROSS JOIN top GROUP BY 1, 2"),
    "plot_comet": (lambda s, d: (lambda m: rounded(presentation.comet(m, m, lagged(m)), 5))(monthly(s, d)), PAIRS + " SELECT entity, round(stddev_samp(value) / avg(value), 5) AS cv, round(sum(abs(pred - value)) / sum(pred + value), 5) AS smape FROM p GROUP BY 1"),
    "narrate_prompt": (lambda s, d: s.createDataFrame([(presentation.narrate(monthly(s, d), [0, 1], "monthly order value"),)], "prompt string"), None),
}
QUERIES |= {f"metric_{n}": (_metric(f, k), PAIRS + f" SELECT entity, round({x}, {k}) AS {'bias' if n == 'mfe' else n} FROM p GROUP BY 1") for n, (f, x, k) in METRICS.items()}


def queries() -> dict[str, Q]:
    return {n: q for n, (q, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {n: x for n, (_, x) in QUERIES.items() if x}

"""Queries of the per-series features over `events`, and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.functions import features as f
from tidegrid.functions import kernels as k
from tidegrid.plans.least_squares_sql import least_squares
from tidegrid.sources.panels import table

Q = Callable[[SparkSession, str], DataFrame]

#: The ordered series with the window columns that the statements below use.
SERIES = """
WITH b AS (SELECT user_id, ts, value AS v, row_number() OVER w - 1 AS i, count(*) OVER e AS n, avg(value) OVER e AS mean, min(value) OVER e AS low, max(value) OVER e AS high,
  stddev_pop(value) OVER e AS sd0, lag(value, 1) OVER w AS l1, lag(value, 2) OVER w AS l2, lag(value, 4) OVER w AS l4, lead(value, 1) OVER w AS f1, lead(value, 2) OVER w AS f2, lead(value, 4) OVER w AS f4,
  count(*) OVER (PARTITION BY user_id, value) AS copies, row_number() OVER (PARTITION BY user_id, value ORDER BY ts) AS copy, row_number() OVER (PARTITION BY user_id ORDER BY abs(value) DESC) AS absrank,
  sum(abs(value)) OVER (PARTITION BY user_id ORDER BY ts, value ROWS UNBOUNDED PRECEDING) AS mass, sum(abs(value)) OVER e AS mass_all,
  quantile_cont(value, 0.1) OVER e AS q10, quantile_cont(value, 0.9) OVER e AS q90
  FROM events WINDOW e AS (PARTITION BY user_id), w AS (PARTITION BY user_id ORDER BY ts, value)),
s AS (SELECT *, v - l1 AS d FROM b)
"""

# name: (feature, SQL aggregate over s, digits to round to; None: not a double)
PLAIN: dict[str, tuple[f.Feature, str, int | None]] = {
    "absolute_energy": (f.absolute_energy(), "sum(v*v)", 4),
    "absolute_maximum": (f.absolute_maximum(), "max(abs(v))", 4),
    "absolute_sum_of_changes": (f.absolute_sum_of_changes(), "coalesce(sum(abs(d)), 0)", 4),
    "autocorrelation": (f.autocorrelation(2), "avg((v-mean)*(l2-mean))/var_pop(v)", 5),
    "benford_correlation": (
        f.benford_correlation(),
        "(SELECT corr(c, log10(1+1.0/x)) FROM (SELECT unnest(range(1,10)) AS x, unnest([" + ",".join(f"count(*) FILTER (WHERE v <> 0 AND regexp_extract(CAST(abs(v) AS VARCHAR), '[1-9]') = '{x}')" for x in range(1, 10)) + "]) AS c))",
        5,
    ),
    "c3": (f.c3(2), "avg(v*l2*l4)", 2),
    "cid_ce": (f.cid_ce(), "sqrt(sum(d*d))", 4),
    "cid_ce_normalized": (f.cid_ce(True), "sqrt(sum(d*d))/stddev_pop(v)", 5),
    "count_above": (f.count_above(20.0), "100.0*count(*) FILTER (WHERE v>=20)/count(*)", 9),
    "count_above_mean": (f.count_above_mean(), "count(*) FILTER (WHERE v>mean)", None),
    "count_below": (f.count_below(20.0), "100.0*count(*) FILTER (WHERE v<=20)/count(*)", 9),
    "count_below_mean": (f.count_below_mean(), "count(*) FILTER (WHERE v<mean)", None),
    "first_location_of_maximum": (f.first_location_of_maximum(), "min(i) FILTER (WHERE v=high)/count(*)", 9),
    "first_location_of_minimum": (f.first_location_of_minimum(), "min(i) FILTER (WHERE v=low)/count(*)", 9),
    "last_location_of_maximum": (f.last_location_of_maximum(), "(max(i) FILTER (WHERE v=high)+1)/count(*)", 9),
    "last_location_of_minimum": (f.last_location_of_minimum(), "(max(i) FILTER (WHERE v=low)+1)/count(*)", 9),
    "has_duplicate": (f.has_duplicate(), "count(*) > count(DISTINCT v)", None),
    "has_duplicate_max": (f.has_duplicate_max(), "count(*) FILTER (WHERE v=high) > 1", None),
    "has_duplicate_min": (f.has_duplicate_min(), "count(*) FILTER (WHERE v=low) > 1", None),
    "index_mass_quantile": (f.index_mass_quantile(0.5), "(min(i) FILTER (WHERE mass >= 0.5*mass_all)+1)/count(*)", 9),
    "large_standard_deviation": (f.large_standard_deviation(), "stddev_samp(v) > 0.25*(max(v)-min(v))", None),
    "max_abs_change": (f.max_abs_change(), "max(abs(d))", 4),
    "mean_abs_change": (f.mean_abs_change(), "avg(abs(d))", 9),
    "mean_change": (f.mean_change(), "(arg_max(v,i)-arg_min(v,i))/(count(*)-1)", 9),
    "mean_n_absolute_max": (f.mean_n_absolute_max(3), "avg(abs(v)) FILTER (WHERE absrank<=3)", 9),
    "mean_second_derivative_central": (f.mean_second_derivative_central(), "(max(v) FILTER (WHERE i=n-1)-max(v) FILTER (WHERE i=n-2)-max(v) FILTER (WHERE i=1)+max(v) FILTER (WHERE i=0))/(2.0*(count(*)-2))", 9),
    "number_crossings": (f.number_crossings(20.0), "count(*) FILTER (WHERE (v>20) <> (l1>20))", None),
    "number_peaks": (f.number_peaks(2), "count(*) FILTER (WHERE v>l1 AND v>l2 AND v>f1 AND v>f2)", None),
    "percent_reoccurring_points": (f.percent_reoccurring_points(), "avg(CASE WHEN copies>1 THEN 1.0 ELSE 0.0 END)", 9),
    "percent_reoccurring_values": (f.percent_reoccurring_values(), "avg(CASE WHEN copies>1 THEN 1.0 ELSE 0.0 END) FILTER (WHERE copy=1)", 9),
    "range_change": (f.range_change(False), "max(v)-min(v)", 4),
    "range_count": (f.range_count(10.0, 30.0), "count(*) FILTER (WHERE v>=10 AND v<30)", None),
    "range_over_mean": (f.range_over_mean(), "(max(v)-min(v))/avg(v)", 5),
    "ratio_beyond_r_sigma": (f.ratio_beyond_r_sigma(1.0), "avg(CASE WHEN abs(v-mean)>sd0 THEN 1.0 ELSE 0.0 END)", 9),
    "ratio_n_unique_to_length": (f.ratio_n_unique_to_length(), "count(DISTINCT v)/count(*)", 9),
    "root_mean_square": (f.root_mean_square(), "sqrt(avg(v*v))", 4),
    "sum_reoccurring_points": (f.sum_reoccurring_points(), "coalesce(sum(v) FILTER (WHERE copies>1), 0)", 4),
    "sum_reoccurring_values": (f.sum_reoccurring_values(), "coalesce(sum(v) FILTER (WHERE copies>1 AND copy=1), 0)", 4),
    "symmetry_looking": (f.symmetry_looking(), "abs(avg(v)-quantile_cont(v,0.5)) < 0.25*(max(v)-min(v))", None),
    "time_reversal_asymmetry_statistic": (f.time_reversal_asymmetry_statistic(2), "avg(f2*(f4+v)*(f4-v))", 2),
    "var_gt_std": (f.var_gt_std(), "var_samp(v) >= 1", None),
    "variation_coefficient": (f.variation_coefficient(), "stddev_pop(v)/avg(v)", 5),
    "harmonic_mean": (f.harmonic_mean(), "CASE WHEN min(abs(v)) = 0 THEN 0 ELSE count(*)/sum(1/v) FILTER (WHERE v<>0) END", 4),
}

STREAKS = """, g AS (SELECT user_id, i, d, coalesce({flag}, false) AS f FROM s),
r AS (SELECT user_id, f, i - row_number() OVER (PARTITION BY user_id, f ORDER BY i) AS k FROM g),
x AS (SELECT user_id, f, k, count(*) AS m FROM r GROUP BY 1, 2, 3)
SELECT user_id, CAST(coalesce(max(m) FILTER (WHERE f), 0) AS BIGINT) AS {name} FROM x GROUP BY 1"""
STREAK_FEATURES = {
    "longest_streak_above_mean": (f.longest_streak_above_mean(), "v > mean"),
    "longest_streak_below_mean": (f.longest_streak_below_mean(), "v < mean"),
    "longest_streak_above": (f.longest_streak_above(1.0), "d >= 1"),
    "longest_streak_below": (f.longest_streak_below(-1.0), "d <= -1"),
    "longest_winning_streak": (f.longest_winning_streak(), "d >= 0"),
    "longest_losing_streak": (f.longest_losing_streak(), "d <= 0"),
}

KERNELS: dict[str, k.Kernel] = {
    "approximate_entropy": k.approximate_entropy(2, 0.5),
    "augmented_dickey_fuller": k.augmented_dickey_fuller(2),
    "autoregressive_coefficients": k.autoregressive_coefficients(2),
    "cusum": k.cusum(5.0, 20, 1.0),
    "cwt_coefficients": k.cwt_coefficients(),
    "fft_coefficients": k.fft_coefficients(),
    "fourier_entropy": k.fourier_entropy(),
    "friedrich_coefficients": k.friedrich_coefficients(),
    "lempel_ziv_complexity": k.lempel_ziv_complexity(20.0),
    "number_cwt_peaks": k.number_cwt_peaks(),
    "sample_entropy": k.sample_entropy(),
    "spkt_welch_density": k.spkt_welch_density(8),
}


#: Digits to which kernels with a statement are rounded, so that the order of summation doesn't show.
KERNEL_DIGITS = {"approximate_entropy": 6, "sample_entropy": 6, "autoregressive_coefficients": 5, "augmented_dickey_fuller": 4, "cusum": 1, "cwt_coefficients": 4, "fft_coefficients": 4, "spkt_welch_density": 4, "fourier_entropy": 6, "lempel_ziv_complexity": 9}

_PAIRS = """, e AS (SELECT user_id, max(n) AS n, {level} * {sd}(v) AS r FROM s GROUP BY 1),
p AS (SELECT a.user_id, a.i, max(a.n) AS n, count(*) FILTER (WHERE abs(a.v - b.v) <= r AND abs(a.f1 - b.f1) <= r) AS c2, count(*) FILTER (WHERE abs(a.v - b.v) <= r AND abs(a.f1 - b.f1) <= r AND abs(a.f2 - b.f2) <= r) AS c3
  FROM s a JOIN s b ON a.user_id = b.user_id JOIN e ON e.user_id = a.user_id GROUP BY 1, 2)"""
# power density of Hann windows of up to 256 values, half overlapping
_WELCH = """, u AS (SELECT user_id, max(n) AS n, least(max(n), 256) AS w FROM s GROUP BY 1), g AS (SELECT user_id, w, unnest(range(0, n - w + 1, greatest(1, w - w // 2))) AS a FROM u),
h AS (SELECT s.user_id, g.w, a, i - a AS t, v - avg(v) OVER (PARTITION BY s.user_id, a) AS d, CASE WHEN g.w > 1 THEN 0.5 - 0.5 * cos(2 * pi() * (i - a) / g.w) ELSE 1 END AS c FROM s JOIN g ON g.user_id = s.user_id AND i >= a AND i < a + g.w),
q AS (SELECT user_id, w, a, k, (pow(sum(d * c * cos(2 * pi() * k * t / w)), 2) + pow(sum(d * c * sin(2 * pi() * k * t / w)), 2)) / sum(c * c) * CASE WHEN k >= 1 AND k < (w + 1) // 2 THEN 2 ELSE 1 END AS x FROM h, (SELECT unnest(range(0, 129)) AS k) WHERE k <= w // 2 GROUP BY 1, 2, 3, 4),
d AS (SELECT user_id, k, avg(x) AS x FROM q GROUP BY 1, 2)"""


def _kernel_sql() -> dict[str, str]:
    one = lambda name, rest: f"{SERIES}{rest}"
    # SERIES ends with s; its window columns are v, i, n, l1, l2, l4, f1, f2
    out = {
        "approximate_entropy": _PAIRS.format(level=0.5, sd="stddev_samp") + " SELECT user_id, 0 AS place, round(abs(avg(ln(c2 / (n - 1))) FILTER (WHERE i <= n - 2) - avg(ln(c3 / (n - 2))) FILTER (WHERE i <= n - 3)), 6) AS approximate_entropy FROM p GROUP BY 1",
        "sample_entropy": _PAIRS.format(level=0.2, sd="stddev_pop")
        + """, t AS (SELECT user_id, sum(c2) - max(n) + 1 AS b, sum(c3) - max(n) + 2 AS a, max(n) AS n FROM p GROUP BY 1) SELECT user_id, 0 AS place, CASE WHEN n < 3 THEN 'nan'::DOUBLE WHEN a > 0 AND b > 0 THEN round(ln(b / a), 6) WHEN b > 0 THEN 'inf'::DOUBLE ELSE 'nan'::DOUBLE END AS sample_entropy FROM t""",
        "autoregressive_coefficients": f", z AS (SELECT * FROM s WHERE n >= 5), {least_squares('z', 'v', ['l1', 'l2'], ['user_id'])}, o AS (SELECT user_id, unnest([b1, b2, b0]) AS x, unnest([0, 1, 2]) AS place FROM w) SELECT user_id, CAST(place AS INT) AS place, round(x, 5) + 0.0 AS autoregressive_coefficients FROM o",
        "cusum": """, r AS (WITH RECURSIVE c AS (SELECT user_id, CAST(-1 AS BIGINT) AS i, CAST(0 AS BIGINT) AS k, 0.0::DOUBLE AS m, 0.0::DOUBLE AS q, 0.0::DOUBLE AS up, 0.0::DOUBLE AS down, 0 AS hit FROM s WHERE i = 0
  UNION ALL SELECT user_id, i, CASE WHEN hit = 1 THEN 0 WHEN k < 20 THEN k + 1 ELSE k END, CASE WHEN hit = 1 THEN 0 WHEN k < 20 THEN m + v ELSE m END, CASE WHEN hit = 1 THEN 0 WHEN k < 20 THEN q + v * v ELSE q END, CASE WHEN hit = 1 OR k < 20 THEN 0 ELSE up END, CASE WHEN hit = 1 OR k < 20 THEN 0 ELSE down END, hit
  FROM (SELECT *, CASE WHEN k >= 20 AND (up > 5 OR down > 5) THEN 1 ELSE 0 END AS hit FROM (SELECT user_id, i, v, k, m, q, greatest(0, pu + z - 1) AS up, greatest(0, pd - z - 1) AS down FROM (SELECT c.user_id, s.i, s.v, c.k, c.m, c.q, c.up AS pu, c.down AS pd,
    CASE WHEN c.k >= 20 AND c.q / 20 > pow(c.m / 20, 2) THEN (s.v - c.m / 20) / sqrt(c.q / 20 - pow(c.m / 20, 2)) ELSE 0 END AS z FROM c JOIN s ON s.user_id = c.user_id AND s.i = c.i + 1)))) SELECT * FROM c)
SELECT user_id, CAST(i AS INT) AS place, CAST(hit AS DOUBLE) AS cusum FROM r WHERE i >= 0""",
        "cwt_coefficients": """, x AS (SELECT unnest([2, 5, 10, 20]) AS w, unnest([0, 1, 2, 3]) AS j), y AS (SELECT user_id, n, w, j, least(10 * w, n) AS m FROM (SELECT DISTINCT user_id, n FROM s) CROSS JOIN x),
z AS (SELECT y.user_id, k, j, sum(CASE WHEN k + (m - 1) // 2 - i BETWEEN 0 AND m - 1 THEN v * 2 / (sqrt(3 * w) * pow(pi(), 0.25)) * (1 - pow((k + (m - 1) // 2 - i - (m - 1) / 2) / w, 2)) * exp(-pow((k + (m - 1) // 2 - i - (m - 1) / 2) / w, 2) / 2) ELSE 0 END) AS c
  FROM y JOIN s ON s.user_id = y.user_id CROSS JOIN (SELECT unnest(range(14)) AS k) WHERE k < y.n GROUP BY 1, 2, 3) SELECT user_id, CAST(k * 4 + j AS INT) AS place, round(c, 4) + 0.0 AS cwt_coefficients FROM z""",
        "fft_coefficients": """, z AS (SELECT user_id, n, k, sum(v * cos(2 * pi() * k * i / n)) AS re, CASE WHEN k = 0 OR 2 * k = n THEN 0 ELSE -sum(v * sin(2 * pi() * k * i / n)) END AS im FROM s, (SELECT unnest(range(0, 2000)) AS k) WHERE k <= n // 2 GROUP BY 1, 2, 3),
o AS (SELECT user_id, n // 2 + 1 AS m, k, unnest([re, im, degrees(atan2(im, re))]) AS x, unnest([0, 1, 2]) AS part FROM z) SELECT user_id, CAST(part * m + k AS INT) AS place, round(x, 4) + 0.0 AS fft_coefficients FROM o""",
        "spkt_welch_density": _WELCH + " SELECT user_id, CAST(k AS INT) AS place, round(x, 4) + 0.0 AS spkt_welch_density FROM d WHERE k < 8",
        "fourier_entropy": _WELCH + """, y AS (SELECT d.user_id, w, x / max(x) OVER e AS p, min(x) OVER e / max(x) OVER e AS low, count(*) OVER e AS m FROM d JOIN u ON u.user_id = d.user_id WINDOW e AS (PARTITION BY d.user_id)),
bins AS (SELECT user_id, m, least(floor((p - low) / (1 - low) * 10), 9) AS bin, count(*) AS k FROM y GROUP BY 1, 2, 3) SELECT user_id, 0 AS place, round(-sum(k / m * ln(k / m)), 6) + 0.0 AS fourier_entropy FROM bins GROUP BY 1""",
        "lempel_ziv_complexity": """, r AS (WITH RECURSIVE c AS (SELECT user_id, CAST(-1 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS seen, '' AS cur FROM s WHERE i = 0
  UNION ALL SELECT user_id, i, CASE WHEN list_contains(seen, now) THEN seen ELSE list_append(seen, now) END, CASE WHEN list_contains(seen, now) THEN now ELSE '' END FROM (SELECT c.user_id, s.i, seen, cur || CASE WHEN s.v > 20 THEN '1' ELSE '0' END AS now FROM c JOIN s ON s.user_id = c.user_id AND s.i = c.i + 1)) SELECT * FROM c)
SELECT user_id, 0 AS place, round(len(seen) / (i + 1), 9) AS lempel_ziv_complexity FROM r WHERE i >= 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i DESC) = 1""",
    }
    # the change on the level before, two earlier changes and a constant; the level's part by what the others leave
    part = lambda a, b: f"({a}{b} - ({a}1 * (c22 * {b}1 - c12 * {b}2) + {a}2 * (c11 * {b}2 - c12 * {b}1)) / (c11 * c22 - c12 * c12))"
    out["augmented_dickey_fuller"] = f""", x AS (SELECT user_id, n, i, d AS y, l1 AS x, lag(d, 1) OVER o AS d1, lag(d, 2) OVER o AS d2 FROM s WINDOW o AS (PARTITION BY user_id ORDER BY i)),
c AS (SELECT user_id, count(*) AS k, var_pop(d1) AS c11, var_pop(d2) AS c22, covar_pop(d1, d2) AS c12, covar_pop(x, d1) AS x1, covar_pop(x, d2) AS x2, covar_pop(y, d1) AS y1, covar_pop(y, d2) AS y2, var_pop(x) AS xx, var_pop(y) AS yy, covar_pop(x, y) AS xy FROM x WHERE i >= 3 AND n >= 9 GROUP BY 1),
t AS (SELECT user_id, k, {part("x", "x")} AS sxx, {part("y", "y")} AS syy, {part("x", "y")} AS sxy FROM c)
SELECT user_id, 0 AS place, round(sxy / sxx / sqrt((syy - sxy * sxy / sxx) / (k - 4) / sxx), 4) AS augmented_dickey_fuller FROM t"""
    return {f"feat_{n}": one(n, x) for n, x in out.items()}


def _feature(spark: SparkSession, d: str, **some: f.Feature) -> DataFrame:
    return f.extract(table(spark, d, "events"), "user_id", "ts", "value", some)


def _plain(name: str) -> Q:
    feature, _, digits = PLAIN[name]

    def run(spark: SparkSession, d: str) -> DataFrame:
        out = _feature(spark, d, **{name: feature})
        return out if digits is None else out.withColumn(name, F.round(name, digits))

    return run


def _streak(name: str) -> Q:
    return lambda spark, d: _feature(spark, d, **{name: STREAK_FEATURES[name][0]})


def _kernel(name: str) -> Q:
    def run(spark: SparkSession, d: str) -> DataFrame:
        out = k.extract_arrays(table(spark, d, "events"), "user_id", "ts", "value", {name: KERNELS[name]})
        out = out.select("user_id", F.posexplode(name).alias("place", name))
        return out.withColumn(name, F.round(name, KERNEL_DIGITS[name]) + 0.0) if name in KERNEL_DIGITS else out

    return run


def feat_linear_trend(spark: SparkSession, d: str) -> DataFrame:
    out = _feature(spark, d, t=f.linear_trend())
    return out.select("user_id", *[F.round(f"t.{c}", n).alias(c) for c, n in (("slope", 5), ("intercept", 4), ("rss", 2))])


def feat_streak_length_stats(spark: SparkSession, d: str) -> DataFrame:
    out = _feature(spark, d, t=f.streak_length_stats(True, 0.0))
    return out.select("user_id", *[F.round(f"t.{c}", 5).alias(c) for c in ("min", "max", "mean", "std", "p10", "median", "p90", "mode")])


def feat_change_quantiles(spark: SparkSession, d: str) -> DataFrame:
    out = _feature(spark, d, t=f.change_quantiles(0.1, 0.9))
    return out.select("user_id", F.size("t").cast("bigint").alias("n_changes"), F.round(F.aggregate("t", F.lit(0.0), lambda a, x: a + x), 3).alias("sum_changes"))


def feat_energy_ratios(spark: SparkSession, d: str) -> DataFrame:
    out = _feature(spark, d, t=f.energy_ratios(10))
    return out.select("user_id", F.posexplode("t").alias("chunk", "ratio")).select("user_id", F.col("chunk").cast("bigint").alias("chunk"), F.round("ratio", 5).alias("ratio"))


def feat_binned_entropy(spark: SparkSession, d: str) -> DataFrame:
    return _feature(spark, d, binned_entropy=f.binned_entropy(10)).withColumn("binned_entropy", F.round("binned_entropy", 5))


def feat_permutation_entropy(spark: SparkSession, d: str) -> DataFrame:
    return _feature(spark, d, permutation_entropy=f.permutation_entropy(1, 3, 2.0)).withColumn("permutation_entropy", F.round("permutation_entropy", 5))


def feat_detrend(spark: SparkSession, d: str) -> DataFrame:
    out = f.detrended(table(spark, d, "events").select("user_id", "ts", "value"), "user_id", "ts", "value")
    return out.withColumn("value", F.round("value", 4))


def feat_frac_diff(spark: SparkSession, d: str) -> DataFrame:
    out = f.fractional_difference(table(spark, d, "events").select("user_id", "ts", "value"), "user_id", "ts", "value", 0.4, window_size=3)
    return out.withColumn("value", F.round("value", 4))


def feat_tumbling(spark: SparkSession, d: str) -> DataFrame:
    out = f.tumbling(table(spark, d, "events"), "user_id", "ts", "value", "7 days", {"energy": f.absolute_energy(), "changes": f.absolute_sum_of_changes()})
    return out.select("user_id", "window_start", F.round("energy", 4).alias("energy"), F.round("changes", 4).alias("changes"))


def feat_all_fused(spark: SparkSession, d: str) -> DataFrame:
    """All aggregate features in one plan with one exchange."""
    some = {name: x[0] for name, x in PLAIN.items()} | {name: x[0] for name, x in STREAK_FEATURES.items()}
    out = _feature(spark, d, **some)
    return out.select("user_id", *[F.round(n, PLAIN[n][2]).alias(n) if n in PLAIN and PLAIN[n][2] is not None else F.col(n) for n in some])


def queries() -> dict[str, Q]:
    own = (feat_linear_trend, feat_streak_length_stats, feat_change_quantiles, feat_energy_ratios, feat_binned_entropy, feat_permutation_entropy, feat_detrend, feat_frac_diff, feat_tumbling, feat_all_fused)
    return {f"feat_{n}": _plain(n) for n in PLAIN} | {f"feat_{n}": _streak(n) for n in STREAK_FEATURES} | {x.__name__: x for x in own} | {f"feat_{n}": _kernel(n) for n in KERNELS}


def oracle_sql() -> dict[str, str]:
    expr = lambda n: f"round({PLAIN[n][1]}, {PLAIN[n][2]})" if PLAIN[n][2] is not None else PLAIN[n][1]
    out = _kernel_sql()
    out |= {f"feat_{n}": f"{SERIES} SELECT user_id, {expr(n)} AS {n} FROM s GROUP BY user_id" for n in PLAIN}
    out |= {f"feat_{n}": SERIES + STREAKS.format(flag=x[1], name=n) for n, x in STREAK_FEATURES.items()}
    out["feat_linear_trend"] = f"{SERIES} SELECT user_id, round(regr_slope(v, i), 5) AS slope, round(regr_intercept(v, i), 4) AS intercept, round(regr_syy(v, i) - regr_slope(v, i) * regr_sxy(v, i), 2) AS rss FROM s GROUP BY 1"
    out["feat_streak_length_stats"] = (
        SERIES
        + """, g AS (SELECT user_id, i, coalesce(d >= 0, false) AS f FROM s), r AS (SELECT user_id, f, i - row_number() OVER (PARTITION BY user_id, f ORDER BY i) AS k FROM g),
x AS (SELECT user_id, CAST(count(*) AS DOUBLE) AS m FROM r WHERE f GROUP BY user_id, k), l AS (SELECT user_id, list(m ORDER BY m) AS o FROM x GROUP BY 1),
c AS (SELECT user_id, m, count(*) AS k FROM x GROUP BY 1, 2), md AS (SELECT user_id, first(m ORDER BY k DESC, m) AS mode FROM c GROUP BY 1),
a AS (SELECT user_id, min(m) AS mi, max(m) AS ma, avg(m) AS av, stddev_samp(m) AS sd, quantile_cont(m, 0.5) AS me FROM x GROUP BY 1)
SELECT u.user_id, coalesce(mi, 0) AS "min", ma AS "max", round(av, 5) AS mean, round(sd, 5) AS std, o[CAST(round((len(o) - 1) * 0.1) AS INT) + 1] AS p10, me AS median, o[CAST(round((len(o) - 1) * 0.9) AS INT) + 1] AS p90, mode
FROM (SELECT DISTINCT user_id FROM s) u LEFT JOIN a USING (user_id) LEFT JOIN l USING (user_id) LEFT JOIN md USING (user_id)"""
    )
    out["feat_change_quantiles"] = f"{SERIES} SELECT user_id, count(*) FILTER (WHERE v BETWEEN q10 AND q90 AND l1 BETWEEN q10 AND q90) AS n_changes, round(coalesce(sum(abs(d)) FILTER (WHERE v BETWEEN q10 AND q90 AND l1 BETWEEN q10 AND q90), 0), 3) AS sum_changes FROM s GROUP BY 1"
    out["feat_energy_ratios"] = f"{SERIES}, c AS (SELECT user_id, i // CAST(ceil(n / 10) AS BIGINT) AS chunk, sum(v*v) AS e FROM s GROUP BY 1, 2), a AS (SELECT user_id, sum(e) AS t FROM c GROUP BY 1), k AS (SELECT unnest(range(10)) AS chunk) SELECT a.user_id, CAST(k.chunk AS BIGINT) AS chunk, round(coalesce(e, 0) / t, 5) AS ratio FROM a CROSS JOIN k LEFT JOIN c ON c.user_id = a.user_id AND c.chunk = k.chunk"
    out["feat_binned_entropy"] = f"{SERIES}, c AS (SELECT user_id, n, CASE WHEN high > low THEN least(floor((v - low) * 10 / (high - low)), 9) ELSE 0 END AS b, count(*) AS k FROM s GROUP BY 1, 2, 3) SELECT user_id, round(sum(-k / n * ln(k / n)), 5) AS binned_entropy FROM c GROUP BY 1"
    out["feat_permutation_entropy"] = f"{SERIES}, p AS (SELECT user_id, list_transform(list_sort([{{'x': v, 'k': 0}}, {{'x': f1, 'k': 1}}, {{'x': f2, 'k': 2}}]), lambda z: z.k) AS o FROM s WHERE i <= n - 3), c AS (SELECT user_id, o, count(*) AS k FROM p GROUP BY 1, 2), t AS (SELECT user_id, sum(k) AS n FROM c GROUP BY 1) SELECT user_id, round(sum(-k / n * log2(k / n)), 5) AS permutation_entropy FROM c JOIN t USING (user_id) GROUP BY 1"
    out["feat_detrend"] = f"{SERIES} SELECT user_id, ts, round(v - (regr_intercept(v, i) OVER (PARTITION BY user_id) + regr_slope(v, i) OVER (PARTITION BY user_id) * i), 4) AS value FROM s"
    w = f.fractional_weights(0.4, window_size=3)
    out["feat_frac_diff"] = f"{SERIES} SELECT user_id, ts, round(v * {w[0]} + l1 * ({w[1]!r}) + l2 * ({w[2]!r}), 4) AS value FROM s"
    out["feat_tumbling"] = """WITH s AS (SELECT user_id, time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS window_start, ts, value AS v FROM events), d AS (SELECT *, v - lag(v) OVER (PARTITION BY user_id, window_start ORDER BY ts, v) AS d FROM s)
SELECT user_id, window_start, round(sum(v*v), 4) AS energy, round(coalesce(sum(abs(d)), 0), 4) AS changes FROM d GROUP BY 1, 2"""
    joined = f"(SELECT user_id, {', '.join(f'{expr(n)} AS {n}' for n in PLAIN)} FROM s GROUP BY user_id) p"
    runs = "".join(
        f", g{j} AS (SELECT user_id, i, coalesce({x[1]}, false) AS f FROM s), r{j} AS (SELECT user_id, f, i - row_number() OVER (PARTITION BY user_id, f ORDER BY i) AS k FROM g{j}), y{j} AS (SELECT user_id, f, k, count(*) AS m FROM r{j} GROUP BY 1, 2, 3), x{j} AS (SELECT user_id, CAST(coalesce(max(m) FILTER (WHERE f), 0) AS BIGINT) AS {n} FROM y{j} GROUP BY 1)"
        for j, (n, x) in enumerate(STREAK_FEATURES.items())
    )
    out["feat_all_fused"] = f"{SERIES}{runs} SELECT * FROM {joined} " + " ".join(f"JOIN x{j} USING (user_id)" for j in range(len(STREAK_FEATURES)))
    return out

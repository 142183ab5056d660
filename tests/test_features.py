import datetime as dt
import math

import numpy as np
import pytest

from tidegrid.functions import features as f
from tidegrid.functions import kernels as k

T0 = dt.datetime(2024, 1, 1)


def frame(spark, series):
    """Rows arrive unsorted."""
    rows = [(name, T0 + dt.timedelta(hours=i), None if v is None else float(v)) for name, vs in series.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows[::-1], "id string, t timestamp_ntz, x double")


# Given series and the results they must have.
CASES = [
    ("absolute_energy", f.absolute_energy(), [-5, 0, 1], 26),
    ("absolute_maximum", f.absolute_maximum(), [-5, 0, 1], 5),
    ("absolute_sum_of_changes", f.absolute_sum_of_changes(), [1.4, -1.3, 1.7, -1.2], 8.6),
    ("absolute_sum_single", f.absolute_sum_of_changes(), [1], 0),
    ("autocorrelation1", f.autocorrelation(1), [1, 2, 1, 2, 1, 2], -1),
    ("autocorrelation2", f.autocorrelation(2), [0, 1, 2, 0, 1, 2], -0.75),
    ("benford", f.benford_correlation(), [26.24, 3.03, -2.92, 3.5, -0.07, 0.35, 0.10, 0.51, -0.43], 0.39753280229716703),
    ("benford_even", f.benford_correlation(), list(range(1, 10)), math.nan),
    ("binned_entropy", f.binned_entropy(10), [10] * 10 + [1], 0.30463609734923813),
    ("binned_entropy100", f.binned_entropy(100), list(range(10)), 2.302585092994046),
    ("c3", f.c3(1), [1, 2, -3, 4], -15),
    ("c3_short", f.c3(2), [1, 2, 3], math.nan),
    ("cid_ce", f.cid_ce(), [-4.33, -1.33, 2.67], 5),
    ("cid_ce_normal", f.cid_ce(True), [0, 4], 2),
    ("count_above", f.count_above(0.2), [0.1, 0.2, 0.3] * 3, 200 / 3),
    ("count_below", f.count_below(0.2), [0.1, 0.2, 0.3] * 3, 200 / 3),
    ("first_max", f.first_location_of_maximum(), [1, 2, 1, 2, 1], 0.2),
    ("last_max", f.last_location_of_maximum(), [1, 2, 1, 2, 1], 0.8),
    ("index_mass", f.index_mass_quantile(0.6), [0, 1, 1, 0, 0, 1, 0, 0], 0.375),
    ("streak_above_mean", f.longest_streak_above_mean(), [1, 2, 1, 2, 1, 2, 2, 1], 2),
    ("mean_n_absolute_max", f.mean_n_absolute_max(3), [-1, -5, 4, 10], 19 / 3),
    ("second_derivative", f.mean_second_derivative_central(), [1, 3, 7, -3], -3),
    ("second_derivative_short", f.mean_second_derivative_central(), [1, 3], math.nan),
    ("crossings", f.number_crossings(10.5), [10, 11, 12, 10, 11], 3),
    ("peaks2", f.number_peaks(2), [0, 1, 2, 3, 0, 1, 2, 3, 4, 5, 4, 3, 2, 1], 2),
    ("peaks4", f.number_peaks(4), [0, 1, 2, 3, 0, 1, 2, 3, 4, 5, 4, 3, 2, 1], 1),
    ("recurring_values", f.percent_reoccurring_values(), [1, 1, 2, 3, 4], 0.25),
    ("recurring_points", f.percent_reoccurring_points(), [1, 1, 2, 3, 4], 0.4),
    ("permutation_entropy", f.permutation_entropy(1, 3, 2), [4, 7, 9, 10, 6, 11, 3], 1.5219281),
    ("range_count", f.range_count(1, 10), [-1, 2, 3, 4], 3),
    ("beyond_sigma", f.ratio_beyond_r_sigma(2), [0, 1] * 10 + [10, 20, -30], 2 / 23),
    ("rms", f.root_mean_square(), [1, 1, 1, 2, 2], 1.4832396974191326),
    ("sum_points", f.sum_reoccurring_points(), [1, 1, 2, 3, 4, 4], 10),
    ("sum_values", f.sum_reoccurring_values(), [1, 1, 2, 3, 4, 4], 5),
    ("symmetry", f.symmetry_looking(0.05), [-2, -1, 0, 1, 1], False),
    ("asymmetry", f.time_reversal_asymmetry_statistic(1), [1, 2, -3, 4], -10),
    ("variation", f.variation_coefficient(), [0, 1, 2], 0.816497),
    ("variation_infinite", f.variation_coefficient(), [-1, 1], math.inf),
    ("harmonic", f.harmonic_mean(), [1, 2, 4], 3 / 1.75),
    ("null", f.count_above(0.0), [1, None, 3], 100),
]


def test_goldens(spark):
    df = frame(spark, {name: xs for name, _, xs, _ in CASES})
    got = {r["id"]: r for r in f.extract(df, "id", "t", "x", {name: x for name, x, _, _ in CASES}).collect()}
    for name, _, _, want in CASES:
        have = got[name][name]
        assert (math.isnan(have) if isinstance(want, float) and math.isnan(want) else have == pytest.approx(want, rel=1e-6)), name


def test_structs_and_lists(spark):
    some = {"trend": f.linear_trend(), "streaks": f.streak_length_stats(True, 0.0), "changes": f.change_quantiles(0.1, 0.9), "signed": f.change_quantiles(0.1, 0.9, False), "energy": f.energy_ratios(4)}
    df = frame(spark, {"a": [1, 2, 3, 4, 5], "b": [0, 1, 1, 0, 2, 2, 2], "c": [0, 1, -9, 0, 0, 1, 0], "d": [3]})
    got = {r["id"]: r for r in f.extract(df, "id", "t", "x", some).collect()}
    assert tuple(got["a"]["trend"]) == pytest.approx((1, 1, 0)) and math.isnan(got["d"]["trend"]["slope"])
    assert tuple(got["b"]["streaks"]) == pytest.approx((2, 3, 2.5, 0.707107, 2, 2.5, 3, 2), rel=1e-5)
    assert got["c"]["changes"] == [1, 0, 1, 1] and got["c"]["signed"] == [1, 0, 1, -1]
    assert got["d"]["streaks"]["min"] == 0 and got["d"]["streaks"]["max"] is None
    assert got["a"]["energy"] == pytest.approx([5 / 55, 25 / 55, 25 / 55, 0])


def test_one_exchange_for_all(spark):
    some = {"a": f.mean_abs_change(), "b": f.cid_ce(), "c": f.longest_streak_above_mean(), "d": f.percent_reoccurring_values(), "e": f.binned_entropy(), "g": f.permutation_entropy(), "h": f.number_peaks(2)}
    plan = f.extract(frame(spark, {"a": [1, 2, 3]}), "id", "t", "x", some)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "BatchEvalPython" not in plan
    only_sums = f.extract(frame(spark, {"a": [1, 2, 3]}), "id", "t", "x", {"a": f.absolute_energy()})._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in only_sums and "partial_sum" in only_sums


def test_kernels():
    x = np.array([12, 13, 15, 16, 17] * 10, float)
    assert k.approximate_entropy(2, 0.9)(x) == pytest.approx(0.282456191276673)
    assert k.approximate_entropy(2, 0.5, False)(np.array([1.4, -1.3, 1.7, -1.2])) == pytest.approx(0.0566330122651324)
    assert k.sample_entropy()(np.arange(100.0)) == pytest.approx(0.010471299867295437)
    assert k.fourier_entropy()(np.arange(300.0)) == pytest.approx(0.04539477814685819, rel=1e-6)
    bits = np.array([1, 0, 0, 1, 1, 1, 1, 0, 1, 1, 0, 0, 0, 0, 1, 0], float)
    assert k.lempel_ziv_complexity(0, False)(bits) == 8
    assert len(k.cwt_coefficients((2, 5), 3)(np.arange(10.0))) == 6
    y = np.zeros(200)
    for i in range(2, 200):
        y[i] = 0.5 * y[i - 1] - 0.3 * y[i - 2] + 1 + math.sin(i * 7.7)
    beta = k.autoregressive_coefficients(2)(y)
    z = np.c_[y[1:-1], y[:-2], np.ones(198)]
    assert np.allclose(beta, np.linalg.lstsq(z, y[2:], rcond=None)[0])
    rng = np.random.default_rng(0)
    jump = np.r_[rng.normal(0, 0.1, 150), rng.normal(0.2, 0.2, 50)]
    events = np.flatnonzero(k.cusum(5.0, 50, 1.0)(jump))
    assert len(events) and 150 < events[events >= 150][0] < 170
    assert k.augmented_dickey_fuller(1)(rng.normal(0, 1, 300)) < -5 < k.augmented_dickey_fuller(1)(np.cumsum(rng.normal(0, 1, 300)))
    for kernel in (k.approximate_entropy(), k.sample_entropy(), k.fourier_entropy(), k.spkt_welch_density(), k.friedrich_coefficients(), k.number_cwt_peaks(), k.fft_coefficients(), k.lempel_ziv_complexity(0.0), k.cusum(1.0, 2), k.cwt_coefficients(), k.autoregressive_coefficients(1), k.augmented_dickey_fuller(1)):
        for short in ([], [1.0], [1.0, 1.0], [2.0] * 30):
            kernel(np.array(short))


def test_shards_give_what_whole_series_give(spark):
    """Ordered features, with ties, a null entity, short series, and shards smaller than their reach."""
    from tidegrid.plans.feature_queries import PLAIN

    rng = np.random.default_rng(6)
    rows = [(e, int(t), float(np.round(v, 1))) for e, n in (("a", 200), ("b", 31), ("c", 2), (None, 17)) for t, v in zip(rng.integers(0, n // 2 + 1, n), rng.normal(1, 2, n), strict=True)]
    df = spark.createDataFrame(rows, "e string, t int, v double")
    some = {n: x[0] for n, x in PLAIN.items() if n != "mean_n_absolute_max"}
    whole = {r["e"]: r.asDict() for r in f.extract(df, "e", "t", "v", some).collect()}
    for size in (3, 50):
        got = {r["e"]: r.asDict() for r in f.extract(df, "e", "t", "v", some, size).collect()}
        assert set(got) == set(whole)
        for e, row in whole.items():
            for n, x in row.items():
                y = got[e][n]
                assert x == y or isinstance(x, float) and (math.isnan(x) and math.isnan(y) or x == pytest.approx(y, rel=1e-9)), (e, n, x, y)
    with pytest.raises(ValueError):
        f.extract(df, "e", "t", "v", {"x": f.longest_streak_above_mean()}, 10)

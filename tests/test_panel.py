import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegrid.operators import forecasting as fc
from tidegrid.operators import metrics, seasonality, splits, transforms
from tidegrid.spec import Freq, freq_to_sp


@pytest.fixture(scope="module")
def pdf():
    rng = np.random.default_rng(7)
    rows = [(e, dt.date(2020, 1, 1) + dt.timedelta(i), float(50 + 10 * k + 0.3 * i + 5 * np.sin(i / 2) + rng.normal())) for k, e in enumerate("abc") for i in range(60)]
    return pd.DataFrame(rows, columns=["id", "day", "x"])


@pytest.fixture(scope="module")
def panel(spark, pdf):
    return spark.createDataFrame(pdf.sample(frac=1, random_state=1)).cache()


def values(df):
    return df.toPandas().sort_values(["id", "day"]).reset_index(drop=True)


@pytest.mark.parametrize("make", [transforms.scale, lambda: transforms.detrend("1d"), lambda: transforms.detrend("1d", "mean"), lambda: transforms.diff(1), lambda: transforms.diff(2, 7), transforms.boxcox, transforms.yeojohnson, transforms.log1p, lambda: transforms.deseasonalize_fourier(12, 2), lambda: transforms.deseasonalize_fourier(12, 2, True)])
def test_round_trip(panel, pdf, make):
    fitted = make().fit(panel)
    back = values(fitted.invert(fitted.transformed))
    want = pdf.sort_values(["id", "day"]).merge(back[["id", "day"]], on=["id", "day"])
    assert len(back) in (180, 177, 138) and np.allclose(back["x"], want["x"])


def test_lag_and_roll_equal_pandas(panel, pdf):
    g = pdf.sort_values(["id", "day"]).groupby("id")["x"]
    got = values(transforms.lag([1, 4])(panel))
    want = pdf.sort_values(["id", "day"]).assign(a=g.shift(1), b=g.shift(4)).dropna()
    assert np.allclose(got["x__lag_1"], want["a"]) and np.allclose(got["x__lag_4"], want["b"])
    got = values(transforms.roll([5], ["mean", "std", "sum"])(panel))
    for stat in ("mean", "std", "sum"):
        want = g.transform(lambda s, stat=stat: getattr(s.rolling(5), stat)().shift(1))
        assert np.allclose(got[f"x__rolling_{stat}_5"].to_numpy(float), want.to_numpy(), equal_nan=True)


def test_time_axis(spark):
    assert Freq.parse("3mo").months == 3 and Freq.parse("10m").micros == 600_000_000 and freq_to_sp("1d") == [7, 365]
    with pytest.raises(ValueError):
        Freq.parse("soon")
    cut = spark.createDataFrame([("a", dt.date(2024, 1, 31))], "id string, day date")
    assert [r["day"] for r in seasonality.make_future_ranges(cut, 3, "1mo").orderBy("step").collect()] == [dt.date(2024, 2, 29), dt.date(2024, 3, 31), dt.date(2024, 4, 30)]
    days = [dt.date(2020, 1, 1), dt.date(2020, 11, 26), dt.date(2021, 12, 25), dt.date(2021, 4, 4)]
    df = spark.createDataFrame([("a", d) for d in days], "id string, day date")
    assert [r["holiday__US"] for r in seasonality.add_holiday_effects(df, ["US"]).orderBy("day").collect()] == ["new_years_day", "thanksgiving_day", None, "christmas_day"]
    assert seasonality.easter(2024) == dt.date(2024, 3, 31) and seasonality.easter(2019) == dt.date(2019, 4, 21)
    weeks = spark.createDataFrame([("a", dt.date(2023, m, 1)) for m in (1, 2, 3)], "id string, day date")
    assert [r["week"] for r in seasonality.add_calendar_effects(weeks, ["week"]).orderBy("day").collect()] == ["52", "5", "9"]


def test_splits(panel):
    train, test = splits.train_test_split(panel, 10)
    assert (train.count(), test.count()) == (150, 30)
    with pytest.raises(ValueError):
        splits.train_test_split(panel, 60)
    flat = splits.expanding_window_split(panel, 5, 3, 2)
    sizes = {(r["split"], r["is_test"]): r["count"] // 3 for r in flat.groupBy("split", "is_test").count().collect()}
    assert sizes == {(0, False): 51, (1, False): 53, (2, False): 55, (0, True): 5, (1, True): 5, (2, True): 5}


def test_linear_forecasts_equal_numpy(panel, pdf):
    lags, fh = 4, 6
    x, y, ends = [], [], {}
    for e, s in pdf.sort_values("day").groupby("id")["x"]:
        s = s.to_numpy()
        ends[e] = s
        for t in range(lags, len(s)):
            x.append(s[t - lags : t][::-1])
            y.append(s[t])
    w = np.linalg.lstsq(np.c_[np.ones(len(y)), x], y, rcond=None)[0]
    got = values(fc.linear_model("1d", lags)(panel, None).forecast(fh, None))
    for e, s in ends.items():
        path = list(s)
        for _ in range(fh):
            path.append(w[0] + np.dot(w[1:], path[-lags:][::-1]))
        assert np.allclose(got.loc[got["id"] == e, "x"], path[-fh:])
    assert got["day"].min() == dt.date(2020, 3, 1)
    direct = fc.linear_model("1d", lags, strategy="direct", max_horizons=3)(panel, None)
    with pytest.raises(ValueError):
        direct.forecast(4, None)
    assert direct.forecast(3, None).count() == 9


def test_penalised_solutions():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 5))
    y = x @ [1.0, -2, 0, 0, 0.5] + rng.normal(size=200)
    z = np.c_[np.ones(200), y, x]
    g = z.T @ z
    xc, yc = x - x.mean(0), y - y.mean()
    assert np.allclose(fc.solve(g, "ridge", 3.0)[1:], np.linalg.solve(xc.T @ xc + 3 * np.eye(5), xc.T @ yc))
    w = fc.solve(g, "lasso", 0.2)
    grad = xc.T @ (yc - xc @ w[1:]) / 200
    assert np.all(np.abs(grad) <= 0.2 + 1e-8) and np.allclose(grad[w[1:] != 0], 0.2 * np.sign(w[1:][w[1:] != 0]))
    assert fc.squared_error(g, w) == pytest.approx(float(((y - w[0] - x @ w[1:]) ** 2).sum()))


def test_neighbours_equal_brute_force(panel, pdf):
    k, lags = 3, 4
    rows, nows = [], {}
    for e, s in pdf.sort_values("day").groupby("id")["x"]:
        s = s.to_numpy()
        rows += [(s[t - lags : t], s[t]) for t in range(lags, len(s))]
        nows[e] = s[-lags:]
    got = {r["id"]: r["x"] for r in fc.knn("1d", lags, k)(panel, None).forecast(1, None).collect()}
    for e, q in nows.items():
        near = sorted(((x - q) @ (x - q), y) for x, y in rows)[:k]
        assert got[e] == pytest.approx(np.mean([y for _, y in near]))


def test_metrics_handle_zero_and_missing(spark):
    t = [("a", 1, 0.0), ("a", 2, 2.0), ("b", 1, 1.0)]
    y = spark.createDataFrame(t, "id string, t int, x double")
    p = spark.createDataFrame([("a", 1, 0.0), ("a", 2, 3.0)], "id string, t int, x double")
    got = {r["id"]: r for r in metrics.point_metrics(y, p, ["mae", "mape", "smape"]).collect()}
    assert got["a"]["mae"] == 0.5 and np.isnan(got["a"]["mape"]) and got["b"]["mae"] is None


def test_impute_and_reindex(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, None), ("a", 3, float("nan")), ("a", 4, 4.0), ("b", 2, None)], "id string, t int, x double")
    got = {(r["id"], r["t"]): r["x"] for r in transforms.impute("linear")(df).collect()}
    assert got == {("a", 1): 1.0, ("a", 2): 2.0, ("a", 3): 3.0, ("a", 4): 4.0, ("b", 2): None}
    assert transforms.reindex()(df).count() == 8 and transforms.trim("both")(df.where(F.col("x").isNotNull() | (F.col("id") == "b"))).count() == 1


def test_ann_forecasts_every_entity(spark):
    rng = np.random.default_rng(5)
    rows = [(f"e{k:02d}", i, float(20 * (k % 6) + 8 * np.sin(i / 3 + k) + rng.normal())) for k in range(40) for i in range(40)]
    rows += [("jump", i, float(i % 5 + (1e4 if i >= 36 else 0))) for i in range(40)] + [("short", i, 1.0) for i in range(3)]
    lags, y = 4, spark.createDataFrame(rows, "id string, t int, x double").cache()
    read = lambda f, fh: {(r["id"], r["t"]): r["x"] for r in f(y, None).forecast(fh, None).collect()}
    got, exact = read(fc.ann("1i", lags, width=5.0), 1), read(fc.knn("1i", lags, 1), 1)
    assert set(got) == set(exact) and ("jump", 40) in got and len(got) == 41
    assert np.mean([got[k] == exact[k] for k in exact]) >= 0.9
    got, exact = read(fc.ann("1i", lags, max_horizons=3), 3), read(fc.knn("1i", lags, 1, 3), 3)
    assert set(got) == set(exact) and len(got) == 123 and np.mean([got[k] == exact[k] for k in exact]) >= 0.9
    with pytest.raises(ValueError):
        fc.ann("1i", lags)(y, None).forecast(2, None)


@pytest.fixture(scope="module")
def driven(spark):
    """A target that follows a feature known ahead and nothing else, so that lags tell nothing of it."""
    rng = np.random.default_rng(9)
    z = {(e, i): float(rng.integers(0, 2)) for e in "ab" for i in range(122)}
    y = spark.createDataFrame([(e, i, 10 + 40 * v + float(rng.normal())) for (e, i), v in z.items() if i < 120], "id string, t int, x double").cache()
    X = spark.createDataFrame([(e, i, 100 * v) for (e, i), v in z.items()], "id string, t int, z double").cache()
    return y, X, {k: 10 + 40 * v for k, v in z.items()}


@pytest.mark.parametrize("make", [lambda: fc.boosted_trees("1i", 2, 2, maxIter=5), lambda: fc.glm("1i", 2, "gaussian", 2), lambda: fc.glm("1i", 2, "gamma", 2), lambda: fc.censored_model("1i", 2, 30.0, 2), lambda: fc.knn("1i", 2, 3, 2), lambda: fc.ann("1i", 2, max_horizons=2)])
def test_features_known_ahead_are_used(driven, make):
    y, X, want = driven
    model = make()(y, X)
    for fh in (1, 2):
        got = {(r["id"], r["t"]): r["x"] for r in model.forecast(fh, X).collect()}
        assert len(got) == 2 * fh and all(abs(v - want[k]) < 8 for k, v in got.items())
    with pytest.raises(ValueError):
        model.forecast(1, None)


def test_settings_are_scored_with_features(driven):
    y, X, _ = driven
    make = fc.glm("1i", 2, "gaussian")
    assert fc.cv_error(make, y, 1, 2, X) < 5
    seen = []

    def spy(freq, lags):
        return lambda y, X: (seen.append(X), fc.linear_model(freq, lags)(y, X))[1]

    fc.auto(spy, "1i", [1], 1, 1)(y, X)
    assert len(seen) == 2 and all(x is X for x in seen)


def test_backtests_of_local_forecasters_take_one_pass(panel):
    """Forecast all at once they equal those forecast split by split, over expanding and sliding windows."""
    for make in (lambda: fc.naive("1d"), lambda: fc.snaive("1d", 4)):
        for strategy in ("expanding", "sliding"):
            cv = fc.windows(strategy, 5, 3, 2, 20)
            once = values(fc.backtest(make(), panel, 5, 3, cv=cv)[0].orderBy("id", "split", "day"))
            each = values(fc.backtest(fc.Forecaster(make().fit), panel, 5, 3, cv=cv)[0].orderBy("id", "split", "day"))
            columns = ["id", "split", "day"]
            pd.testing.assert_frame_equal(once.sort_values(columns, ignore_index=True)[[*columns, "x"]], each.sort_values(columns, ignore_index=True)[[*columns, "x"]])
    with pytest.raises(ValueError):
        fc.windows("other", 5, 3, 2)


def test_residuals_of_fitted_values(panel, pdf):
    lags = 3
    told, resid = fc.linear_model("1d", lags).backtest(panel, test_size=4, n_splits=2, step_size=3)
    got = values(resid)
    assert set(got["split"]) == {0, 1, 2} and told.count() == 3 * 2 * 4
    # least squares with a constant leaves residuals without mean, over all rows with all lags
    assert (got.groupby("split")["y_resid"].mean().abs() < 1e-8).all()
    assert (got.groupby("split").size() == pd.Series({0: 3 * (60 - 7 - lags), 1: 3 * (60 - 4 - lags), 2: 3 * (60 - lags)})).all()
    for strategy in ("direct", "ensemble"):
        model = fc.linear_model("1d", lags, strategy=strategy, max_horizons=2)(panel, None)
        assert model.residuals().count() == 3 * (60 - lags - 1)
    trees = fc.boosted_trees("1d", lags, 2, maxIter=2)(panel, None)
    assert trees.residuals().count() == 3 * (60 - lags - 1)
    # naive models miss the change since the row before
    naive = values(fc.naive("1d").backtest(panel, test_size=2, n_splits=2)[1]).query("split == 2")
    x = pdf.sort_values("day").groupby("id")["x"]
    assert np.allclose(np.sort(naive["y_resid"]), np.sort(x.diff().dropna()))


def test_conformalize_and_lengths(panel):
    out = values(fc.naive("1d").conformalize(3, panel, test_size=3, n_splits=2, alphas=(0.1, 0.5, 0.9)))
    wide = out.pivot_table(index=["id", "day"], columns="quantile", values="x")
    assert set(wide.columns) == {10, 50, 90} and (wide[10] <= wide[50]).all() and (wide[50] <= wide[90]).all()
    with pytest.raises(ValueError):
        fc.naive("1d").backtest(panel, test_size=40)
    assert fc.check_backtest_lengths(panel, 10, 40, drop_short=True).count() == 0


def test_features_are_transformed_too(driven):
    y, X, want = driven
    shifted = fc.transformed(fc.ridge("1i", 2, 0.1), feature_transform=lambda f: f.withColumn("z", F.col("z") * 2))
    got = {(r["id"], r["t"]): r["x"] for r in shifted(y, X).forecast(2, X).collect()}
    assert len(got) == 4 and all(abs(v - want[k]) < 8 for k, v in got.items())


def test_stacked_ensemble(spark):
    """Where one base model is far better than the others, the regression leans on it."""
    rows = [(e, i, 100.0 * k + 10 * (i % 4)) for k, e in enumerate("abcdef") for i in range(60)]
    y = spark.createDataFrame(rows, "id string, t int, x double")
    base = {"seasonal": fc.snaive("1i", 4), "last": fc.naive("1i"), "other": fc.snaive("1i", 3)}
    for strategy in ("mean", "lasso"):
        model = fc.elite(base, 4, 2, 3, strategy)(y, None)
        got = {(r["id"], r["t"]): r["x"] for r in model.forecast(4, None).collect()}
        assert len(got) == 24
        if strategy == "lasso":
            assert all(abs(got[e, 60 + i] - (100.0 * k + 10 * (i % 4))) < 1 for k, e in enumerate("abcdef") for i in range(4))
    with pytest.raises(ValueError):
        fc.elite(base, 4, strategy="other")


def test_high_levels_lose_no_digits(spark):
    rng = np.random.default_rng(4)
    x = np.cumsum(rng.normal(size=200))
    fits = []
    for level in (0.0, 1e9):
        y = spark.createDataFrame([("a", i, float(level + v)) for i, v in enumerate(x)], "id string, t int, x double")
        fits.append(fc.linear_model("1i", 2)(y, None).weights[1][1:])
    assert np.allclose(fits[0], fits[1], atol=1e-5)


def test_missing_features_are_an_error(driven):
    y, X, _ = driven
    with pytest.raises(ValueError):
        fc.ridge("1i", 2)(y, X).forecast(5, X)


def test_censored_with_own_models(driven):
    y, X, want = driven
    mean = lambda rows, inputs: (lambda m: lambda new: new.withColumn("prediction", F.lit(m)))(rows.agg(F.avg("y")).first()[0])
    sure = lambda rows, inputs: lambda new: new.withColumn("prediction", (F.col("z") > 50).cast("double"))
    got = {(r["id"], r["t"]): r["x"] for r in fc.censored_model("1i", 2, 30.0, 1, mean, sure)(y, X).forecast(1, X).collect()}
    assert len(got) == 2 and all(abs(v - want[k]) < 4 for k, v in got.items())

import datetime as dt

import numpy as np
import pandas as pd

from tidegrid.operators.quotes import quotes
from tidegrid.operators.trailing_totals import trailing_totals

D = dt.date(2024, 7, 3)


def test_against_pandas(spark):
    rng = np.random.default_rng(0)
    days = [D + dt.timedelta(int(k)) for k in rng.integers(-5, 50, 300)]
    pdf = pd.DataFrame({"e": rng.choice(list("aab"), 300), "t": [dt.datetime.combine(x, dt.time(5)) for x in days], "x": np.round(rng.normal(10, 5, 300), 3), "s": "clash"})
    got = trailing_totals(spark.createDataFrame(pdf), "e", "t", "x", D, D + dt.timedelta(40), (7, 30)).toPandas()
    assert len(got) == 2 * 41
    for e, part in got.groupby("e"):
        mine = pdf[pdf["e"] == e]
        for r in part.to_dict("records"):
            for w in (7, 30):
                sel = mine[(mine["t"].dt.date <= r["day"]) & (mine["t"].dt.date > r["day"] - dt.timedelta(w)) & (mine["t"].dt.date >= D)]
                assert r[f"n_{w}d"] == len(sel) and abs(r[f"total_{w}d"] - sel["x"].sum()) < 1e-9
                assert (len(sel) == 0 and pd.isna(r[f"avg_{w}d"])) or abs(r[f"avg_{w}d"] - sel["x"].mean()) < 1e-9


def test_odd_values(spark):
    t = dt.datetime(2024, 7, 3, 1)
    df = spark.createDataFrame([("a", t, None), ("a", t, float("nan")), ("a", t, float("inf")), (None, t, 1.0), ("a", None, 1.0), ("b", t, 2.0), ("b", dt.datetime(1970, 1, 1), 5.0), ("b", dt.datetime(2099, 1, 1), 5.0)], "e string, t timestamp_ntz, x double")
    got = trailing_totals(df, "e", "t", "x", D, D, (7,)).collect()
    assert [(r["e"], r["total_7d"], r["n_7d"]) for r in got] == [("b", 2.0, 1)]
    assert trailing_totals(df.limit(0), "e", "t", "x", D, D).count() == 0


def test_large_and_small_values(spark):
    day = lambda k: dt.datetime.combine(D + dt.timedelta(k), dt.time(1))
    df = spark.createDataFrame([("a", day(0), 1e-9), ("a", day(1), 3e25), ("a", day(2), 2.5), ("a", day(9), 2e-9)], "e string, t timestamp_ntz, x double")
    got = {r["day"]: (r["total"], r["total_7d"], r["n_7d"]) for r in trailing_totals(df, "e", "t", "x", D, D + dt.timedelta(10), (7,)).collect()}
    assert got[D] == (1e-9, 1e-9, 1) and got[D + dt.timedelta(1)][:2] == (3e25, 3e25)
    assert got[D + dt.timedelta(8)] == (0.0, 2.5, 1) and got[D + dt.timedelta(10)] == (0.0, 2e-9, 1)  # the large value has left without a trace


def test_calendar_ends_with_the_last_listed_day(spark, data):
    from tidegrid.plans import data_queries
    from tidegrid.sources.panels import table

    last = table(spark, data, "listings").selectExpr("max(active_to) as t").first()["t"]
    got = data_queries.p5_trailing(spark, data).selectExpr("max(day) as d").first()["d"]
    assert got == (last - dt.timedelta(microseconds=1)).date()


def test_quotes_drop_copies(spark):
    t = dt.datetime(2024, 7, 3, 1)
    rows = [("A b", t, 1.0, 1, "x"), (" a  B ", t, 1.0, 1, "x"), ("a b", t, 1.0, 2, "y"), ("a b", t, 2.0, 3, "y"), (None, t, 2.0, 3, "y"), ("a b", t, None, 4, "y")]
    got = quotes(spark.createDataFrame(rows, "commodity_type string, time timestamp_ntz, price double, reading_id bigint, key string"))
    assert sorted((r["key"], r["price"]) for r in got.collect()) == [("a b", 1.0), ("a b", 2.0)]

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidegrid.operators import matched_fill as mf

SCHEMA = "commodity_type string, time timestamp_ntz, price double, report_id bigint, sheet_id bigint, lot_code string, name string, lx string"
T = dt.datetime(2024, 7, 3, 10)


def reports(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)


def registry(spark):
    return spark.createDataFrame([("Tin, FOB", "m"), ("Rye, Spot", "g")], "commodity_type string, sector string")


def test_names_and_marks(spark):
    rows = [
        ("Tin, FOB", T, 10.0, 1, 1, "L1"), (" tin, fob ", T, 11.0, 2, 1, "L1"), ("n/a", T, -1.0, 3, 1, None), (None, T, 10.5, 4, 9, "L1"), ("", T, None, 5, 8, None),
        ("Rye, Spot", T, 3.0, 6, 2, "L2"), ("Rye, Spot", T, float("nan"), 7, 2, "L2"), ("Rye, Spot", T, 9_999_999.0, 8, 2, None), ("Rye, Spot", T, 3.0, 9, 2, "L2"), ("unknown", None, 3.1, 10, None, "L2"), ("Tin, FOB", T, 0.0, 11, None, None),
    ]
    rows += [("Tin, FOB", T, 10.0 + k / 100, 100 + k, 50, "L9") for k in range(20)]
    found = {(r["report_id"], r["field"]): r["commodity_type"] for r in mf.missing_fields(reports(spark, rows), registry(spark)).collect()}
    assert found == {(3, "price"): "Tin, FOB", (3, "commodity_type"): "Tin, FOB", (4, "commodity_type"): "Tin, FOB", (5, "price"): None, (5, "commodity_type"): None, (7, "price"): "Rye, Spot", (8, "price"): "Rye, Spot", (10, "commodity_type"): "Rye, Spot", (11, "price"): "Tin, FOB"}
    full = {r["report_id"]: r for r in mf.filled_reports(reports(spark, rows), registry(spark)).collect()}
    assert len(full) == len(rows)
    price = {100 + k: 10.0 + k / 100 for k in range(20)} | {1: 10.0, 2: 11.0, 4: 10.5, 6: 3.0, 9: 3.0, 10: 3.1}
    for i, r in full.items():
        assert r["price_filled"] == (r["price_donor"] is not None)
        if r["price_filled"]:
            assert abs(r["price"] - price[r["price_donor"]]) < 1e-9 and full[r["price_donor"]]["commodity_type"] == r["commodity_type"]
    assert full[3]["name_donor"] == 1 and full[4]["name_donor"] == 1 and full[10]["name_donor"] == 6 and full[5]["price"] is None and not full[5]["price_filled"]


def brute_pool(rows, name, pred, report_id, pool):
    """The nearest donors by looking at all of them."""
    donors = sorted((p, j) for j, n, x, p in rows if n == name and x is not None)
    place = sum((p, j) <= (pred, report_id) for p, j in donors)
    return [j for *_, j in sorted((abs(pred - p), place - 1 - k if k < place else k - place, j) for k, (p, j) in enumerate(donors))[:pool]]


def test_donors_are_the_nearest_in_any_shards(spark):
    """With ties, a far-out prediction, a hot name, and shards smaller than the pool."""
    rng = np.random.default_rng(3)
    rows = [(i, "hot" if i % 3 else f"c{i % 2}", float(rng.normal()) if i % 7 else None, float(np.round(rng.normal(), 2))) for i in range(400)]
    rows += [(1000 + i, "hot", None if i % 4 == 0 else 1.0, 0.5) for i in range(60)] + [(2000, "hot", 1.0, 1e6), (2001, "hot", None, -1e6), (2002, "none", None, 0.0)]
    df = spark.createDataFrame(rows, "report_id bigint, name string, lx double, pred double")
    values, seen = {j: x for j, _, x, _ in rows}, []
    for size in (5, 90, 100_000):
        got = {r["report_id"]: r for r in mf.match_donors(df, 3, size).collect()}
        assert set(got) == {j for j, n, x, _ in rows if x is None and n != "none"}
        for i, r in got.items():
            _, name, _, pred = next(x for x in rows if x[0] == i)
            assert r["donor"] in brute_pool(rows, name, pred, i, 3) and values[r["donor"]] == r["donor_lx"]
        seen.append({i: r["donor"] for i, r in got.items()})
    assert seen[0] == seen[1] == seen[2]


def test_a_crowded_range_is_searched_whole(spark):
    """Two far-out predictions leave 60,000 others side by side: the donors are still the nearest."""
    rng = np.random.default_rng(5)
    pred = np.r_[rng.normal(size=60_000), 1e5, -1e5]
    asked = rng.random(len(pred)) < 0.05
    df = spark.createDataFrame(pd.DataFrame({"report_id": np.arange(len(pred)), "name": "c", "lx": np.where(asked, np.nan, 1.0), "pred": pred}))
    df = df.withColumn("lx", F.when(~F.isnan("lx"), F.col("lx")))
    got = mf.match_donors(df, 5, 4000).toPandas()
    given = np.sort(pred[~asked])
    here = pred[got["report_id"]]
    at = np.searchsorted(given, here)
    around = np.abs(given[np.clip(at[:, None] + np.arange(-5, 5), 0, len(given) - 1)] - here[:, None])
    assert len(got) == asked.sum() and (got["distance"] <= np.sort(around, 1)[:, 4] + 1e-12).all()


def test_null_lots_are_no_lot(spark):
    rows = [(i, i // 4, None if i % 2 else f"L{i // 8}", "c", float(i % 5) if i % 5 else None) for i in range(80)]
    df = spark.createDataFrame(rows, "report_id bigint, sheet_id bigint, lot_code string, name string, lx double")
    for i, other in ((r["report_id"], r["z"]) for r in mf._with_others(df, "lot_code", "z").collect()):
        lot = rows[i][2]
        mates = [x for j, _, k, _, x in rows if lot is not None and k == lot and j != i and x is not None]
        assert other == (None if not mates else sum(mates) / len(mates))


def test_all_predictions_equal_and_empty(spark):
    df = spark.createDataFrame([(i, "c", 1.0 if i else None, 2.0) for i in range(50)], "report_id bigint, name string, lx double, pred double")
    assert mf.match_donors(df).count() == 1
    assert mf.match_donors(df.limit(0)).count() == 0
    assert mf.missing_fields(reports(spark, []), registry(spark)).count() == 0
    alone = [("Tin, FOB", T, None, 1, None, None)]
    assert mf.filled_reports(reports(spark, alone), registry(spark)).collect()[0]["price"] is None

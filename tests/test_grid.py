import datetime as dt
import random

from tidegrid.operators.regular_grid import grid, missing_periods

READINGS = "commodity_type string, time timestamp_ntz, price double, reading_id bigint, feed string, received_at timestamp_ntz, freq string"
LISTINGS = "listing_id bigint, commodity_type string, freq string, active_from timestamp_ntz, active_to timestamp_ntz, price double"
T0 = dt.datetime(2024, 7, 3)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def row(name, minutes, price, i=1):
    return (name, None if minutes is None else at(minutes), price, i, "f", None, "clash")


def test_against_brute_force(spark):
    rnd = random.Random(4)
    readings = [row(rnd.choice(["A b", " a  B", "a b\t", "C"]), rnd.randrange(-60, 2000) + rnd.random(), rnd.choice([None, float("nan"), 1.0, 2.5, -3.0, 7.0]), k) for k in range(150)]
    listings = [(1, "A b", "10m", at(5), at(700), 0.0), (2, "A b", "10m", at(900), at(1500), 0.0), (3, "C", "1h", at(0), at(1440), 0.0)]
    got = grid(spark.createDataFrame(readings, READINGS), spark.createDataFrame(listings, LISTINGS), shard_periods=7).collect()
    want = {}
    for i, name, freq, a, b, _ in listings:
        step = dt.timedelta(minutes={"10m": 10, "1h": 60}[freq])
        t = dt.datetime(2024, 7, 2)
        while t < b:
            if t >= a:
                inside = [(r[1], r[3], r[2]) for r in readings if " ".join(r[0].split()).lower() == name.lower() and t <= r[1] < t + step and r[2] is not None and r[2] == r[2]]
                want[i, t] = (max(inside)[2] if inside else None, len(inside))
            t += step
    assert len(got) == len(want)
    for i in (1, 2, 3):
        times = sorted(t for j, t in want if j == i)
        mine = {r["period_start"]: r for r in got if r["listing_id"] == i}
        prev = None
        for k, t in enumerate(times):
            r, (price, n) = mine[t], want[i, t]
            prev = price if price is not None else prev
            nxt = next((want[i, u][0] for u in times[k + 1 :] if want[i, u][0] is not None), None)
            assert (r["price"], r["n_readings"], r["is_missing"], r["prev_price"], r["next_price"]) == (price, n, price is None, prev, nxt)
            assert r["filled_price"] == (price if price is not None else prev if prev is not None else nxt)


def test_shards_agree(spark, data):
    from tidegrid.sources.panels import table

    a, b = (missing_periods(table(spark, data, "commodities"), table(spark, data, "listings"), k) for k in (50, 5000))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_empty_and_null(spark):
    none, listing = spark.createDataFrame([], READINGS), [(1, "a", "1h", at(0), at(180), None), (2, None, "1h", at(0), at(180), None), (3, "b", "soon", at(0), at(180), None), (4, "b", "1h", None, at(9), None)]
    rows = grid(none, spark.createDataFrame(listing, LISTINGS)).collect()
    assert len(rows) == 3 and all(r["is_missing"] and r["filled_price"] is None and r["periods_since"] is None for r in rows)
    assert grid(none, spark.createDataFrame([], LISTINGS)).count() == 0
    odd = spark.createDataFrame([row(None, 1, 1.0), row("a", None, 1.0), row("a", 1, None), row("a", 1, float("inf")), row("a", 61, 5.0), row("a", 61, 5.0), row("a", 61, 4.0)], READINGS)
    got = {r["period_start"]: r for r in grid(odd, spark.createDataFrame(listing[:1], LISTINGS)).collect()}
    assert [got[at(m)]["price"] for m in (0, 60, 120)] == [None, 5.0, None]  # tie in time: higher id, then higher price
    assert got[at(120)]["interpolated_price"] is None and got[at(120)]["periods_since"] == 1

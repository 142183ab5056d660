import datetime as dt

import numpy as np

from tidegrid.operators import spikes

READINGS = "commodity_type string, time timestamp_ntz, price double, reading_id bigint, sid string, chunk string"
LISTINGS = "listing_id bigint, commodity_type string, freq string, active_from timestamp_ntz, active_to timestamp_ntz"
T0 = dt.datetime(2024, 7, 3)


def walk(n, seed):
    return np.round(100 * np.exp(np.cumsum(np.random.default_rng(seed).normal(0, 0.004, n))), 4)


def frame(spark, series, extra=()):
    rows = [(name, T0 + dt.timedelta(minutes=10 * i + (i % 3)), float(p), k * 100_000 + i, "clash", "clash") for k, (name, ps) in enumerate(series.items()) for i, p in enumerate(ps)]
    return spark.createDataFrame(rows + list(extra), READINGS)


def listing(spark, names):
    return spark.createDataFrame([(i + 1, n, "10m", T0, T0 + dt.timedelta(days=60)) for i, n in enumerate(names)], LISTINGS)


def planted():
    a, b = walk(600, 1), walk(400, 2)
    a[100] *= 3
    a[200:205] *= 0.4
    a[300:] *= 2  # a lasting move
    a[400:406] *= 3  # six times: no case
    a[505] = -1.0
    a[450:463] = a[450]
    b[10] = 0.0
    b[64:67] *= 5
    return a, b


def test_planted_cases_in_any_shards(spark):
    a, b = planted()
    sticky = np.repeat(walk(20, 5), 20)
    want = {100, *range(200, 205), 505, *range(450, 463), 100_010, *range(100_064, 100_067)}
    copy = [(" a", T0 + dt.timedelta(minutes=1001), float(a[100]), 7_000_000, "", ""), ("A", T0 + dt.timedelta(minutes=1001), float(a[100]), 100, "", ""), ("A", T0 - dt.timedelta(days=1), 9e9, 7_000_001, "", "")]
    df, lists = frame(spark, {"A": a, "B": b, "S": sticky}, copy), listing(spark, ["A", "B", "S"])
    for size in (7, 64, 100_000):
        got = {r["reading_id"]: r["reason"] for r in spikes.spike_readings(df, lists, shard_rows=size).collect()}
        assert set(got) == want | {7_000_000}, size
        assert got[505] == got[100_010] == "impossible" and got[450] == "stuck" and got[100] == "spike"


def test_shards_equal_the_whole_series(spark):
    x = walk(500, 9)
    rng = np.random.default_rng(10)
    for k in rng.choice(490, 25, replace=False):
        x[k : k + rng.integers(1, 9)] *= rng.choice([0.3, 0.93, 1.06, 2.5])
    moves = np.abs(np.diff(np.log(x)))
    spike, _ = spikes.judge(x, float(np.median(moves[moves > 0])), True)
    got = {r["reading_id"] for r in spikes.spike_readings(frame(spark, {"A": x}), listing(spark, ["A"]), shard_rows=13).where("reason = 'spike'").collect()}
    assert len(got ^ set(np.flatnonzero(spike))) <= 1  # the median over shards is that of a histogram


def test_shards_are_bounded(spark):
    """A source whose readings crowd into one hour of sixty days is cut by rows, not by time."""
    rows = [("A", T0 + dt.timedelta(seconds=k), 1.0, k, "", "") for k in range(3000)] + [("A", T0 + dt.timedelta(days=59), 1.0, 9000, "", ""), ("B", T0, 1.0, 9001, "", "")]
    listed = spikes.listed_readings(spark.createDataFrame(rows, READINGS), listing(spark, ["A", "B"]))
    sizes = [r["count"] for r in spikes._cut(listed, spikes._widths(listed, 100)).groupBy("sid", "chunk").count().collect()]
    assert sum(sizes) == 3002 and max(sizes) <= 200


def test_edges_at_scale_one_bound_a_spike():
    """A lasting move, a slow drift and an excursion of six points are no spikes; one next to a lasting move is."""
    u, flat = 0.001, np.zeros(60)
    wobble = np.where(np.arange(60) % 2, u, 0.0)
    for what, change, want in (
        ("move", np.where(np.arange(60) >= 30, 0.5, 0.0), []), ("drift", np.linspace(0, 0.06, 60), []), ("six", np.where((np.arange(60) >= 20) & (np.arange(60) < 26), 0.5, 0.0), []),
        ("five", np.where((np.arange(60) >= 20) & (np.arange(60) < 25), -0.5, 0.0), [*range(20, 25)]), ("varied", flat + np.isin(np.arange(60), [20, 22]) * 0.3 + (np.arange(60) == 21) * 0.1, [20, 21, 22]),
        ("near a move", np.where(np.arange(60) >= 23, 0.2, 0.0) + (np.arange(60) == 21) * 0.5, [21]), ("two", flat + (np.arange(60) == 20) * 0.3 - (np.arange(60) == 22) * 0.3, [20, 22]),
    ):
        spike, _ = spikes.judge(np.exp(wobble + change), u, True)
        assert np.flatnonzero(spike).tolist() == want, what

def test_odd_input(spark):
    lists = listing(spark, ["A"])
    rows = [("A", T0, None, 1, "", ""), ("A", None, 1.0, 2, "", ""), (None, T0, -1.0, 3, "", ""), ("A", T0, float("nan"), 4, "", ""), ("A", T0, -5.0, 5, "", ""), ("A", T0, -5.0, 5, "", ""), ("A", T0, 1.0, None, "", "")]
    df = spark.createDataFrame(rows, READINGS)
    assert [tuple(r) for r in spikes.spike_readings(df, lists).collect()] == [(5, "impossible")]
    assert spikes.spike_readings(df.limit(0), lists).count() == 0 and spikes.spike_readings(df, lists.limit(0)).count() == 0
    flat = frame(spark, {"A": np.full(40, 2.0)})
    assert spikes.spike_readings(flat, lists).count() == 0  # never changes: neither usual movement nor sticking

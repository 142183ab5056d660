import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidegrid.llm import rank_summary as rs


def ranks_of(sorted_values, v):
    return np.searchsorted(sorted_values, v, "left") + 1, np.searchsorted(sorted_values, v, "right")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 30), min_size=1, max_size=60), min_size=1, max_size=6), st.sampled_from([0.01, 0.1, 0.3]))
def test_merged_intervals_hold_the_rank(parts, eps):
    flat = []
    for i, p in enumerate(parts):
        code, v, rank, n = rs.exact(np.zeros(len(p), np.int64), np.array(p, float))
        at = rs.thin(code, v, rank, rank, n, eps)
        flat.append((np.zeros(len(at), np.int64), np.full(len(at), i), v[at], rank[at], rank[at], n[at]))
    code, v, low, high, n = rs.merge(*[np.concatenate(c) for c in zip(*flat, strict=True)])
    every = np.sort(np.concatenate([np.array(p, float) for p in parts]))
    assert n[0] == len(every) and (low <= high).all() and (np.diff(v) >= 0).all()
    for x, a, b in zip(v, low, high, strict=True):
        lo, hi = ranks_of(every, x)
        assert a <= hi and b >= lo
    assert (high[1:] - low[:-1]).max(initial=0) <= 2 * eps * len(every) + 2 * len(parts) + 1


def test_bound_on_groups(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"k": np.where(rng.random(60_000) < 0.4, "hot", rng.integers(0, 20, 60_000).astype(str)), "day": rng.integers(0, 30, 60_000), "x": np.round(rng.lognormal(3, 2, 60_000), 2)})
    df = spark.createDataFrame(pdf).repartition(7)
    ps = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    whole = rs.grouped_percentiles(df, ["k"], "x", ps, 0.01).collect()
    days = rs.merged(rs.summarise(df, ["k", "day"], "x", 0.002, 1000), ["k", "day"], 0.002, 4)
    from_days = rs.percentiles(rs.merged(days, ["k"], 0.002, 4), ["k"], ps).collect()
    for got in (whole, from_days):
        assert len(got) == pdf["k"].nunique() * len(ps)
        for r in got:
            x = np.sort(pdf.loc[pdf["k"] == r["k"], "x"].to_numpy())
            want = max(1, int(np.ceil(r["p"] * len(x) - 1e-9)))
            lo, hi = ranks_of(x, r["value"])
            off = 0 if lo <= want <= hi else min(abs(lo - want), abs(hi - want))
            assert r["n"] == len(x) and off <= r["rank_error"] <= 0.01 * len(x) + 1


def test_odd_values_and_empty(spark):
    df = spark.createDataFrame([("a", 1.0, 5), ("a", None, 5), ("a", float("nan"), 5), ("a", float("inf"), 5), (None, 2.0, 5), ("b", None, 5), ("a", 1.0, 5)], "k string, x double, n int")
    got = {r["k"]: (r["n"], r["value"]) for r in rs.grouped_percentiles(df, ["k"], "x", [0.5]).collect()}
    assert got == {"a": (2, 1.0), None: (1, 2.0)}
    assert rs.grouped_percentiles(df.limit(0), ["k"], "x", [0.5]).count() == 0
    with pytest.raises(ValueError):
        rs.percentiles(rs.summarise(df, ["k"], "x"), ["k"], [1.5])


def test_order_and_partitions_of_rows_play_no_part(spark):
    """Sorted before they are cut into chunks and merged by content: rows dealt alike but in another order agree."""
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"k": rng.integers(0, 3, 5000), "x": rng.normal(size=5000), "place": rng.integers(0, 6, 5000)})
    out = []
    for some in (pdf, pdf.sample(frac=1, random_state=1)):
        df = spark.createDataFrame(some).repartition(6, "place")
        rows = rs.merged(rs.summarise(df, ["k"], "x", 0.01, 100), ["k"], 0.01, 4).orderBy("k").collect()
        out.append([(r["k"], r["n"], list(r["vs"]), list(r["rmin"]), list(r["rmax"]), r["err"]) for r in rows])
    assert out[0] == out[1]


def test_levels_follow_the_number_of_summaries(spark):
    assert [rs.levels(n, 4) for n in (0, 1, 4, 5, 16, 17, 64)] == [1, 1, 1, 2, 2, 3, 3]
    df = spark.createDataFrame([(k % 2, float(k)) for k in range(900)], "k int, x double").repartition(70)
    many = rs.summarise(df, ["k"], "x", 0.01)
    assert many.count() > 64
    for r in rs.percentiles(rs.merged(many, ["k"], 0.01, 4), ["k"], [0.5]).collect():
        assert r["n"] == 450 and abs(r["value"] - 449) <= 2 * (0.02 * 450 + 1)


def test_few_rows_stay_exact(spark):
    df = spark.createDataFrame([(float(k % 37),) for k in range(300)], "x double").selectExpr("1 as k", "x").repartition(5)
    for r in rs.grouped_percentiles(df, ["k"], "x", [0.0, 0.1, 0.5, 0.99, 1.0], 0.005).collect():
        assert r["rank_error"] == 0 and r["value"] == sorted(float(k % 37) for k in range(300))[max(0, int(np.ceil(r["p"] * 300 - 1e-9)) - 1)]

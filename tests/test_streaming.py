import datetime as dt

import numpy as np

from tidegrid.functions import kernels
from tidegrid.streaming import features

SCHEMA = "id string, t timestamp_ntz, x double"
T0 = dt.datetime(2024, 1, 1)


def test_windows_and_change_points(spark, tmp_path):
    rng = np.random.default_rng(0)
    x = np.r_[rng.normal(0, 0.1, 150), rng.normal(0.5, 0.1, 50)]
    rows = [("a", T0 + dt.timedelta(minutes=i), float(v)) for i, v in enumerate(x)] + [("a", T0, None)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    made = {"w": features.tumbling_features(stream(), "id", "t", "x", "1 hour", "10 minutes"), "c": features.cusum_events(stream(), "id", "t", "x", 5.0, 50, 1.0), "s": features.sliding_features(stream(), "id", "t", "x", "2 hours", "1 hour", "10 minutes")}
    for name, df in made.items():
        q = df.writeStream.format("memory").queryName(f"out_{name}").outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    windows = spark.table("out_w").orderBy("window_start").collect()
    assert [r["n"] for r in windows] == [60, 60, 60] and abs(windows[0]["absolute_energy"] - float((x[:60] ** 2).sum())) < 1e-9
    events = [r["t"] for r in spark.table("out_c").orderBy("t").collect()]
    want = [T0 + dt.timedelta(minutes=int(i)) for i in np.flatnonzero(kernels.cusum(5.0, 50, 1.0)(x))]
    assert events == want and want
    assert spark.table("out_s").count() >= 3

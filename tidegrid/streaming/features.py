"""Order-free features over event-time windows, and change points per series, as Structured Streaming.

Rows later than the watermark are dropped by Spark; windows close when the watermark passes their end."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# name -> aggregate of the value column v__: all are sums, extremes or moments, so their state is of constant size
ORDER_FREE = {
    "n": lambda: F.count("v__"), "absolute_energy": lambda: F.sum(F.col("v__") * F.col("v__")), "absolute_maximum": lambda: F.max(F.abs("v__")), "mean": lambda: F.avg("v__"),
    "minimum": lambda: F.min("v__"), "maximum": lambda: F.max("v__"), "standard_deviation": lambda: F.stddev_samp("v__"), "root_mean_square": lambda: F.sqrt(F.avg(F.col("v__") * F.col("v__"))),
}


def _windowed(stream: DataFrame, entity: str, time: str, value: str, delay: str, window: Column) -> DataFrame:
    rows = stream.select(F.col(entity), F.col(time).cast("timestamp").alias("t__"), F.col(value).cast("double").alias("v__")).where("v__ is not null and not isnan(v__)")
    out = rows.withWatermark("t__", delay).groupBy(entity, window.alias("w__")).agg(*[f().alias(n) for n, f in ORDER_FREE.items()])
    return out.select(entity, F.col("w__.start").alias("window_start"), F.col("w__.end").alias("window_end"), *ORDER_FREE)


def tumbling_features(stream: DataFrame, entity: str, time: str, value: str, every: str, delay: str) -> DataFrame:
    """Features of each entity and window of length `every`; rows may come up to `delay` late."""
    return _windowed(stream, entity, time, value, delay, F.window("t__", every))


def sliding_features(stream: DataFrame, entity: str, time: str, value: str, size: str, slide: str, delay: str) -> DataFrame:
    return _windowed(stream, entity, time, value, delay, F.window("t__", size, slide))


def session_features(stream: DataFrame, entity: str, time: str, value: str, gap: str, delay: str) -> DataFrame:
    """Features of each entity's sessions, which a silence of `gap` ends."""
    return _windowed(stream, entity, time, value, delay, F.session_window("t__", gap))


def cusum_events(stream: DataFrame, entity: str, time: str, value: str, threshold: float, warmup_period: int, drift: float = 0.0) -> DataFrame:
    """entity, time, up, down for each change point of a two-sided CUSUM that warms up anew after each.

    State of an entity: count, mean and squared deviation of the warm-up and the two sums. Rows of a micro-batch are
    taken in order of time; rows that come in a later batch than they belong to are taken as they come. Null values and
    times are left out."""
    rows = stream.select(F.col(entity), F.col(time).cast("timestamp").alias("t"), F.col(value).cast("double").alias("v")).where("t is not null and v is not null and not isnan(v)")

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        n, mean, sq, up, down = state.get if state.exists else (0, 0.0, 0.0, 0.0, 0.0)
        found = []
        pdf = pd.concat(list(batches)).sort_values(["t", "v"])
        for t, v in zip(pdf["t"], pdf["v"], strict=True):
            if n < warmup_period:
                n += 1
                step = v - mean
                mean += step / n
                sq += step * (v - mean)
                continue
            spread = math.sqrt(sq / n) if n else 0.0
            z = (v - mean) / spread if spread > 0 else 0.0
            up, down = max(0.0, up + z - drift), max(0.0, down - z - drift)
            if up > threshold or down > threshold:
                found.append((key[0], t, up, down))
                n, mean, sq, up, down = 0, 0.0, 0.0, 0.0, 0.0
        state.update((n, float(mean), float(sq), float(up), float(down)))
        if found:
            yield pd.DataFrame(found, columns=[entity, "t", "up", "down"])

    kind = dict(rows.dtypes)[entity]
    out = rows.groupBy(entity).applyInPandasWithState(run, f"`{entity}` {kind}, t timestamp, up double, down double", "n int, mean double, sq double, up double, down double", "append", "NoTimeout")
    return out.withColumnRenamed("t", time)

"""Rolling totals and averages over trailing periods, days without activity included.

Rows are reduced to one per entity and day first, and those to one array per entity, as long as the calendar at most. Per
entity a cumulative prefix sum runs over a dense calendar (days without activity carry the prefix forward), and a
trailing total is the difference of two prefixes. Sums are decimal, so differences of prefixes lose nothing; values too
large for decimals have prefix sums of their own. A window task holds one entity's calendar, never its raw rows.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Values below LARGE are summed with twelve decimals, without error; others as doubles.
AMOUNT, TOTAL, LARGE = "decimal(30,12)", "decimal(38,12)", 1e18


def trailing_totals(df: DataFrame, entity: str, time: str, value: str, first_day: dt.date, last_day: dt.date, windows: Sequence[int] = (7, 30)) -> DataFrame:
    """For each entity and each day from `first_day` to `last_day`: entity, day, n_readings, total, and for each w of
    `windows` n_{w}d, total_{w}d, avg_{w}d over the w days that end with that day.

    Null, NaN and infinite values don't count; rows with a null entity or time, or a day outside the calendar, don't
    either. Values are taken to twelve decimals; those of 1e18 and more count as doubles, and a total with any of them is
    as exact as doubles are (infinite or NaN beyond their range). An entity without any counted row has no rows; a window without readings has total 0 and a
    null average. Repeated rows count each time (drop copies before). An empty frame gives no rows.
    """
    if not windows or min(windows) < 1:
        raise ValueError("windows are one day long at least")
    v = F.col(value).cast("double")
    usable = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    rows = df.where(usable).select(F.col(entity).alias("entity"), F.col(time).cast("date").alias("day"), v.alias("v"))
    rows = rows.where(F.col("entity").isNotNull() & F.col("day").between(F.lit(first_day), F.lit(last_day)))
    small = F.abs(F.col("v")) < LARGE
    none, zero = F.lit(0).cast(TOTAL), F.lit(0.0)
    sums = F.sum(F.when(small, F.col("v").cast(AMOUNT)).otherwise(F.lit(0).cast(AMOUNT))).cast(TOTAL).alias("s"), F.sum(F.when(small, zero).otherwise(F.col("v"))).alias("x"), F.count(F.lit(1)).alias("n")
    daily = rows.groupBy("entity", "day").agg(*sums)
    # one row per entity: its days as an array, to which the calendar's days are added
    days = daily.groupBy("entity").agg(F.collect_list(F.struct("day", "s", "x", "n")).alias("of"))
    calendar = F.sequence(F.lit(first_day), F.lit(last_day), F.expr("interval 1 day"))
    idle = F.transform(calendar, lambda d: F.struct(d.alias("day"), none.alias("s"), zero.alias("x"), F.lit(0).cast("bigint").alias("n")))
    dense = days.select("entity", F.inline(F.concat("of", idle))).groupBy("entity", "day").agg(F.sum("s").cast(TOTAL).alias("s"), F.sum("x").alias("x"), F.sum("n").alias("n"))
    along = Window.partitionBy("entity").orderBy("day")
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    prefix = dense.select("*", F.sum("s").over(upto).cast(TOTAL).alias("ps"), F.sum("x").over(upto).alias("px"), F.sum("n").over(upto).alias("pn"))
    out = [F.col("entity").alias(entity), F.col("day"), F.col("n").alias("n_readings"), (F.col("s").cast("double") + F.col("x")).alias("total")]
    for w in windows:
        since = lambda c, nothing, w=w: F.col(c) - F.coalesce(F.lag(c, w).over(along), nothing)
        s = since("ps", none).cast("double") + since("px", zero)
        n = since("pn", F.lit(0).cast("bigint"))
        out += [n.alias(f"n_{w}d"), s.alias(f"total_{w}d"), F.when(n > 0, s / n).alias(f"avg_{w}d")]
    return prefix.select(*out)

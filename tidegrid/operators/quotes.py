"""Distinct priced quotes of a reading table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.clean import name_key, real


def quotes(readings: DataFrame) -> DataFrame:
    """(key, time, price) of every quote once: redeliveries and copies through a second feed are equal in all three.
    Rows without a name, a time or a price (null, NaN, infinite) are no quotes."""
    rows = readings.select(name_key(F.col("commodity_type")).alias("key"), F.col("time"), real(F.col("price")).alias("price"))
    return rows.where(F.col("key").isNotNull() & F.col("time").isNotNull() & F.col("price").isNotNull()).distinct()


def registered(df: DataFrame, registry: DataFrame) -> DataFrame:
    """`df` with `key` replaced by the registered name `commodity_type`; rows of unregistered names fall away."""
    names = registry.select(name_key(F.col("commodity_type")).alias("key"), "commodity_type").where(F.col("key").isNotNull()).groupBy("key").agg(F.min("commodity_type").alias("commodity_type"))
    return df.join(names, "key").select("commodity_type", *[c for c in df.columns if c not in ("key", "commodity_type")])

"""Queries of the data-preparation operators over the panel tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.operators import matched_fill, regular_grid, spikes
from tidegrid.operators.quotes import quotes, registered
from tidegrid.operators.trailing_totals import trailing_totals
from tidegrid.sources.panels import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return regular_grid.missing_periods(table(spark, d, "commodities"), table(spark, d, "listings"))


def p1_grid(spark: SparkSession, d: str) -> DataFrame:
    return regular_grid.grid(table(spark, d, "commodities"), table(spark, d, "listings"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return matched_fill.missing_fields(table(spark, d, "price_reports"), table(spark, d, "commodity_types"))


def p3_filled(spark: SparkSession, d: str) -> DataFrame:
    return matched_fill.filled_reports(table(spark, d, "price_reports"), table(spark, d, "commodity_types"))


def p3_checks(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the filling: rows, fields filled, and fields whose donor is of another commodity, lacks the
    field itself or shows another value."""
    rows = p3_filled(spark, d)
    donors = rows.where(~F.col("price_filled") & F.col("price").isNotNull()).groupBy(F.col("report_id").alias("price_donor")).agg(F.max("commodity_type").alias("name"), F.max("price").alias("shown"))
    rows = rows.join(donors, "price_donor", "left")
    wrong = F.col("price_filled") & ~((F.col("name") == F.col("commodity_type")) & (F.abs(F.col("shown") / F.col("price") - 1) < 1e-9)).eqNullSafe(True)
    names = rows.where("not name_filled and commodity_type is not null").select(F.col("report_id").alias("name_donor"), F.col("commodity_type").alias("own")).distinct()
    rows = rows.withColumn("wrong", wrong).join(names, "name_donor", "left")
    other = F.col("name_filled") & ~(F.col("own") == F.col("commodity_type")).eqNullSafe(True)
    return rows.agg(F.count(F.lit(1)).alias("reports"), F.count_if("price_filled").alias("prices_filled"), F.count_if("name_filled").alias("names_filled"), F.count_if("wrong").alias("wrong_prices"), F.count_if(other).alias("wrong_names"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return spikes.spike_readings(table(spark, d, "commodities"), table(spark, d, "listings")).select("reading_id")


def p4_reasons(spark: SparkSession, d: str) -> DataFrame:
    return spikes.spike_readings(table(spark, d, "commodities"), table(spark, d, "listings"))


def p4_bounds_and_runs(spark: SparkSession, d: str) -> DataFrame:
    """Impossible prices and runs of one price."""
    return p4_reasons(spark, d).where("reason <> 'spike'")


def p5_trailing(spark: SparkSession, d: str) -> DataFrame:
    """The calendar runs from the first to the last listed day (active_to is no longer listed); readings of clocks beyond
    it don't count."""
    until = F.timestamp_add("MICROSECOND", F.lit(-1), F.col("active_to").cast("timestamp_ntz"))
    span = table(spark, d, "listings").agg(F.min(F.col("active_from").cast("date")), F.max(until.cast("date"))).first()
    rows = quotes(table(spark, d, "commodities"))
    if span[0] is None:
        rows, span = rows.limit(0), (dt.date(1970, 1, 1),) * 2
    out = trailing_totals(rows, "key", "time", "price", span[0], span[1], (7, 30))
    return registered(out, table(spark, d, "commodity_types"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (p1_found, p1_grid, p3_found, p3_filled, p3_checks, p4_found, p4_reasons, p4_bounds_and_runs, p5_trailing)
    return {f.__name__: f for f in found}

"""Queries of the text operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm import packing, quality, rank_summary, tiling
from tidegrid.operators.quotes import quotes, registered
from tidegrid.sources.panels import table

PS = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def p2_percentiles(spark: SparkSession, d: str) -> DataFrame:
    out = rank_summary.grouped_percentiles(quotes(table(spark, d, "commodities")), ["key"], "price", PS)
    return registered(out, table(spark, d, "commodity_types"))


def p2_daily(spark: SparkSession, d: str) -> DataFrame:
    """A summary for each day, in the form in which days can be put together."""
    rows = quotes(table(spark, d, "commodities")).withColumn("day", F.col("time").cast("date"))
    first = rank_summary.summarise(rows, ["key", "day"], "price", rank_summary.EPS / 4)
    return registered(rank_summary.merged(first, ["key", "day"], rank_summary.EPS / 4), table(spark, d, "commodity_types"))


def p2_from_days(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of the whole half year put together from the summaries of single days."""
    return rank_summary.percentiles(rank_summary.merged(p2_daily(spark, d), ["commodity_type"], rank_summary.EPS / 2), ["commodity_type"], PS)


def p2_daily_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of single days."""
    return rank_summary.percentiles(p2_daily(spark, d), ["commodity_type", "day"], PS)


def p6_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed(table(spark, d, "documents"), table(spark, d, "pack_profiles"))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers, tokens and unused share of each profile."""
    used = p6_packed(spark, d).where("n_tokens > 0").groupBy("profile_id", "capacity", "container_id").agg(F.sum("n_tokens").alias("tokens"))
    per = used.groupBy("profile_id", "capacity").agg(F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"))
    return per.withColumn("unused_share", 1 - F.col("tokens") / (F.col("containers") * F.col("capacity")))


def p6_checks(spark: SparkSession, d: str) -> DataFrame:
    """Per profile what must hold of a packing: documents placed, containers beyond their capacity or with a fill that
    isn't their sum, documents divided without need or with parts that don't make up their size, and whether the
    profile needs fewer containers than one for each document."""
    rows = p6_packed(spark, d)
    boxes = rows.groupBy("profile_id", "capacity", "container_id").agg(F.sum("n_tokens").alias("tokens"), F.max("fill").alias("fill"), F.min("fill").alias("least"))
    boxes = boxes.groupBy("profile_id").agg(F.count_if(F.expr("tokens > capacity or tokens <> fill or fill <> least")).alias("wrong_containers"))
    sizes = packing.token_sizes(table(spark, d, "documents"))
    docs = rows.groupBy("profile_id", "capacity", "doc_id").agg(F.sum("n_tokens").alias("placed"), F.count(F.lit(1)).alias("parts"), F.count_distinct("part").alias("numbers"))
    docs = docs.join(sizes, "doc_id", "left")
    needed = F.greatest(F.lit(1), F.ceil(F.col("tokens") / F.col("capacity")))
    wrong = (F.col("placed") != F.coalesce("tokens", F.lit(-1))) | (F.col("parts") != needed) | (F.col("parts") != F.col("numbers"))
    docs = docs.groupBy("profile_id").agg(F.count(F.lit(1)).alias("documents"), F.count_if(wrong).alias("wrong_documents"))
    return docs.join(boxes, "profile_id").select("profile_id", "documents", "wrong_documents", "wrong_containers")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs that hold a whole passage of 30 words; shorter items have none."""
    rows = tiling.leaked(table(spark, d, "documents"), table(spark, d, "test_items"))
    return rows.where(F.col("in_order") & (F.col("words_found") >= tiling.least_words(tiling.PASSAGE))).select("item_id", "doc_id")


def p7_coverage(spark: SparkSession, d: str) -> DataFrame:
    return tiling.leaked(table(spark, d, "documents"), table(spark, d, "test_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.not_prose(table(spark, d, "documents"), table(spark, d, "common_words"))


def p8_statistics(spark: SparkSession, d: str) -> DataFrame:
    return quality.text_statistics(table(spark, d, "documents"), table(spark, d, "common_words"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p2_percentiles, p2_daily, p2_from_days, p2_daily_percentiles, p6_packed, p6_fill, p6_checks, p7_found, p7_coverage, p8_found, p8_statistics)}

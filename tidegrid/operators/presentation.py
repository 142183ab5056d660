"""Data behind the usual panel plots, and prompts about series for a language model of the caller's."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions.numbers import fdiv
from tidegrid.operators import evaluation, metrics
from tidegrid.operators.seasonality import long_to_wide
from tidegrid.spec import PanelSpec


def entity_counts(df: DataFrame) -> DataFrame:
    """Rows per entity (bars of the entities plot)."""
    return df.groupBy(PanelSpec.of(df).entity).agg(F.count(F.lit(1)).alias("n"))


def chosen_entities(df: DataFrame, n: int, seed: int | None = None) -> DataFrame:
    """n entities: the first by name, or a seeded draw."""
    e = PanelSpec.of(df).entity
    order = F.col(e) if seed is None else F.xxhash64(F.lit(seed), F.col(e))
    return df.select(e).distinct().orderBy(order, e).limit(n)


def panel_tails(df: DataFrame, entities: DataFrame, last: int) -> DataFrame:
    """The last rows of the chosen entities (panel plot)."""
    p = PanelSpec.of(df)
    rows = df.join(entities, p.entity, "left_semi")
    k = F.row_number().over(Window.partitionBy(p.entity).orderBy(F.col(p.time).desc()))
    return rows.withColumn("k__", k).where(F.col("k__") <= last).drop("k__")


def forecast_lines(y_true: DataFrame, y_pred: DataFrame, entities: DataFrame, last: int) -> DataFrame:
    """Actual tails and forecasts, long, with `line` (actual, forecast): forecast and backtest plots."""
    a = panel_tails(y_true, entities, last)
    b = y_pred.join(entities.toDF(y_pred.columns[0]), y_pred.columns[0], "left_semi").toDF(*a.columns[:2], *y_pred.columns[2:])
    return a.withColumn("line", F.lit("actual")).unionByName(b.select(*a.columns[:2], F.col(b.columns[2]).alias(a.columns[2])).withColumn("line", F.lit("forecast")))


def residual_histogram(y_resids: DataFrame, bins: int = 30) -> DataFrame:
    """entity, bin, n: residuals by equal bins between the greatest of all in size (residual plot)."""
    p = PanelSpec.of(y_resids)
    top = y_resids.agg(F.max(F.abs(p.target)).alias("t__"))
    place = F.least(F.floor(fdiv((F.col(p.target) + F.col("t__")) * bins, 2 * F.col("t__"))), F.lit(bins - 1))
    rows = y_resids.join(F.broadcast(top)).where(F.col(p.target).isNotNull() & (F.col("t__") > 0))  # a single row
    return rows.groupBy(p.entity, place.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def comet(y_train: DataFrame, y_true: DataFrame, y_pred: DataFrame, metric: str = "smape") -> DataFrame:
    """entity, cv (of the training rows), metric: difficulty against score."""
    p = PanelSpec.of(y_train)
    cv = y_train.groupBy(p.entity).agg(fdiv(F.stddev_samp(p.target), F.avg(p.target)).alias("cv"))
    return cv.join(metrics.point_metrics(y_true, y_pred, [metric]), p.entity)


def fva_points(y_true: DataFrame, y_pred: DataFrame, y_pred_bench: DataFrame, metric: str = "smape") -> DataFrame:
    return evaluation.rank_fva(y_true, y_pred, y_pred_bench, metric)


def grid_position(i: int, columns: int) -> tuple[int, int]:
    """Row and column (from 1) of the i-th (from 0) subplot; ValueError below zero."""
    if i < 0 or columns < 1:
        raise ValueError("positions count from 0, columns from 1")
    return i // columns + 1, i % columns + 1


def n_rows(n_plots: int, columns: int) -> int:
    return -(-n_plots // columns)


def narrate(df: DataFrame, basket: Sequence[object], context: str, ask: Callable[[str], str] | None = None, most_rows: int = 500) -> str:
    """A prompt to analyse the basket's series, as a table in text; or `ask`'s answer to it. Nothing is sent elsewhere."""
    p = PanelSpec.of(df)
    wide = long_to_wide(df.select(p.entity, p.time, p.target).where(F.col(p.entity).isin(list(basket))), list(basket))
    rows = wide.limit(most_rows + 1).toPandas()
    if len(rows) > most_rows:
        raise ValueError(f"more than {most_rows} periods: resample first")
    head = " | ".join(map(str, rows.columns))
    body = "\n".join(" | ".join("" if x is None or x != x else f"{x:.6g}" if isinstance(x, float) else str(x) for x in r) for r in rows.itertuples(index=False))
    prompt = f"Analyse trend, seasonality, anomalies and relations of these series.\nContext: {context}\n\n{head}\n{body}\n"
    return ask(prompt) if ask else prompt


def compare(df: DataFrame, basket: Sequence[object], other: Sequence[object], context: str, ask: Callable[[str], str] | None = None) -> str:
    """A prompt to compare two baskets of series."""
    both = "\n".join(narrate(df, b, context) for b in (basket, other))
    prompt = f"Compare the first group of series with the second.\n\n{both}"
    return ask(prompt) if ask else prompt

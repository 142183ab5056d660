"""Train/test splits of a panel, flat: one DataFrame with `split` and `is_test` instead of copies per split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.spec import PanelSpec


def _from_end(df: DataFrame) -> tuple[DataFrame, Column, Column]:
    """The panel with each row's number counted from its entity's end (1: last) and the entity's length."""
    p = PanelSpec.of(df)
    e = Window.partitionBy(p.entity)
    rows = df.withColumn("k__", F.row_number().over(e.orderBy(F.col(p.time).desc()))).withColumn("n__", F.count(F.lit(1)).over(e))
    return rows, F.col("k__"), F.col("n__")


def train_test_split(df: DataFrame, test_size: int | float = 0.25) -> tuple[DataFrame, DataFrame]:
    """(train, test): the last test_size rows of each entity are the test, or the share of them (train truncated).
    ValueError if a number of rows isn't less than the shortest series."""
    rows, k, n = _from_end(df)
    if isinstance(test_size, int):
        p = PanelSpec.of(df)
        short = df.groupBy(p.entity).count().agg(F.min("count")).first()[0]
        if short is not None and test_size >= short:
            raise ValueError(f"test_size {test_size} leaves nothing of a series of {short} rows")
        size: Column = F.lit(test_size)
    else:
        if not 0 < test_size < 1:
            raise ValueError("a share lies between 0 and 1")
        size = n - F.floor(n * (1 - test_size)).cast("bigint")
    return rows.where(k > size).drop("k__", "n__"), rows.where(k <= size).drop("k__", "n__")


def _windows(df: DataFrame, test_size: int, n_splits: int, step_size: int, window_size: int | None) -> DataFrame:
    if min(test_size, n_splits, step_size) < 1:
        raise ValueError("test_size, n_splits and step_size are positive")
    rows, k, _ = _from_end(df)
    cutoffs = F.explode(F.array(*[F.struct(F.lit(i).alias("split"), F.lit(test_size + step_size * (n_splits - 1 - i)).alias("cutoff")) for i in range(n_splits)]))
    out = rows.withColumn("s__", cutoffs).withColumn("split", F.col("s__.split"))
    cut = F.col("s__.cutoff")
    train = k > cut if window_size is None else (k > cut) & (k <= cut + window_size)
    test = (k <= cut) & (k > cut - test_size)
    return out.where(train | test).withColumn("is_test", test).drop("k__", "n__", "s__")


def expanding_window_split(df: DataFrame, test_size: int, n_splits: int = 5, step_size: int = 1) -> DataFrame:
    """Rows of n_splits splits, 0 the oldest: the panel's columns, split, is_test. Train rows are all before the test."""
    return _windows(df, test_size, n_splits, step_size, None)


def sliding_window_split(df: DataFrame, test_size: int, n_splits: int = 5, step_size: int = 1, window_size: int = 10) -> DataFrame:
    """As expanding_window_split, train rows being the window_size rows before the test."""
    return _windows(df, test_size, n_splits, step_size, window_size)


def as_pairs(splits: DataFrame, n_splits: int) -> dict[int, tuple[DataFrame, DataFrame]]:
    """{split: (train, test)} views of a flat split."""
    one = lambda i, test: splits.where((F.col("split") == i) & (F.col("is_test") == test)).drop("split", "is_test")
    return {i: (one(i, False), one(i, True)) for i in range(n_splits)}


def long_enough(df: DataFrame, least: int, drop: bool = True) -> DataFrame:
    """Entities of at least `least` rows; the others are dropped, or raise ValueError."""
    p = PanelSpec.of(df)
    short = df.groupBy(p.entity).count().where(F.col("count") < least).select(p.entity)
    if not drop and short.limit(1).count():
        raise ValueError(f"there are series of fewer than {least} rows")
    return df.join(short, p.entity, "left_anti").select(*df.columns)

"""Readers of panel tables and writers of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The parquet table `name` (a file or a folder of files) below `folder`."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def read_panel(spark: SparkSession, path: str, entity: str, time: str, values: list[str], format: str = "parquet", **options: object) -> DataFrame:
    """A panel from any source format of Spark (parquet, orc, csv, json, ...), columns in panel order."""
    return spark.read.format(format).options(**options).load(path).select(entity, time, *values)


def write_panel(df: DataFrame, path: str, partition_by: list[str] | None = None, format: str = "parquet", mode: str = "errorifexists") -> None:
    """The panel written by partitions; one shuffle on the partition columns keeps files few."""
    out = df.repartition(*partition_by) if partition_by else df
    writer = out.write.format(format).mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def to_numpy(df: DataFrame, limit: int = 1_000_000):
    """A small frame's values as a numpy array on the driver; ValueError beyond `limit` rows."""
    rows = df.limit(limit + 1).toPandas()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows: keep working on the DataFrame")
    return rows.to_numpy()


def to_matrix(df: DataFrame, limit: int = 1_000_000):
    """The value columns (all but entity and time) as a numpy matrix; NaN, infinite and missing values become their
    column's mean. The mean is that of all rows; ValueError beyond `limit` rows."""
    names = df.columns[2:]
    clean = {c: F.when(~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf")), F.col(c).cast("double")) for c in names}
    rows = df.select(*[clean[c].alias(c) for c in names])
    means = rows.agg(*[F.avg(c).alias(c) for c in names]).first().asDict()
    return to_numpy(rows.fillna({c: m for c, m in means.items() if m is not None}), limit)

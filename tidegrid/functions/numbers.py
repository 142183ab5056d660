"""Arithmetic with a stated result for every input (the session may run in ANSI mode)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF, NAN = float("inf"), float("nan")


def fdiv(a: Column, b: Column) -> Column:
    """a / b in doubles; by zero: NaN for 0/0, else infinity with the sign of a; null if either is null."""
    a, b = a.cast("double"), b.cast("double")
    return F.when(b != 0, a / b).when(b.isNull() | a.isNull(), F.lit(None)).when(a == 0, F.lit(NAN)).when(a > 0, F.lit(INF)).otherwise(F.lit(-INF))


def plogp(p: Column) -> Column:
    """-p ln p, 0 for p = 0."""
    return F.when(p > 0, -p * F.log(p)).otherwise(0.0)


def correlation(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    """Pearson correlation from sums; NaN where a side is constant."""
    return fdiv(n * sxy - sx * sy, F.sqrt(F.greatest(n * sxx - sx * sx, F.lit(0.0))) * F.sqrt(F.greatest(n * syy - sy * sy, F.lit(0.0))))

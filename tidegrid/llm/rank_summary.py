"""Percentiles of very large columns from mergeable rank-interval summaries.

A summary of n values is a sorted list of tuples (v, rmin, rmax): the value v stands somewhere between rank rmin and
rank rmax in the sorted values. Summaries are made per partition (in chunks, in numpy), thinned out as far as the
permitted uncertainty allows, and merged by levels; the intervals of merged tuples follow from those of the parts, so
the rank error that has gathered is read off the summary itself and kept with it (`err`). Nothing is random, and a
summary is a plain row, so those of separate days or files can be stored and put together later. A key's summaries are
merged in groups of about `GROUP`, and the results again, until one is left: the number of levels follows the data, the
size of what a task holds for a key doesn't.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.plans.session import written

EPS = 0.001
CHUNK = 1 << 18
#: Summaries of a key that are merged at once, on average.
GROUP = 32

SUMMARY = "n bigint, vs array<double>, rmin array<bigint>, rmax array<bigint>, err bigint"


def _starts(code: np.ndarray) -> np.ndarray:
    """Where each run of equal codes begins."""
    return np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, np.int64)


def _within(x: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Cumulative sums that begin anew at each of `starts`."""
    total = np.cumsum(x)
    base = np.r_[0, total[starts[1:] - 1]]
    return total - np.repeat(base, np.diff(np.r_[starts, length]))


def thin(code: np.ndarray, v: np.ndarray, rmin: np.ndarray, rmax: np.ndarray, n: np.ndarray, eps: float) -> np.ndarray:
    """Indexes of the tuples kept: first and last of each code, and the last of each stretch of eps*n ranks, so that
    neighbours' ranks are 2*eps*n apart at most beyond the uncertainty they had. n: of the code, for each tuple."""
    if not len(code):
        return np.zeros(0, np.int64)
    step = np.maximum(1, np.floor(eps * n)).astype(np.int64)
    stretch = (rmin - 1) // step
    last = np.r_[(code[1:] != code[:-1]) | (stretch[1:] != stretch[:-1]), True]
    last[_starts(code)] = True
    return np.flatnonzero(last)


def exact(code: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tuples of values not summarised before: sorted, each at its own rank. Returns code, v, rank, n."""
    order = np.lexsort((v, code))
    code, v = code[order], v[order]
    starts = _starts(code)
    rank = _within(np.ones(len(v), np.int64), starts, len(v)) if len(v) else np.zeros(0, np.int64)
    return code, v, rank, np.repeat(np.diff(np.r_[starts, len(v)]), np.diff(np.r_[starts, len(v)]))


def merge(code: np.ndarray, part: np.ndarray, v: np.ndarray, rmin: np.ndarray, rmax: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Merges, for each code, the summaries `part` (flat tuples, summary after summary, sorted inside; n: of the part).

    In the union the lowest rank of a tuple is the sum, over all parts, of rmin of the part's last tuple up to it; the
    highest is the sum of what the parts' next tuples leave open. Both are running sums over the tuples in order.
    Returns code, v, rmin, rmax, n (of the code) in order of code and value."""
    first = np.r_[True, part[1:] != part[:-1]]
    last = np.r_[first[1:], True]
    up = np.where(first, rmin, rmin - np.r_[0, rmin[:-1]])
    after = np.where(last, n, np.r_[rmax[1:], 0] - 1)
    down = after - np.where(first, rmax - 1, rmax - 1)
    order = np.lexsort((np.arange(len(v)), v, code))
    code_o = code[order]
    starts = _starts(code_o)
    low = _within(up[order], starts, len(v))
    opened = np.bincount(code[first], weights=(rmax[first] - 1).astype(float), minlength=int(code.max()) + 1).astype(np.int64)
    total = np.bincount(code[first], weights=n[first].astype(float), minlength=int(code.max()) + 1).astype(np.int64)
    high = opened[code_o] + _within(down[order], starts, len(v)) - after[order] + rmax[order]
    return code_o, v[order], low, high, total[code_o]


def _rows(keys: pd.DataFrame, code: np.ndarray, v: np.ndarray, rmin: np.ndarray, rmax: np.ndarray, n: np.ndarray) -> pd.DataFrame:
    """One row per code with its tuples as arrays; keys: row c belongs to code c."""
    starts = _starts(code)
    if not len(starts):
        return pd.DataFrame({**{k: [] for k in keys.columns}, "n": [], "vs": [], "rmin": [], "rmax": [], "err": []})
    apart = np.r_[rmax[1:] - rmin[:-1], 0]
    apart[np.r_[starts[1:] - 1, len(code) - 1]] = 0
    err = (np.maximum.reduceat(apart, starts) + 1) // 2
    cut = starts[1:]
    out = keys.iloc[code[starts]].reset_index(drop=True)
    return out.assign(n=n[starts], vs=np.split(v, cut), rmin=np.split(rmin, cut), rmax=np.split(rmax, cut), err=err)


def _codes(pdf: pd.DataFrame, keys: list[str]) -> tuple[np.ndarray, pd.DataFrame]:
    code = pdf.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
    _, at = np.unique(code, return_index=True)
    return code, pdf.iloc[at][keys].reset_index(drop=True)


def _key_schema(df: DataFrame, keys: Sequence[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"`{k}` {kinds[k]}" for k in keys)


def summarise(df: DataFrame, keys: Sequence[str], value: str, eps: float = EPS, chunk: int = CHUNK) -> DataFrame:
    """Summaries per key and partition: columns of `keys`, then n, vs, rmin, rmax, err. No shuffle; a partition's rows
    are sorted, so that the order in which they came plays no part, and pass in chunks of `chunk`. Null, NaN and infinite
    values are left out; null keys are a key of their own. Chunks of a key whose n is 1/eps or less stay exact."""
    names = list(keys)
    if not 0 < eps < 0.5:
        raise ValueError("eps is a share of the ranks between 0 and 0.5")
    v = F.col(value).cast("double")
    rows = df.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))).select(*names, v.alias("v__"))

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        code, own = _codes(pdf, names)
        code, val, rank, n = exact(code, pdf["v__"].to_numpy())
        at = thin(code, val, rank, rank, n, eps)
        return _rows(own, code[at], val[at], rank[at], rank[at], n[at])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0
        for pdf in batches:
            held.append(pdf)
            size += len(pdf)
            if size >= chunk:
                yield of(pd.concat(held, ignore_index=True))
                held, size = [], 0
        if size:
            yield of(pd.concat(held, ignore_index=True))

    return rows.sortWithinPartitions(*names, "v__").mapInPandas(run, f"{_key_schema(rows, names)}, {SUMMARY}")


def _merge_rows(pdf: pd.DataFrame, names: list[str], eps: float) -> pd.DataFrame:
    code, own = _codes(pdf, names)
    sizes = pdf["vs"].map(len).to_numpy()
    flat = lambda c: np.concatenate(pdf[c].to_list()) if len(pdf) else np.zeros(0)
    parts = np.repeat(np.arange(len(pdf)), sizes)
    c, v, low, high, n = merge(np.repeat(code, sizes), parts, flat("vs"), flat("rmin").astype(np.int64), flat("rmax").astype(np.int64), np.repeat(pdf["n"].to_numpy(), sizes))
    at = thin(c, v, low, high, n, eps)
    return _rows(own, c[at], v[at], low[at], high[at], n[at])


def _merge_level(df: DataFrame, names: list[str], eps: float) -> DataFrame:
    """One summary for each value of the columns `names`, of which there are about GROUP rows at most."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # rows of the last key, which may go on in the next batch
        for pdf in batches:
            if not len(pdf):
                continue
            same = lambda x, y: all(a == b or pd.isna(a) and pd.isna(b) for a, b in zip(x, y, strict=True))
            code, _ = _codes(pdf, names)
            last = int(np.flatnonzero(code == code[-1])[0])
            going_on = held and same(held[-1][names].iloc[-1], pdf[names].iloc[0])
            if held and (last or not going_on):
                split = int(np.flatnonzero(code == code[0])[-1]) + 1 if going_on else 0
                yield _merge_rows(pd.concat([*held, pdf.iloc[:split]], ignore_index=True), names, eps)
                held, pdf, last = [], pdf.iloc[split:], max(0, last - split)
            if last:
                yield _merge_rows(pdf.iloc[:last], names, eps)
            held.append(pdf.iloc[last:])
        if held:
            yield _merge_rows(pd.concat(held, ignore_index=True), names, eps)

    rows = df.select(*names, "n", "vs", "rmin", "rmax", "err")
    # within a group summaries come in one order whoever computes them
    return rows.repartition(*names).sortWithinPartitions(*names, "n", "vs", "rmin", "rmax").mapInPandas(run, f"{_key_schema(rows, names)}, {SUMMARY}")


def levels(most: int, group: int = GROUP) -> int:
    """How often `most` summaries of a key must be merged by `group` until one is left."""
    return max(1, math.ceil(math.log(max(most, 1), group) - 1e-9))


def merged(summaries: DataFrame, keys: Sequence[str], eps: float = EPS, group: int = GROUP) -> DataFrame:
    """Summaries put together to one for each value of `keys` (columns of theirs, e.g. without the day).

    The summaries are written to the shared folder and counted; a level deals those of a key by a hash of their content
    to as many groups as hold about `group` each. All levels together add a rank error of eps*n at most, of which each
    (counted as three at least) has an equal share; what has gathered stands in err."""
    names = list(keys)
    level = written(summaries.select(*names, "n", "vs", "rmin", "rmax", "err"))
    most = level.groupBy(*names).agg(F.count(F.lit(1)).alias("k__")).agg(F.max("k__")).first()[0] or 0
    steps = levels(most, group)
    share = eps / max(3, steps)
    content = F.xxhash64("n", F.get("vs", F.lit(0)), F.element_at("vs", -1), F.get("vs", F.floor(F.size("vs") / 2).cast("int")), *names)
    level = level.withColumn("b__", F.pmod(content, F.lit(group ** (steps - 1))))
    for left in range(steps - 1, 0, -1):
        level = _merge_level(level, [*names, "b__"], share).withColumn("b__", F.pmod("b__", F.lit(group ** (left - 1))))
    return _merge_level(level, names, share)


def percentiles(summaries: DataFrame, keys: Sequence[str], ps: Sequence[float]) -> DataFrame:
    """The percentiles `ps` (0 to 1) from summaries: keys, p, n, value, rank_error. `value` is a value of the column
    whose rank differs from ceil(p*n) by rank_error at most."""
    if any(not 0 <= p <= 1 for p in ps):
        raise ValueError("percentiles are given as shares between 0 and 1")
    names, wanted = list(keys), np.asarray(ps, float)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for n, vs, low, high in zip(pdf["n"], pdf["vs"], pdf["rmin"], pdf["rmax"], strict=True):
                rank = np.clip(np.ceil(wanted * n - 1e-9), 1, n)[:, None]
                off = np.maximum(rank - np.asarray(low), np.asarray(high) - rank)
                at = off.argmin(1)
                out.append((np.asarray(vs)[at], off[np.arange(len(at)), at].astype(np.int64)))
            k = len(wanted)
            rows = pdf.loc[pdf.index.repeat(k), [*names, "n"]].reset_index(drop=True)
            yield rows.assign(p=np.tile(wanted, len(pdf)), value=np.concatenate([v for v, _ in out]) if out else [], rank_error=np.concatenate([e for _, e in out]) if out else [])

    rows = summaries.select(*names, "n", "vs", "rmin", "rmax")
    return rows.mapInPandas(run, f"{_key_schema(rows, names)}, n bigint, p double, value double, rank_error bigint")


def grouped_percentiles(df: DataFrame, keys: Sequence[str], value: str, ps: Sequence[float], eps: float = EPS) -> DataFrame:
    """Percentiles per key of all rows, each within eps*n ranks, of which the first summaries take a quarter and their
    merging the rest. A key without a usable value has no rows. Where n is below 8/eps and three levels do, no rank is
    lost."""
    return percentiles(merged(summarise(df, keys, value, eps / 4), keys, eps * 0.75), keys, ps)

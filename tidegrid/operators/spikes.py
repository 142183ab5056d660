"""Implausible spikes, stuck values and impossible readings, per source and relative to its own habits.

Readings are cut into time shards (source, stretch of time) of bounded size: a source's stretches are so long that they
hold about `SHARD_ROWS` readings, and are shortened where they hold many more. A first pass reports for each shard its
outermost points and a histogram of its movements; from these come, per source, the usual movement (the median of
changes that differ from zero) and, by a prefix scan over shards, the points that surround each shard. A second pass
then judges every shard alone by an undecimated Haar wavelet decomposition of the log price: details at scale 1 beyond a
share of the threshold are edges, a pair of opposite edges at most `longest` points apart bounds a stretch, and the
details at scales 4, 2 and 1 of the stretch's points against the points around (stretches left out) are thresholded in
units of the usual movement. Runs of zero detail show sticking, and bounds on the price show impossible readings.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions.clean import freq_micros, micros, name_key, real
from tidegrid.plans.session import written

#: Points of context to each side of a shard: a spike's length, an edge and the coarsest scale to each side fit into it.
CONTEXT = 24
#: Scales (points to each side) of the details that decide, the coarsest first.
SCALES = (4, 2, 1)
#: Share of the threshold from which a detail at scale 1 is an edge.
EDGE = 0.5
SHARD_ROWS = 100_000
#: Width of the histogram's bins of log movements; the usual movement is known within half of that, as a ratio.
BIN = 0.005


def _stretches(x: np.ndarray, least: float, longest: int) -> np.ndarray:
    """Points between two opposite edges (details at scale 1 beyond `least`) at most `longest` points apart; at the ends
    of the series one edge bounds a stretch."""
    n = len(x)
    detail = np.r_[0.0, np.diff(x), 0.0]
    up, down = detail > least, detail < -least
    change = np.zeros(n + 1, np.int64)
    for size in range(1, min(longest, n - 1) + 1):
        begin = np.flatnonzero(up[:-size] & down[size:] | down[:-size] & up[size:])
        begin = begin[(begin > 0) & (begin + size < n)]
        np.add.at(change, begin, 1)
        np.add.at(change, begin + size, -1)
    edges = np.flatnonzero(up | down)
    first, last = edges[edges <= longest], edges[edges >= n - longest]
    if len(first):
        change[0] += 1
        change[first.max()] -= 1
    if len(last):
        change[last.min()] += 1
        change[n] -= 1
    return np.cumsum(change)[:-1] > 0


def _stands_out(x: np.ndarray, at: np.ndarray, clean: np.ndarray, most: float) -> np.ndarray:
    """Whether the points `at` differ by more than `most` from the levels before and after, means of the nearest `clean`
    points (numbers in order). The coarsest scale counts at which the price is back, that is, at which the two levels
    agree within half of `most`; where it is back at none (a lasting move meets the spike), every detail must be large."""
    total = np.r_[0.0, np.cumsum(x[clean])]
    here, beyond = np.searchsorted(clean, at, "left"), np.searchsorted(clean, at, "right")
    told, out, every = np.zeros(len(at), bool), np.zeros(len(at), bool), np.ones(len(at), bool)
    for w in SCALES:
        lo, hi = np.maximum(here - w, 0), np.minimum(beyond + w, len(clean))
        nb, na = here - lo, hi - beyond
        before, after = (total[here] - total[lo]) / np.maximum(nb, 1), (total[hi] - total[beyond]) / np.maximum(na, 1)
        before, after = np.where(nb > 0, before, after), np.where(na > 0, after, before)
        left, right = x[at] - before, x[at] - after
        some = nb + na > 0
        back = some & ~told & (np.abs(after - before) <= most / 2)
        out = np.where(back, np.abs(left + right) / 2 > most, out)
        told |= back
        every &= some & (left * right > 0) & (np.minimum(np.abs(left), np.abs(right)) > most)
    return np.where(told, out, every)


def judge(prices: np.ndarray, usual: float | None, changing: bool, factor: float = 10.0, longest: int = 5, stuck: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spike and stuck marks for consecutive positive prices of one source. usual: its usual movement (log ratio)."""
    n = len(prices)
    spike, same = np.zeros(n, bool), np.zeros(n, bool)
    if n < 3:
        return spike, same
    x = np.log(prices)
    if usual and usual > 0:
        most = factor * usual
        inside = _stretches(x, EDGE * most, longest)
        apart = inside.copy()  # points that don't show the level: all stretches first, then the spikes among them
        while True:
            at = np.flatnonzero(inside & ~spike)
            new = at[_stands_out(x, at, np.flatnonzero(~apart), most)] if len(at) else at
            if not len(new) and (apart == spike).all():
                break
            spike[new] = True
            apart = spike.copy()
    if changing:
        edge = np.r_[0, np.flatnonzero(prices[1:] != prices[:-1]) + 1, n]  # where the detail at scale 1 isn't zero
        size = np.diff(edge)
        same = np.repeat(size >= stuck, size)
    return spike, same


def _points(us: np.ndarray, price: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (time, price) in order, and for each row the number of its point."""
    order = np.lexsort((price, us))
    u, p = us[order], price[order]
    new = np.r_[True, (u[1:] != u[:-1]) | (p[1:] != p[:-1])] if len(u) else np.zeros(0, bool)
    number = np.empty(len(u), np.int64)
    number[order] = np.cumsum(new) - 1
    return u[new], p[new], number


def listed_readings(readings: DataFrame, listings: DataFrame) -> DataFrame:
    """Priced readings inside a listing of their source: sid (the smallest listing_id of the source), us, price, reading_id."""
    spells = listings.select("listing_id", name_key(F.col("commodity_type")).alias("key"), micros(F.col("active_from")).alias("a"), micros(F.col("active_to")).alias("b"))
    spells = spells.where("listing_id is not null and key is not null and a < b")
    sid = spells.groupBy("key").agg(F.min("listing_id").alias("sid"))
    spells = spells.select("key", "a", "b").join(sid, "key")
    price, us = real(F.col("price")), micros(F.col("time"))
    r = readings.select(name_key(F.col("commodity_type")).alias("key"), us.alias("us"), price.alias("price"), F.col("reading_id").cast("bigint").alias("reading_id"))
    r = r.where("key is not null and us is not null and price is not null and reading_id is not null")
    inside = r.join(spells, "key").where((F.col("us") >= F.col("a")) & (F.col("us") < F.col("b")))
    return inside.select("sid", "us", "price", "reading_id")


def _widths(rows: DataFrame, shard_rows: int) -> DataFrame:
    """Per source where its shards begin and how long they are (sid, lo, width): long enough for about `shard_rows`
    readings each; while a shard of a source holds more than twice as many, the source's shards are shortened."""
    per = rows.groupBy("sid").agg(F.min("us").alias("lo"), F.max("us").alias("hi"), F.count(F.lit(1)).alias("n"))
    widths = written(per.select("sid", "lo", F.ceil((F.col("hi") - F.col("lo") + 1) / F.ceil(F.col("n") / shard_rows)).cast("bigint").alias("width")))
    while True:
        sizes = _cut(rows, widths).groupBy("sid", "chunk").agg(F.count(F.lit(1)).alias("size")).groupBy("sid").agg(F.max("size").alias("most"))
        over = written(widths.join(sizes.where(F.col("most") > 2 * shard_rows), "sid").where("width > 1"))
        if over.isEmpty():
            return widths
        parts = F.ceil(F.col("most") / shard_rows)
        shorter = over.select("sid", F.greatest(F.lit(1), F.floor(F.col("width") / parts)).cast("bigint").alias("short"))
        widths = written(widths.join(shorter, "sid", "left").select("sid", "lo", F.coalesce("short", "width").alias("width")))


def _cut(rows: DataFrame, widths: DataFrame) -> DataFrame:
    """`rows` with the number `chunk` of their shard."""
    return rows.join(widths, "sid").select(*rows.columns, F.floor((F.col("us") - F.col("lo")) / F.col("width")).cast("bigint").alias("chunk"))


SURVEY = "sid bigint, chunk bigint, head array<double>, tail array<double>, pairs bigint, bins array<int>, counts array<bigint>"


def _survey(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """First pass over a shard: its outermost points, how many consecutive points it has, a histogram of movements."""
    _, p, _ = _points(pdf["us"].to_numpy(), pdf["price"].to_numpy())
    p = p[p > 0]
    moves = np.abs(np.diff(np.log(p)))
    bins, counts = np.unique(np.floor(np.log(moves[moves > 0]) / BIN).astype(np.int32), return_counts=True)
    return pd.DataFrame({"sid": [key[0]], "chunk": [key[1]], "head": [p[:CONTEXT]], "tail": [p[-CONTEXT:]], "pairs": [len(moves)], "bins": [bins], "counts": [counts]})


def _habits(shards: DataFrame, around: DataFrame) -> DataFrame:
    """Per source (sid) its usual movement, within BIN/2 as a ratio, and whether its price usually changes."""
    inner = shards.select("sid", "pairs", F.arrays_zip("bins", "counts").alias("z"))
    bins = inner.select("sid", F.explode("z").alias("z")).select("sid", "z.bins", "z.counts")
    # the movement from the last point of the shards before to the first of this one
    step = F.abs(F.log(F.get("head", F.lit(0)) / F.element_at("before", -1)))
    between = around.where("size(before) > 0").select("sid", step.alias("step"))
    bins = bins.unionByName(between.where("step > 0").select("sid", F.floor(F.log("step") / BIN).cast("int").alias("bins"), F.lit(1).cast("bigint").alias("counts")))
    bins = bins.groupBy("sid", "bins").agg(F.sum("counts").alias("k"))
    whole = Window.partitionBy("sid")
    upto = F.sum("k").over(whole.orderBy("bins"))
    ranked = bins.select("sid", "bins", upto.alias("upto"), F.sum("k").over(whole).alias("moves"))
    middle = ranked.where("2 * upto >= moves").groupBy("sid").agg(F.exp((F.min("bins") + 0.5) * BIN).alias("usual"), F.max("moves").alias("moves"))
    pairs = shards.select("sid", "pairs").unionByName(between.select("sid", F.lit(1).cast("bigint").alias("pairs")))
    pairs = pairs.groupBy("sid").agg(F.sum("pairs").alias("pairs"))
    return middle.join(pairs, "sid").select("sid", "usual", (F.col("moves") > 0.5 * F.col("pairs")).alias("changing"))


def spike_readings(readings: DataFrame, listings: DataFrame, factor: float = 10.0, longest: int = 5, stuck: int = 12, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Implausible readings: reading_id, reason (`impossible`, `spike` or `stuck`, the first that holds), distinct.

    Only readings with an id, a price and a time inside a listing of their source count; equal (time, price) of a source
    are one point of it, however many feeds or redeliveries brought it, and all their reading_ids come out.
    impossible: the price is zero or less. spike: between opposite edges at most `longest` consecutive points apart, a
    point whose details against the levels before and after exceed `factor` times the usual movement (see `judge`).
    stuck: a run of `stuck` or more consecutive points of one price, in a source where more than half of the consecutive
    points differ. Points at one time come in order of price. A source without any change of price has no spikes.
    Impossible prices take no part in the sequence of the others. Empty tables give no rows; extra columns are ignored.
    No task holds more than about 2 * `shard_rows` readings, but for readings of a source at one microsecond.
    """
    if longest > 5 or stuck > CONTEXT - 1:
        raise ValueError(f"longest may be 5 and stuck {CONTEXT - 1} at most")
    rows = written(listed_readings(readings, listings))  # both passes and the widths of shards read it
    rows = _cut(rows, _widths(rows, shard_rows))
    shards = written(rows.groupBy("sid", "chunk").applyInPandas(_survey, SURVEY))
    along = Window.partitionBy("sid").orderBy("chunk")
    # CONTEXT shards to each side have CONTEXT points at least, as every shard has one; shards without are skipped
    told = shards.where(F.size("head") > 0).select("sid", "chunk", "head", "tail")
    before = F.flatten(F.collect_list("tail").over(along.rowsBetween(-CONTEXT, -1)))
    after = F.flatten(F.collect_list("head").over(along.rowsBetween(1, CONTEXT)))
    around = told.select("sid", "chunk", "head", before.alias("before"), F.slice(after, 1, CONTEXT).alias("after"))
    around = around.withColumn("before", F.slice("before", F.greatest(F.lit(1), F.size("before") - CONTEXT + 1), CONTEXT))
    state = around.drop("head").join(_habits(shards, around), "sid", "left")

    def decide(key: tuple, own: pd.DataFrame, carried: pd.DataFrame) -> pd.DataFrame:
        if not len(own):
            return pd.DataFrame({"reading_id": [], "reason": []})
        us, p, number = _points(own["us"].to_numpy(), own["price"].to_numpy())
        good = np.flatnonzero(p > 0)
        reason = np.where(p > 0, "", "impossible").astype(object)
        if len(good) and len(carried):
            c = carried.iloc[0]
            lead, trail = np.asarray(c["before"], float), np.asarray(c["after"], float)
            whole = np.r_[lead, p[good], trail]
            spike, same = judge(whole, None if pd.isna(c["usual"]) else float(c["usual"]), c["changing"] is not None and bool(c["changing"]), factor, longest, stuck)
            mine = slice(len(lead), len(lead) + len(good))
            reason[good[same[mine]]] = "stuck"
            reason[good[spike[mine]]] = "spike"
        said = reason[number]
        hit = said != ""
        return pd.DataFrame({"reading_id": own["reading_id"].to_numpy()[hit], "reason": said[hit]})

    found = rows.groupBy("sid", "chunk").cogroup(state.groupBy("sid", "chunk")).applyInPandas(decide, "reading_id bigint, reason string")
    return found.groupBy("reading_id").agg(F.min("reason").alias("reason"))

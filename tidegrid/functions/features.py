"""Per-series features as Catalyst aggregates after one shared window projection.

A feature is a function of a `Prep`; it asks the Prep for the window columns it needs (position, neighbours, run
numbers, means ...) and returns an aggregate. `extract` computes any number of features in one plan with a single
exchange on the entity: window columns asked for twice are computed once, and windows over (entity, something) keep to
the partitioning by entity. Features that need no order are spared that: figures of a whole series come from partial
aggregates that are joined back, and counts of equal values from windows over (entity, value), so that an entity with a
large share of all rows is shared by many tasks.

Contract: rows whose value is null or NaN are left out; order is by time, then value. An entity without any row left
has no result. What a feature gives for too short or constant series is stated by the feature.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions.numbers import NAN, correlation, fdiv, plogp
from tidegrid.plans.session import written

Feature = Callable[["Prep"], Column]


class Prep:
    """Window columns of one extraction, by level: a level's columns may use those of the levels before."""

    def __init__(self) -> None:
        self.levels: list[dict[str, Column]] = []
        self.totals: dict[str, Column] = {}
        self.v, self.t, self.e = F.col("v__"), F.col("t__"), F.col("e__")
        self.by_entity = Window.partitionBy("e__")
        self.along = self.by_entity.orderBy("t__", "v__")

    def put(self, level: int, name: str, column: Column) -> Column:
        while len(self.levels) <= level:
            self.levels.append({})
        self.levels[level].setdefault(name, column)
        return F.col(name)

    @property
    def i(self) -> Column:
        return self.put(0, "i__", (F.row_number().over(self.along) - 1).cast("bigint"))

    @property
    def n(self) -> Column:
        return self.whole("n", F.count(F.lit(1)))

    def lag(self, k: int) -> Column:
        return self.put(0, f"lag{k}__", F.lag("v__", k).over(self.along)) if k else self.v

    def lead(self, k: int) -> Column:
        return self.put(0, f"lead{k}__", F.lead("v__", k).over(self.along)) if k else self.v

    @property
    def change(self) -> Column:
        return self.v - self.lag(1)

    def whole(self, name: str, aggregate: Column) -> Column:
        """A figure of the whole series, beside each of its rows."""
        self.totals.setdefault(f"{name}__", aggregate)
        return F.col(f"{name}__")

    @property
    def mean(self) -> Column:
        return self.whole("mean", F.avg("v__"))

    @property
    def low(self) -> Column:
        return self.whole("low", F.min("v__"))

    @property
    def high(self) -> Column:
        return self.whole("high", F.max("v__"))

    def quantile(self, q: float) -> Column:
        return self.whole(f"q{q}".replace(".", "_"), F.percentile("v__", q))

    @property
    def copies(self) -> Column:
        """How often the row's value occurs in its series."""
        return self.put(0, "copies__", F.count(F.lit(1)).over(Window.partitionBy("e__", "v__")))

    #: Columns that need no order in time: windows over (entity, value), and what a row's own value shows.
    BY_VALUE = frozenset(("copies__", "copy__", "digit__"))

    @property
    def first_copy(self) -> Column:
        return self.put(0, "copy__", F.row_number().over(Window.partitionBy("e__", "v__").orderBy("t__"))) == 1

    def run(self, name: str, flag: Column) -> tuple[Column, Column]:
        """(flag holds, length of its run) for the last row of each run of equal flags; the flag may use level 0."""
        self.i  # noqa: B018
        f = self.put(1, f"{name}_f__", F.coalesce(flag, F.lit(False)))
        new = self.put(2, f"{name}_b__", (f != F.coalesce(F.lag(f"{name}_f__").over(self.along), ~f)).cast("int"))
        number = self.put(3, f"{name}_r__", F.sum(new).over(self.along.rowsBetween(Window.unboundedPreceding, 0)))
        size = self.put(4, f"{name}_n__", F.count(F.lit(1)).over(Window.partitionBy("e__", f"{name}_r__")))
        last = self.put(4, f"{name}_l__", F.coalesce(F.lead(f"{name}_r__").over(self.along) != number, F.lit(True)))
        return f & last, size


def _in_shards(rows: DataFrame, names: list[str], shard_rows: int) -> DataFrame:
    """`rows` with the columns i__, mass__, lag{k}__, lead{k}__ among `names`, computed in shards of an entity's rows.

    Shards are ranges of (entity, time, value) of about `shard_rows` rows. Each has a summary of its number of rows, its
    mass and its outermost values; a prefix scan over an entity's summaries gives every shard what lies before it and the
    values beside it, and with them each shard's windows are computed on its own."""
    lags, leads = ([int(n[len(kind) : -2]) for n in names if n.startswith(kind)] for kind in ("lag", "lead"))
    reach = max([0, *lags, *leads])
    rows = written(rows)
    parts = max(1, -(-rows.count() // shard_rows))
    rows = written(rows.repartitionByRange(parts, "e__", "t__", "v__").withColumn("s__", F.spark_partition_id()))
    shard = Window.partitionBy("e__", "s__")
    along = shard.orderBy("t__", "v__")
    local = rows.select("*", (F.row_number().over(along) - 1).cast("bigint").alias("li__"), F.count(F.lit(1)).over(shard).alias("ln__"))
    outer = lambda which: F.transform(F.array_sort(F.collect_list(F.when(which, F.struct("li__", "v__")))), lambda x: x["v__"])
    ends = local.groupBy("e__", "s__").agg(
        F.count(F.lit(1)).alias("k__"), F.sum(F.abs("v__")).alias("a__"), outer(F.col("li__") < reach).alias("head__"), outer(F.col("li__") >= F.col("ln__") - reach).alias("tail__")
    )
    scan = Window.partitionBy("e__").orderBy("s__")
    before, near = scan.rowsBetween(Window.unboundedPreceding, -1), max(reach, 1)
    state = ends.select(
        F.col("e__").alias("of__"), F.col("s__").alias("at__"), F.coalesce(F.sum("k__").over(before), F.lit(0)).alias("rows__"), F.coalesce(F.sum("a__").over(before), F.lit(0.0)).alias("sum__"),
        F.flatten(F.collect_list("tail__").over(scan.rowsBetween(-near, -1))).alias("left__"), F.flatten(F.collect_list("head__").over(scan.rowsBetween(1, near))).alias("right__"),
    )
    along = shard.orderBy("li__")  # equal rows keep the places they have been given
    joined = local.join(state, F.col("e__").eqNullSafe(F.col("of__")) & (F.col("s__") == F.col("at__")))
    given = {"i__": F.col("rows__") + F.col("li__"), "mass__": F.col("sum__") + F.sum(F.abs("v__")).over(along.rowsBetween(Window.unboundedPreceding, 0))}
    for k in lags:
        given[f"lag{k}__"] = F.when(F.col("li__") >= k, F.lag("v__", k).over(along)).otherwise(F.get("left__", (F.size("left__") - k + F.col("li__")).cast("int")))
    for k in leads:
        given[f"lead{k}__"] = F.when(F.col("li__") + k < F.col("ln__"), F.lead("v__", k).over(along)).otherwise(F.get("right__", (F.col("li__") + k - F.col("ln__")).cast("int")))
    return joined.select("e__", "t__", "v__", *[given[n].alias(n) for n in names])


def extract(df: DataFrame, entity: str, time: str, value: str, features: dict[str, Feature], shard_rows: int | None = None) -> DataFrame:
    """One row per entity: the entity, then a column for each feature.

    With `shard_rows` features in order of time, too, share an entity's rows among tasks, in shards of about so many
    rows, with the same results; ValueError for those that need runs or patterns of a whole series (streaks, entropies,
    mean_n_absolute_max)."""
    prep = Prep()
    aggregates = [f(prep).alias(name) for name, f in features.items()]
    rows = df.select(F.col(entity).alias("e__"), F.col(time).alias("t__"), F.col(value).cast("double").alias("v__")).where("v__ is not null and not isnan(v__)")
    plain = rows
    placed = [name for level in prep.levels for name in level if name not in Prep.BY_VALUE]
    if placed and shard_rows is not None:
        if whole := [n for n in placed if not re.fullmatch(r"i__|mass__|(lag|lead)\d+__", n)]:
            raise ValueError(f"these can't be computed in shards: {', '.join(sorted(whole))}")
        rows = _in_shards(rows, placed, shard_rows)
        prep.levels = [{n: c for n, c in level.items() if n in Prep.BY_VALUE} for level in prep.levels]
        placed = []
    if placed:
        rows = rows.repartition("e__")  # one exchange; every window below and the aggregate keep to it
        if prep.totals:
            rows = rows.select("*", *[c.over(prep.by_entity).alias(n) for n, c in prep.totals.items()])
    elif prep.totals:
        totals = plain.groupBy(F.col("e__").alias("of__")).agg(*[c.alias(n) for n, c in prep.totals.items()])
        rows = rows.join(totals, F.col("e__").eqNullSafe(F.col("of__"))).drop("of__")
    for level in prep.levels:
        rows = rows.select("*", *[c.alias(n) for n, c in level.items()])
    return rows.groupBy("e__").agg(*aggregates).withColumnRenamed("e__", entity)


def tumbling(df: DataFrame, entity: str, time: str, value: str, every: str, features: dict[str, Feature]) -> DataFrame:
    """Features of each entity and time window of fixed length `every` (as '7 days'): entity, window_start, features."""
    key = F.struct(F.col(entity).alias("entity"), F.window(F.col(time).cast("timestamp"), every)["start"].alias("start"))
    out = extract(df.withColumn("k__", key), "k__", time, value, features)
    return out.select(F.col("k__.entity").alias(entity), F.col("k__.start").cast("timestamp_ntz").alias("window_start"), *features)


# -- sums and moments ---------------------------------------------------------------------------------------------


def absolute_energy() -> Feature:
    """Sum of squares."""
    return lambda p: F.sum(p.v * p.v)


def absolute_maximum() -> Feature:
    return lambda p: F.max(F.abs(p.v))


def absolute_sum_of_changes() -> Feature:
    """0 for a single value."""
    return lambda p: F.coalesce(F.sum(F.abs(p.change)), F.lit(0.0))


def root_mean_square() -> Feature:
    return lambda p: F.sqrt(F.avg(p.v * p.v))


def harmonic_mean() -> Feature:
    """n over the sum of reciprocals; a zero value makes it 0."""
    return lambda p: fdiv(F.count(p.v), F.sum(fdiv(F.lit(1.0), p.v)))


def variation_coefficient() -> Feature:
    """Population standard deviation over mean; infinite or NaN for mean 0."""
    return lambda p: fdiv(F.stddev_pop(p.v), F.avg(p.v))


def var_gt_std(ddof: int = 1) -> Feature:
    """Whether the variance reaches its root, that is, 1."""
    return lambda p: (F.var_samp(p.v) if ddof else F.var_pop(p.v)) >= 1


def large_standard_deviation(ratio: float = 0.25) -> Feature:
    return lambda p: F.stddev_samp(p.v) > ratio * (F.max(p.v) - F.min(p.v))


def range_over_mean() -> Feature:
    return lambda p: fdiv(F.max(p.v) - F.min(p.v), F.avg(p.v))


def range_change(percentage: bool = True) -> Feature:
    return lambda p: fdiv(F.max(p.v), F.min(p.v)) - 1 if percentage else F.max(p.v) - F.min(p.v)


def symmetry_looking(ratio: float = 0.25) -> Feature:
    return lambda p: F.abs(F.avg(p.v) - F.percentile(p.v, 0.5)) < ratio * (F.max(p.v) - F.min(p.v))


def ratio_beyond_r_sigma(ratio: float = 0.25) -> Feature:
    """Share of values further from the mean than ratio population standard deviations."""
    return lambda p: F.avg((F.abs(p.v - p.mean) > ratio * p.whole("sd0", F.stddev_pop("v__"))).cast("double"))


def mean_n_absolute_max(n_maxima: int) -> Feature:
    if n_maxima < 1:
        raise ValueError("n_maxima must be positive")

    def build(p: Prep) -> Column:
        rank = p.put(0, "absrank__", F.row_number().over(p.by_entity.orderBy(F.abs(F.col("v__")).desc())))
        return F.avg(F.when(rank <= n_maxima, F.abs(p.v)))

    return build


# -- changes and neighbours ---------------------------------------------------------------------------------------


def mean_abs_change() -> Feature:
    return lambda p: F.avg(F.abs(p.change))


def max_abs_change() -> Feature:
    return lambda p: F.max(F.abs(p.change))


def mean_change() -> Feature:
    """(last - first) / (n - 1), 0 for a single value."""
    return lambda p: F.when(F.count(p.v) > 1, (F.max_by(p.v, p.i) - F.min_by(p.v, p.i)) / F.greatest(F.count(p.v) - 1, F.lit(1))).otherwise(0.0)


def mean_second_derivative_central() -> Feature:
    """NaN for fewer than three values."""

    def build(p: Prep) -> Column:
        at = lambda k: F.max(F.when(p.i == k, p.v))
        n = F.count(p.v)
        return F.when(n >= 3, (at(p.n - 1) - at(p.n - 2) - at(F.lit(1)) + at(F.lit(0))) / (2 * F.greatest(n - 2, F.lit(1)))).otherwise(F.lit(NAN))

    return build


def cid_ce(normalize: bool = False) -> Feature:
    """Root of the sum of squared changes; normalised by the population standard deviation (NaN for a constant)."""

    def build(p: Prep) -> Column:
        size = F.sqrt(F.coalesce(F.sum(p.change * p.change), F.lit(0.0)))
        return fdiv(size, F.stddev_pop(p.v)) if normalize else size

    return build


def c3(n_lags: int) -> Feature:
    """NaN where the series is no longer than 2 * n_lags."""
    return lambda p: F.coalesce(F.avg(p.v * p.lag(n_lags) * p.lag(2 * n_lags)), F.lit(NAN))


def time_reversal_asymmetry_statistic(n_lags: int) -> Feature:
    return lambda p: F.coalesce(F.avg(p.lead(n_lags) * (p.lead(2 * n_lags) + p.v) * (p.lead(2 * n_lags) - p.v)), F.lit(NAN))


def autocorrelation(n_lags: int) -> Feature:
    """Mean product of deviations n_lags apart over the population variance; 1 for lag 0, NaN for a constant."""
    if n_lags == 0:
        return lambda p: F.max(F.lit(1.0))

    def build(p: Prep) -> Column:
        return fdiv(F.avg((p.v - p.mean) * (p.lag(n_lags) - p.mean)), F.var_pop(p.v))

    return build


def change_quantiles(q_low: float, q_high: float, is_abs: bool = True) -> Feature:
    """The changes, in order, whose both ends lie between the two quantiles; null if q_high <= q_low."""

    def build(p: Prep) -> Column:
        if q_high <= q_low:
            return F.max(F.lit(None).cast("array<double>"))
        lo, hi = p.quantile(q_low), p.quantile(q_high)
        d = F.abs(p.change) if is_abs else p.change
        inside = p.v.between(lo, hi) & p.lag(1).between(lo, hi)
        kept = F.array_sort(F.collect_list(F.when(inside, F.struct(p.i.alias("i"), d.alias("d")))))
        return F.transform(kept, lambda s: s["d"])

    return build


def number_crossings(crossing_value: float = 0.0) -> Feature:
    return lambda p: F.count_if((p.v > crossing_value) != (p.lag(1) > crossing_value))


def number_peaks(support: int) -> Feature:
    """Values greater than all `support` neighbours on either side, which must exist."""

    def build(p: Prep) -> Column:
        higher = F.lit(True)
        for k in range(1, support + 1):
            higher = higher & F.coalesce(p.v > p.lag(k), F.lit(False)) & F.coalesce(p.v > p.lead(k), F.lit(False))
        return F.count_if(higher)

    return build


# -- counts and positions -----------------------------------------------------------------------------------------


def count_above(threshold: float = 0.0) -> Feature:
    """Percentage of values at or above."""
    return lambda p: 100 * F.avg((p.v >= threshold).cast("double"))


def count_below(threshold: float = 0.0) -> Feature:
    """Percentage of values at or below."""
    return lambda p: 100 * F.avg((p.v <= threshold).cast("double"))


def count_above_mean() -> Feature:
    return lambda p: F.count_if(p.v > p.mean)


def count_below_mean() -> Feature:
    return lambda p: F.count_if(p.v < p.mean)


def range_count(lower: float, upper: float, closed: str = "left") -> Feature:
    """Values between the bounds, of which `closed` (left, right, both, none) belong to it."""
    if closed not in ("left", "right", "both", "none"):
        raise ValueError(f"closed is left, right, both or none, not {closed!r}")

    def build(p: Prep) -> Column:
        above = p.v >= lower if closed in ("left", "both") else p.v > lower
        below = p.v <= upper if closed in ("right", "both") else p.v < upper
        return F.count_if(above & below)

    return build


def first_location_of_maximum() -> Feature:
    return lambda p: F.min_by(p.i, F.struct(-p.v, p.i)) / F.count(p.v)


def first_location_of_minimum() -> Feature:
    return lambda p: F.min_by(p.i, F.struct(p.v, p.i)) / F.count(p.v)


def last_location_of_maximum() -> Feature:
    return lambda p: (F.max_by(p.i, F.struct(p.v, p.i)) + 1) / F.count(p.v)


def last_location_of_minimum() -> Feature:
    return lambda p: (F.max_by(p.i, F.struct(-p.v, p.i)) + 1) / F.count(p.v)


def index_mass_quantile(q: float) -> Feature:
    """Relative position up to which a share q of the absolute mass lies."""

    def build(p: Prep) -> Column:
        cumulated = p.put(0, "mass__", F.sum(F.abs(F.col("v__"))).over(p.along.rowsBetween(Window.unboundedPreceding, 0)))
        total = p.whole("mass_all", F.sum(F.abs(F.col("v__"))))
        return (F.min(F.when(cumulated >= q * total, p.i)) + 1) / F.count(p.v)

    return build


def linear_trend() -> Feature:
    """Struct slope, intercept, rss of the least squares line over the index; NaN for a single value."""

    def build(p: Prep) -> Column:
        some = F.count(p.v) > 1
        slope = F.regr_slope(p.v, p.i)
        rss = F.greatest(F.regr_syy(p.v, p.i) - slope * F.regr_sxy(p.v, p.i), F.lit(0.0))
        out = lambda c: F.when(some, c).otherwise(F.lit(NAN))
        return F.struct(out(slope).alias("slope"), out(F.regr_intercept(p.v, p.i)).alias("intercept"), out(rss).alias("rss"))

    return build


# -- values that recur --------------------------------------------------------------------------------------------


def has_duplicate() -> Feature:
    return lambda p: F.max(p.copies) > 1


def has_duplicate_max() -> Feature:
    return lambda p: F.count_if(p.v == p.high) > 1


def has_duplicate_min() -> Feature:
    return lambda p: F.count_if(p.v == p.low) > 1


def ratio_n_unique_to_length() -> Feature:
    return lambda p: F.count_if(p.first_copy) / F.count(p.v)


def percent_reoccurring_points() -> Feature:
    """Share of points whose value occurs more than once."""
    return lambda p: F.avg((p.copies > 1).cast("double"))


def percent_reoccurring_values() -> Feature:
    """Share of distinct values that occur more than once."""
    return lambda p: F.avg(F.when(p.first_copy, (p.copies > 1).cast("double")))


def sum_reoccurring_points() -> Feature:
    return lambda p: F.coalesce(F.sum(F.when(p.copies > 1, p.v)), F.lit(0.0))


def sum_reoccurring_values() -> Feature:
    return lambda p: F.coalesce(F.sum(F.when(p.first_copy & (p.copies > 1), p.v)), F.lit(0.0))


def benford_correlation() -> Feature:
    """Correlation of the counts of leading digits 1..9 (zeros left out) with log10(1 + 1/d); NaN for equal counts."""

    def build(p: Prep) -> Column:
        digit = p.put(0, "digit__", F.when(F.col("v__") != 0, F.regexp_extract(F.abs(F.col("v__")).cast("string"), "[1-9]", 0)))
        counts = [F.count_if(digit == str(d)).cast("double") for d in range(1, 10)]
        want = [math.log10(1 + 1 / d) for d in range(1, 10)]
        total = lambda cs: sum(cs[1:], cs[0])
        return correlation(F.lit(9.0), total(counts), F.lit(sum(want)), total([c * c for c in counts]), F.lit(sum(w * w for w in want)), total([c * w for c, w in zip(counts, want, strict=True)]))

    return build


# -- entropies ----------------------------------------------------------------------------------------------------


def _entropy(p: Prep, name: str, level: int, key: str, among: Column | None = None) -> Column:
    """Shannon entropy (nats) of the column `key` of level - 1 within a series; `among`: rows that count."""
    ok = F.lit(True) if among is None else among
    size = p.put(level, f"{name}_k__", F.sum(ok.cast("bigint")).over(Window.partitionBy("e__", key)))
    lead = p.put(level, f"{name}_o__", F.row_number().over(Window.partitionBy("e__", key).orderBy("t__", "v__")))
    total = p.put(level, f"{name}_t__", F.sum(ok.cast("bigint")).over(p.by_entity))
    return F.sum(F.when((lead == 1) & (size > 0), plogp(size / total)).otherwise(0.0))


def binned_entropy(bin_count: int = 10) -> Feature:
    """Entropy over `bin_count` bins of equal width; the maximum lies in the last bin. 0 for a constant."""

    def build(p: Prep) -> Column:
        place = F.floor(fdiv((p.v - p.low) * bin_count, p.high - p.low))
        key = F.when(p.high > p.low, F.least(place, F.lit(bin_count - 1))).otherwise(0).cast("bigint")
        p.put(1, f"bin{bin_count}__", key)
        return _entropy(p, f"bin{bin_count}", 2, f"bin{bin_count}__")

    return build


def permutation_entropy(tau: int = 1, n_dims: int = 3, base: float = math.e) -> Feature:
    """Entropy of the orders of n_dims neighbouring values, patterns starting at every tau-th value."""

    def build(p: Prep) -> Column:
        values = F.array(*[F.struct(p.lead(k).alias("x"), F.lit(k).alias("k")) for k in range(n_dims)])
        pattern = F.concat_ws(",", F.transform(F.array_sort(values), lambda s: s["k"].cast("string")))
        name = f"order{tau}_{n_dims}"
        counts = (p.i <= p.n - n_dims) & (p.i % tau == 0)
        ok = p.put(1, f"{name}_ok__", counts)
        p.put(1, f"{name}__", F.when(counts, pattern))
        return _entropy(p, name, 2, f"{name}__", ok) / math.log(base)

    return build


def energy_ratios(n_chunks: int = 10) -> Feature:
    """Shares of the energy in n_chunks chunks of equal length (the series padded with zeros)."""

    def build(p: Prep) -> Column:
        width = F.ceil(p.n / n_chunks)
        total = F.sum(p.v * p.v)
        return F.array(*[fdiv(F.coalesce(F.sum(F.when(F.floor(p.i / width) == k, p.v * p.v)), F.lit(0.0)), total) for k in range(n_chunks)])

    return build


# -- streaks ------------------------------------------------------------------------------------------------------


def _longest(name: str, flag: Callable[[Prep], Column]) -> Feature:
    def build(p: Prep) -> Column:
        last, size = p.run(name, flag(p))
        return F.coalesce(F.max(F.when(last, size)), F.lit(0)).cast("bigint")

    return build


def longest_streak_above_mean() -> Feature:
    return _longest("above_mean", lambda p: p.v > p.mean)


def longest_streak_below_mean() -> Feature:
    return _longest("below_mean", lambda p: p.v < p.mean)


def longest_streak_above(threshold: float) -> Feature:
    """Longest run of changes at or above the threshold."""
    return _longest(f"up{threshold}".replace(".", "_").replace("-", "m"), lambda p: p.change >= threshold)


def longest_streak_below(threshold: float) -> Feature:
    return _longest(f"down{threshold}".replace(".", "_").replace("-", "m"), lambda p: p.change <= threshold)


def longest_winning_streak() -> Feature:
    return longest_streak_above(0.0)


def longest_losing_streak() -> Feature:
    return longest_streak_below(0.0)


def streak_length_stats(above: bool, threshold: float) -> Feature:
    """Struct min, max, mean, std, p10, median, p90, mode of the lengths of runs of changes at or above (or below) the
    threshold; min is 0 and the others null where there is none. p10 and p90 are values that occur (nearest rank)."""

    def build(p: Prep) -> Column:
        name = f"{'up' if above else 'down'}{threshold}".replace(".", "_").replace("-", "m")
        last, size = p.run(name, p.change >= threshold if above else p.change <= threshold)
        x = F.when(last, size.cast("double"))
        order = F.array_sort(F.collect_list(x))
        at = lambda q: F.get(order, F.round((F.size(order) - 1) * F.lit(q)).cast("int"))
        return F.struct(
            F.coalesce(F.min(x), F.lit(0.0)).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), at(0.1).alias("p10"), F.percentile(x, 0.5).alias("median"), at(0.9).alias("p90"), F.mode(x, True).alias("mode")
        )

    return build


# -- series in, series out ----------------------------------------------------------------------------------------


def detrended(df: DataFrame, entity: str, time: str, value: str, method: str = "linear") -> DataFrame:
    """The panel with value less its line over the index (`linear`) or its mean (`mean`)."""
    if method not in ("linear", "mean"):
        raise ValueError(f"method is linear or mean, not {method!r}")
    e, w = Window.partitionBy(entity), Window.partitionBy(entity).orderBy(time)
    if method == "mean":
        return df.withColumn(value, F.col(value) - F.avg(value).over(e))
    rows = df.withColumn("i__", F.row_number().over(w) - 1)
    line = F.regr_intercept(value, "i__").over(e) + F.coalesce(F.regr_slope(value, "i__").over(e), F.lit(0.0)) * F.col("i__")
    return rows.withColumn(value, F.col(value) - line).drop("i__")


def fractional_weights(d: float, min_weight: float | None = None, window_size: int | None = None) -> list[float]:
    """Weights of (1 - B)^d, down to those below min_weight, or window_size of them. ValueError if min_weight asks for
    more than 10,000, as each is a column of its own."""
    if (min_weight is None) == (window_size is None):
        raise ValueError("give min_weight or window_size, not both")
    weights = [1.0]
    while window_size is None or len(weights) < window_size:
        if window_size is None and len(weights) >= 10_000:
            raise ValueError(f"more than 10,000 weights are at least {min_weight}: give window_size")
        nxt = -weights[-1] * (d - len(weights) + 1) / len(weights)
        if min_weight is not None and abs(nxt) < min_weight:
            break
        weights.append(nxt)
    return weights


def fractional_difference(df: DataFrame, entity: str, time: str, value: str, d: float, min_weight: float | None = None, window_size: int | None = None) -> DataFrame:
    """Fractional differencing of fixed width; the first values, which lack neighbours, are null."""
    w = Window.partitionBy(entity).orderBy(time)
    weights = fractional_weights(d, min_weight, window_size)
    total = F.col(value) * weights[0]
    for k, x in enumerate(weights[1:], 1):
        total = total + F.lag(value, k).over(w) * x
    return df.withColumn(value, total)

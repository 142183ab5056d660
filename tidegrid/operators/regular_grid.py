"""Irregular readings onto a regular grid.

Each spell (one listing of a source: its grid runs from `start` to before `end` in steps of `step`) is cut
into time shards of `shard_periods` periods. Readings are reduced to one value a period before anything is
shuffled by shard. Every shard then has a summary of two entries, its first and its last reading; a prefix
scan over these summaries gives each shard the states carried in from before and from after it, and with
them every shard is filled on its own: no task sees more than one shard, however long or busy a source is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions.clean import freq_micros, from_micros, micros, name_key, real
from tidegrid.plans.session import written

SHARD_PERIODS = 2048


def spells_of(listings: DataFrame) -> DataFrame:
    """`listings` (listing_id, commodity_type, freq, active_from, active_to) as spells: spell, series, key, step, lo, hi.

    lo and hi count periods since 1970: the first and the last period that begins inside the spell.
    Spells without a usable name, frequency or bounds, or without any period, are left out."""
    us = listings.select("listing_id", "commodity_type", freq_micros(F.col("freq")).alias("step"), micros(F.col("active_from")).alias("a"), micros(F.col("active_to")).alias("b"))
    step = F.col("step")
    lo, hi = F.ceil(F.col("a") / step).cast("bigint"), (F.ceil(F.col("b") / step) - 1).cast("bigint")
    # aggregating keeps the parsed frequency from being written out again in every expression that uses it
    one = us.groupBy("listing_id", "commodity_type").agg(F.max("step").alias("step"), F.min(lo).alias("lo"), F.max(hi).alias("hi"))
    spells = one.select(F.col("listing_id").alias("spell"), F.col("commodity_type").alias("series"), name_key(F.col("commodity_type")).alias("key"), "step", "lo", "hi")
    return spells.where("spell is not null and key is not null and lo <= hi")


def _at_periods(readings: DataFrame, spells: DataFrame) -> DataFrame:
    """Priced readings with their spell and period. Readings in no spell's period fall away."""
    r = readings.select(name_key(F.col("commodity_type")).alias("key"), micros(F.col("time")).alias("us"), real(F.col("price")).alias("price"), F.col("reading_id").cast("bigint").alias("reading_id"))
    r = r.where(F.col("key").isNotNull() & F.col("us").isNotNull() & F.col("price").isNotNull())
    period = ((F.col("us") - F.pmod(F.col("us"), F.col("step"))) / F.col("step")).cast("bigint")
    joined = r.join(spells.select("key", "spell", "step", "lo", "hi"), "key").withColumn("period", period)
    return joined.where((F.col("period") >= F.col("lo")) & (F.col("period") <= F.col("hi")))


def grid(readings: DataFrame, listings: DataFrame, shard_periods: int = SHARD_PERIODS, counted: bool = True) -> DataFrame:
    """One row per period of every listing.

    Columns: listing_id, commodity_type (as registered), period_start, price, n_readings, is_missing, filled_price
    (the last price before, or the next one where there is none before), prev_price, next_price, periods_since (periods
    since the last one with a price; null before the first), interpolated_price (linear between the two neighbours,
    null where one is lacking).

    A period's price is that of its latest reading (ties: the higher reading_id, then the higher price). Null, NaN and
    infinite prices are no price; a null name or time matches nothing. Redelivered and repeated rows, and copies of a
    quote through another feed, change nothing: n_readings counts different (time, price). Without `counted` it may
    count copies, and a shuffle is spared.
    An empty reading table gives a grid of missing periods; no listings give no rows. Carries never cross from one
    listing to the next. Extra columns of either table are ignored.
    """
    if shard_periods < 1:
        raise ValueError("shard_periods must be positive")
    spells = spells_of(listings)
    shard = lambda period: F.floor(period / F.lit(shard_periods)).cast("bigint")
    # every shard gets a row at its first period, so that shards without readings exist and leading gaps have a start
    first = F.explode(F.sequence(shard(F.col("lo")), shard(F.col("hi"))))
    shards = spells.select("spell", "series", "step", "lo", "hi", first.alias("shard"))
    shards = shards.select("spell", "series", "step", "shard", F.greatest("lo", F.col("shard") * shard_periods).alias("from"), F.least("hi", (F.col("shard") + 1) * shard_periods - 1).alias("to"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("us", "bigint"), ("reading_id", "bigint"), ("price", "double"))]
    starts = shards.select("spell", "shard", F.col("from").alias("period"), *none)
    given = _at_periods(readings, spells).select("spell", shard(F.col("period")).alias("shard"), "period", "us", "reading_id", "price")
    if counted:
        given = given.groupBy("spell", "shard", "period", "us", "price").agg(F.max("reading_id").alias("reading_id")).select(*given.columns)
    best = F.max(F.when(F.col("price").isNotNull(), F.struct("us", "reading_id", "price")))
    rows = given.unionByName(starts).groupBy("spell", "shard", "period").agg(best.alias("best"), F.count("price").alias("n"))
    # the summaries and the filling both read these rows: written once, they aren't computed twice
    rows = written(rows.select("spell", "shard", "period", F.col("best.price").alias("price"), "n"))
    seen = F.when(F.col("price").isNotNull(), F.struct("period", "price"))
    at = F.when(F.col("price").isNotNull(), F.col("period"))
    ends = rows.groupBy("spell", "shard").agg(F.min(at).alias("a"), F.min_by("price", at).alias("x"), F.max(at).alias("b"), F.max_by("price", at).alias("y"))
    end = lambda p, v: F.when(F.col(p).isNotNull(), F.struct(F.col(p).alias("period"), F.col(v).alias("price")))
    carry = _carried(ends.select("spell", "shard", end("a", "x").alias("head"), end("b", "y").alias("tail")))
    bounds = shards.join(carry, ["spell", "shard"])
    inside = Window.partitionBy("spell", "shard").orderBy("period")
    rows = rows.select("spell", "shard", "period", "price", "n", F.lead("period").over(inside).alias("follows"), F.lead(seen).over(inside).alias("ahead"))
    rows = rows.join(bounds, ["spell", "shard"])
    before = F.coalesce(seen, F.col("carry_in"))
    after = F.coalesce(F.col("ahead"), F.col("carry_out"))
    spread = F.explode(F.sequence(F.col("period"), F.coalesce(F.col("follows") - 1, F.col("to"))))
    filled = rows.select("spell", "series", "step", F.col("period").alias("own"), "price", "n", before.alias("before"), after.alias("after"), spread.alias("period"))
    has = F.col("price").isNotNull() & (F.col("own") == F.col("period"))
    prev, nxt = F.col("before.price"), F.col("after.price")
    span = F.col("after.period") - F.col("before.period")
    between = F.when(has, F.col("price")).when(span > 0, prev + (nxt - prev) * (F.col("period") - F.col("before.period")) / span)
    return filled.select(
        F.col("spell").alias("listing_id"),
        F.col("series").alias("commodity_type"),
        from_micros(F.col("period") * F.col("step")).alias("period_start"),
        F.when(has, F.col("price")).alias("price"),
        F.when(has, F.col("n")).otherwise(0).cast("bigint").alias("n_readings"),
        (~has).alias("is_missing"),
        F.when(has, F.col("price")).otherwise(F.coalesce(prev, nxt)).alias("filled_price"),
        prev.alias("prev_price"),
        nxt.alias("next_price"),
        (F.col("period") - F.col("before.period")).alias("periods_since"),
        between.alias("interpolated_price"),
    )


def _carried(summaries: DataFrame) -> DataFrame:
    """Prefix scan over the shards' (head, tail) summaries: the last tail before and the next head after each shard."""
    along = Window.partitionBy("spell").orderBy("shard")
    earlier: Column = F.last("tail", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))
    later: Column = F.first("head", ignorenulls=True).over(along.rowsBetween(1, Window.unboundedFollowing))
    return summaries.select("spell", "shard", earlier.alias("carry_in"), later.alias("carry_out"))


def missing_periods(readings: DataFrame, listings: DataFrame, shard_periods: int = SHARD_PERIODS) -> DataFrame:
    """Periods of the grid without a price: commodity_type, period_start as `yyyy-MM-dd HH:mm:ss`."""
    rows = grid(readings, listings, shard_periods, counted=False).where("is_missing")
    return rows.select("commodity_type", F.date_format("period_start", "yyyy-MM-dd HH:mm:ss").alias("period_start")).distinct()

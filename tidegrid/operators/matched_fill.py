"""Filling missing prices and names of reports from similar reports, by predictive mean matching.

A missing name is copied from a donor report of the same lot or sheet. For prices, a linear predictor is fitted per
commodity on what the other reports of the sheet and of the lot show; donors are the reports whose predicted
price is nearest, found by their rank: rows are range-partitioned by (name, prediction, report), so that a shard ends
where a quantile of its rows does, ranks inside a shard are made global by prefix sums, and the ranks around a
recipient's own joined by equality. The observed price of one of the nearest donors is copied, and every filled field is
marked and names its donor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions.clean import name_key, real
from tidegrid.plans.session import written

POOL = 5
#: Rows for one shard of the sorted predictions, on average.
SHARD_ROWS = 250_000


def standin_bound(reports: DataFrame, factor: float = 50.0) -> float:
    """The price beyond which a figure stands in for none, one for all commodities, as such a figure lies far beyond every
    quoted price: `factor` times the 90th percentile of positive prices, which holds as long as fewer than a tenth of
    the prices are such figures."""
    price = real(F.col("price"))
    top = reports.where(price > 0).agg(F.percentile_approx(price, 0.9, 10_000)).first()[0]
    return float("inf") if top is None else factor * float(top)


def read_fields(reports: DataFrame, registry: DataFrame, bound: float) -> DataFrame:
    """Reports with the fields as far as they have a value: report_id, sheet_id, lot_code, price, name."""
    names = registry.select(name_key(F.col("commodity_type")).alias("key"), F.col("commodity_type").alias("name")).where("key is not null").groupBy("key").agg(F.min("name").alias("name"))
    price = real(F.col("price"))
    rows = reports.select("report_id", "sheet_id", "lot_code", F.when((price > 0) & (price <= F.lit(bound)), price).alias("price"), name_key(F.col("commodity_type")).alias("key"))
    return rows.where("report_id is not null").join(names, "key", "left").drop("key")


def _shown(rows: DataFrame, by: str, prefix: str) -> DataFrame:
    """Per sheet or lot the name most of its reports show (ties: the first by name) and the first report that shows it."""
    each = rows.where(F.col(by).isNotNull() & F.col("name").isNotNull()).groupBy(by, "name").agg(F.count(F.lit(1)).alias("n"), F.min("report_id").alias("donor"))
    best = F.max_by(F.struct("name", "donor"), F.struct("n", (-F.col("donor")).alias("first"))).alias("best")
    return each.groupBy(by).agg(best).select(by, F.col("best.name").alias(f"{prefix}_name"), F.col("best.donor").alias(f"{prefix}_donor"))


def fill_names(rows: DataFrame) -> DataFrame:
    """`read_fields` rows with name completed: adds name_filled, name_donor. Lot evidence goes before sheet evidence.
    Only rows without a name are joined; a name nobody in lot or sheet shows stays null."""
    lost = rows.where("name is null")
    lots, sheets = _shown(rows, "lot_code", "lot"), _shown(rows, "sheet_id", "sheet")
    found = lost.drop("name").join(lots, "lot_code", "left").join(sheets, "sheet_id", "left")
    found = found.select("report_id", "sheet_id", "lot_code", "price", F.coalesce("lot_name", "sheet_name").alias("name"), F.coalesce("lot_donor", "sheet_donor").alias("name_donor"))
    kept = rows.where("name is not null").select("report_id", "sheet_id", "lot_code", "price", "name", F.lit(None).cast("bigint").alias("name_donor"))
    return kept.unionByName(found.withColumn("name_donor", F.col("name_donor").cast("bigint"))).withColumn("name_filled", F.col("name_donor").isNotNull())


def _others(own: Column, has: Column, s: str, n: str) -> Column:
    """Mean of a group's log prices without the row's own; null where there are no others."""
    rest = F.col(n) - F.when(has, 1).otherwise(0)
    return F.when(rest > 0, (F.col(s) - F.when(has, own).otherwise(0.0)) / rest)


def _with_others(rows: DataFrame, by: str, out: str) -> DataFrame:
    """Rows with `out`, the mean of the other log prices of their name in the group `by`. Rows whose `by` is null belong
    to no group: they aren't summed, and their number `spare__` deals them evenly where they are shuffled for the join."""
    has = F.col("lx").isNotNull()
    spare = F.when(F.col(by).isNull(), 1 + F.pmod(F.xxhash64("report_id"), F.lit(1 << 20))).otherwise(0).alias("spare__")
    sums = rows.where(has & F.col(by).isNotNull()).groupBy(by, "name").agg(F.sum("lx").alias("s__"), F.count(F.lit(1)).alias("n__"))
    sums = sums.withColumn("spare__", F.lit(0).cast("bigint"))
    joined = rows.select("*", spare).join(sums, [by, "name", "spare__"], "left")
    return joined.select(*rows.columns, _others(F.col("lx"), has, "s__", "n__").alias(out))


def predicted(rows: DataFrame) -> DataFrame:
    """Rows (with name, lx = log price or null) with `pred`, the fitted log price.

    Predictors: mean of the others on the sheet, and mean of the others of the lot, each the commodity's mean where there
    are none. Per commodity the two coefficients solve the normal equations of centred sums (slightly ridged, so equal
    predictors do no harm)."""
    has = F.col("lx").isNotNull()
    wide = _with_others(rows.select("report_id", "sheet_id", "lot_code", "name", "lx"), "sheet_id", "x")
    wide = _with_others(wide.drop("sheet_id"), "lot_code", "z").drop("lot_code")
    mean = F.col("c_s") / F.col("c_n")
    whole = rows.where(has).groupBy("name").agg(F.sum("lx").alias("c_s"), F.count(F.lit(1)).alias("c_n"))
    wide = wide.join(whole, "name", "left")
    wide = written(wide.select("report_id", "name", "lx", mean.alias("mean"), (F.coalesce("x", mean) - mean).alias("x"), (F.coalesce("z", mean) - mean).alias("z")))
    y = F.col("lx") - F.col("mean")
    seen = wide.where(has)
    product = lambda u, v, name: F.sum(u * v).alias(name)
    x, z = F.col("x"), F.col("z")
    fit = seen.groupBy("name").agg(product(x, x, "xx"), product(z, z, "zz"), product(x, z, "xz"), product(x, y, "xy"), product(z, y, "zy"))
    a, b, c = F.col("xx") * 1.001 + 1e-9, F.col("xz"), F.col("zz") * 1.001 + 1e-9
    det = a * c - b * b
    fit = fit.select("name", ((c * F.col("xy") - b * F.col("zy")) / det).alias("bx"), ((a * F.col("zy") - b * F.col("xy")) / det).alias("bz"))
    return wide.join(fit, "name", "left").select("report_id", "name", "lx", (F.col("mean") + F.col("bx") * x + F.col("bz") * z).alias("pred"))


def match_donors(rows: DataFrame, pool: int = POOL, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Rows (report_id, name, lx, pred) without lx, with the donor drawn: report_id, donor, donor_lx, distance.

    The pool are the `pool` donors of nearest prediction (of equally near ones those nearer in the order of prediction and
    report_id); a hash of the report_id picks one. This holds at every size: ranks are those in the whole order of a name.
    A name without donors gives its rows none; a report_id given twice is a row, or a donor, each time."""
    ready = written(rows.where("name is not null and pred is not null").select("report_id", "name", "lx", "pred"))
    parts = max(-(-ready.count() // shard_rows), int(ready.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # ranges of the rows' own quantiles: equal predictions are cut by report_id, a far one widens no shard
    shards = ready.repartitionByRange(parts, "name", "pred", "report_id").withColumn("shard", F.spark_partition_id())
    shards = written(shards)  # a shard's number holds for what follows, whoever computes it
    donor = F.col("lx").isNotNull().cast("bigint")
    counts = shards.groupBy("name", "shard").agg(F.sum(donor).alias("donors"))
    along = Window.partitionBy("name").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("name", "shard", F.coalesce(F.sum("donors").over(along), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("name", "shard").orderBy("pred", "report_id").rowsBetween(Window.unboundedPreceding, 0)
    ranked = shards.withColumn("rank", F.sum(donor).over(inside)).join(counts, ["name", "shard"])
    ranked = written(ranked.select("name", "report_id", "lx", "pred", (F.col("rank") + F.col("offset")).alias("rank")))  # both sides of the join below come from it
    donors = ranked.where("lx is not null").select("name", "rank", F.col("report_id").alias("donor"), F.col("lx").alias("donor_lx"), F.col("pred").alias("donor_pred"))
    # donors up to the recipient's rank stand before it, `gap` 0 the nearest, and so do those beyond
    gaps = F.explode(F.sequence(F.lit(1 - pool), F.lit(pool)))
    asks = ranked.where("lx is null").select("name", "report_id", "pred", "rank", gaps.alias("k")).withColumn("gap", F.when(F.col("k") > 0, F.col("k") - 1).otherwise(-F.col("k")))
    asks = asks.select("name", "report_id", "pred", "gap", (F.col("rank") + F.col("k")).alias("rank"))
    near = asks.join(donors, ["name", "rank"]).withColumn("distance", F.abs(F.col("pred") - F.col("donor_pred")))
    best = F.slice(F.sort_array(F.collect_list(F.struct("distance", "gap", "donor", "donor_lx"))), 1, pool)
    drawn = near.groupBy("report_id").agg(best.alias("best"))
    one = F.get("best", F.pmod(F.xxhash64("report_id"), F.size("best")).cast("int"))
    return drawn.select("report_id", one.alias("one")).select("report_id", "one.donor", "one.donor_lx", "one.distance")


def filled_reports(reports: DataFrame, registry: DataFrame, pool: int = POOL) -> DataFrame:
    """Every report with both fields completed: report_id, commodity_type, name_filled, name_donor, price, price_filled,
    price_donor.

    A commodity_type without value is one that is no registered name in any spelling; a price without value is null,
    NaN, infinite, not positive or beyond `standin_bound`. Names come from the lot, else from the sheet; prices from a
    donor of the same commodity. What nobody can show stays null with its mark false: a name in neither lot nor sheet,
    the price of a report without name, or of a commodity without any price. Null lots are no lot, null sheets no
    sheet. Reports without an id are left out; reports handed in twice are reports of their own, as donors too. A
    report_id that occurs twice gives a row each time. Empty tables give no rows; extra columns are ignored.
    """
    # every later step reads its rows several times, so the steps are cut into written tables
    rows = written(fill_names(read_fields(reports, registry, standin_bound(reports))))
    lx = rows.withColumn("lx", F.log("price"))
    drawn = match_donors(predicted(lx.where("name is not null")), pool)
    none = [F.lit(None).cast(t).alias(c) for c, t in (("donor", "bigint"), ("donor_lx", "double"), ("distance", "double"))]
    out = rows.where("price is null").join(drawn, "report_id", "left").unionByName(rows.where("price is not null").select("*", *none))
    use = F.col("price").isNull() & F.col("donor").isNotNull()
    return out.select("report_id", F.col("name").alias("commodity_type"), "name_filled", "name_donor", F.when(use, F.exp("donor_lx")).otherwise(F.col("price")).alias("price"), use.alias("price_filled"), F.when(use, F.col("donor")).alias("price_donor"))


def missing_fields(reports: DataFrame, registry: DataFrame) -> DataFrame:
    """One row for each field without a value: report_id, field (`price` or `commodity_type`), commodity_type, the
    registered name the report belongs to (its own, or the one its lot or sheet shows)."""
    f = filled_reports(reports, registry)
    fields = F.explode(F.array_compact(F.array(F.when(F.col("price").isNull() | F.col("price_filled"), F.lit("price")), F.when(F.col("commodity_type").isNull() | F.col("name_filled"), F.lit("commodity_type")))))
    return f.select("report_id", fields.alias("field"), "commodity_type").distinct()

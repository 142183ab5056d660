"""Time axis: future ranges, calendar, holiday and Fourier columns, reshaping."""

from __future__ import annotations

import datetime as dt
import math
import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegrid.functions.clean import from_micros, micros
from tidegrid.spec import Freq, PanelSpec

ATTRIBUTES: dict[str, Callable[[Column], Column]] = {
    "minute": F.minute, "hour": F.hour, "day": F.dayofmonth, "weekday": lambda t: F.weekday(t) + 1, "week": F.weekofyear, "month": F.month, "quarter": F.quarter, "year": F.year,
}
# The range of each attribute, for dummy columns.
RANGES = {"minute": range(60), "hour": range(24), "day": range(1, 32), "weekday": range(1, 8), "week": range(1, 54), "month": range(1, 13), "quarter": range(1, 5)}


def add_calendar_effects(df: DataFrame, attrs: Sequence[str], as_dummies: bool = False) -> DataFrame:
    """Columns named after the attributes (strings), or {attr}_{value} 0/1 columns; year has no dummies."""
    t = F.col(PanelSpec.of(df).time)
    if unknown := set(attrs) - set(ATTRIBUTES) | ({"year"} & set(attrs) if as_dummies else set()):
        raise ValueError(f"no such attributes: {sorted(unknown)}")
    if as_dummies:
        return df.select("*", *[(ATTRIBUTES[a](t) == k).cast("int").alias(f"{a}_{k}") for a in attrs for k in RANGES[a]])
    return df.select("*", *[ATTRIBUTES[a](t).cast("string").alias(a) for a in attrs])


def _nth(year: int, month: int, weekday: int, n: int) -> dt.date:
    """The n-th such weekday (0: Monday) of a month; -1 for the last."""
    if n > 0:
        first = dt.date(year, month, 1)
        return first + dt.timedelta((weekday - first.weekday()) % 7 + 7 * (n - 1))
    last = dt.date(year + month // 12, month % 12 + 1, 1) - dt.timedelta(1)
    return last - dt.timedelta((last.weekday() - weekday) % 7)


def easter(year: int) -> dt.date:
    """Easter Sunday of the Gregorian calendar."""
    a, b, c = year % 19, year // 100, year % 100
    h = (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30
    m = (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7
    n = h + m - 7 * ((a + 11 * h + 22 * m) // 451) + 114
    return dt.date(year, n // 31, n % 31 + 1)


Rule = Callable[[int], dt.date]
_fixed = lambda m, d: lambda y: dt.date(y, m, d)
_on = lambda m, w, n: lambda y: _nth(y, m, w, n)
_easter = lambda days: lambda y: easter(y) + dt.timedelta(days)

def _before(month: int, day: int, weekday: int) -> Rule:
    """The last such weekday (0: Monday) before a day."""
    return lambda y: dt.date(y, month, day) - dt.timedelta((dt.date(y, month, day).weekday() - weekday - 1) % 7 + 1)


# Nation-wide public holidays by rule.
_NEW_YEAR, _CHRISTMAS, _EASTER_MONDAY = {"New Year's Day": _fixed(1, 1)}, {"Christmas Day": _fixed(12, 25)}, {"Easter Monday": _easter(1)}
HOLIDAYS: dict[str, dict[str, Rule]] = {
    "US": _NEW_YEAR | {
        "Martin Luther King Jr. Day": _on(1, 0, 3), "Washington's Birthday": _on(2, 0, 3), "Memorial Day": _on(5, 0, -1), "Juneteenth National Independence Day": lambda y: dt.date(y, 6, 19) if y >= 2021 else None,
        "Independence Day": _fixed(7, 4), "Labor Day": _on(9, 0, 1), "Columbus Day": _on(10, 0, 2), "Veterans Day": _fixed(11, 11), "Thanksgiving Day": _on(11, 3, 4),
    } | _CHRISTMAS,
    "UK": _NEW_YEAR | {"Good Friday": _easter(-2)} | _EASTER_MONDAY | {"May Day": _on(5, 0, 1), "Spring Bank Holiday": _on(5, 0, -1), "Late Summer Bank Holiday": _on(8, 0, -1)} | _CHRISTMAS | {"Boxing Day": _fixed(12, 26)},
    "DE": _NEW_YEAR | {"Good Friday": _easter(-2)} | _EASTER_MONDAY | {"Labor Day": _fixed(5, 1), "Ascension Day": _easter(39), "Whit Monday": _easter(50), "German Unity Day": _fixed(10, 3)} | _CHRISTMAS | {"Second Day of Christmas": _fixed(12, 26)},
    "FR": _NEW_YEAR | _EASTER_MONDAY | {
        "Labor Day": _fixed(5, 1), "Victory Day": _fixed(5, 8), "Ascension Day": _easter(39), "Whit Monday": _easter(50), "National Day": _fixed(7, 14), "Assumption Day": _fixed(8, 15), "All Saints' Day": _fixed(11, 1), "Armistice Day": _fixed(11, 11),
    } | _CHRISTMAS,
    "AT": _NEW_YEAR | {"Epiphany": _fixed(1, 6)} | _EASTER_MONDAY | {
        "Labor Day": _fixed(5, 1), "Ascension Day": _easter(39), "Whit Monday": _easter(50), "Corpus Christi": _easter(60), "Assumption Day": _fixed(8, 15), "National Day": _fixed(10, 26), "All Saints' Day": _fixed(11, 1), "Immaculate Conception": _fixed(12, 8),
    } | _CHRISTMAS | {"Saint Stephen's Day": _fixed(12, 26)},
    "IT": _NEW_YEAR | {"Epiphany": _fixed(1, 6), "Easter Sunday": _easter(0)} | _EASTER_MONDAY | {
        "Liberation Day": _fixed(4, 25), "Labor Day": _fixed(5, 1), "Republic Day": _fixed(6, 2), "Assumption Day": _fixed(8, 15), "All Saints' Day": _fixed(11, 1), "Immaculate Conception": _fixed(12, 8),
    } | _CHRISTMAS | {"Saint Stephen's Day": _fixed(12, 26)},
    "ES": _NEW_YEAR | {
        "Epiphany": _fixed(1, 6), "Good Friday": _easter(-2), "Labor Day": _fixed(5, 1), "Assumption Day": _fixed(8, 15), "National Day": _fixed(10, 12), "All Saints' Day": _fixed(11, 1), "Constitution Day": _fixed(12, 6), "Immaculate Conception": _fixed(12, 8),
    } | _CHRISTMAS,
    "BE": _NEW_YEAR | {"Easter Sunday": _easter(0)} | _EASTER_MONDAY | {
        "Labor Day": _fixed(5, 1), "Ascension Day": _easter(39), "Whit Sunday": _easter(49), "Whit Monday": _easter(50), "National Day": _fixed(7, 21), "Assumption Day": _fixed(8, 15), "All Saints' Day": _fixed(11, 1), "Armistice Day": _fixed(11, 11),
    } | _CHRISTMAS,
    "PL": _NEW_YEAR | {"Epiphany": _fixed(1, 6), "Easter Sunday": _easter(0)} | _EASTER_MONDAY | {
        "Labor Day": _fixed(5, 1), "Constitution Day": _fixed(5, 3), "Pentecost": _easter(49), "Corpus Christi": _easter(60), "Assumption Day": _fixed(8, 15), "All Saints' Day": _fixed(11, 1), "Independence Day": _fixed(11, 11),
    } | _CHRISTMAS | {"Second Day of Christmas": _fixed(12, 26)},
    "CA": _NEW_YEAR | {"Good Friday": _easter(-2), "Victoria Day": _before(5, 25, 0), "Canada Day": _fixed(7, 1), "Labor Day": _on(9, 0, 1), "Thanksgiving": _on(10, 0, 2), "Remembrance Day": _fixed(11, 11)} | _CHRISTMAS,
}
HOLIDAYS["GB"] = HOLIDAYS["UK"]


def slug(name: str) -> str:
    return re.sub(r"[\s_]+", "_", name.lower().replace("'", "").replace("-", "").replace(".", "")).strip("_")


def holiday_table(spark: SparkSession, country_codes: Sequence[str], years: range, observed: bool = False) -> DataFrame:
    """country, date, slug: a few dozen rows a year and country."""
    if unknown := set(country_codes) - set(HOLIDAYS):
        raise ValueError(f"no rules for {sorted(unknown)}")
    rows: dict[tuple[str, dt.date], str] = {}
    for c in country_codes:
        more = [max(years) + 1] if observed and len(years) else []  # the next New Year's Day may be observed in the last year
        named = [(n, day) for y in [*years, *more] for n, rule in HOLIDAYS[c].items() if (day := rule(y))]
        beside = [o for n, day in named if (o := observed_days(n, day))] if observed and c == "US" else []
        for n, day in [*beside, *named]:  # a holiday itself goes before one observed that day
            rows[c, day] = slug(n)
    return spark.createDataFrame([(c, d, n) for (c, d), n in rows.items()], "country string, date date, slug string")


def observed_days(name: str, day: dt.date) -> tuple[str, dt.date] | None:
    """The working day on which a holiday that falls on a weekend is observed: Friday for Saturday, Monday for Sunday."""
    shift = {5: -1, 6: 1}.get(day.weekday())
    return (f"{name} (observed)", day + dt.timedelta(shift)) if shift else None


def add_holiday_effects(df: DataFrame, country_codes: Sequence[str], as_dummies: bool = False, observed: bool = False) -> DataFrame:
    """Columns holiday__{code} with the day's holiday as a slug (null on others), or 0/1 columns for each slug. With
    `observed`, US holidays on weekends are also marked on the working day beside, as {slug}_(observed)."""
    p = PanelSpec.of(df)
    lo, hi = df.agg(F.min(F.year(p.time)), F.max(F.year(p.time))).first()
    years = range(max(lo, 1583), min(hi, 9998) + 1) if lo is not None else range(0)
    out = df
    for code in country_codes:
        days = holiday_table(df.sparkSession, [code], years, observed).select(F.col("date").alias("d__"), F.col("slug").alias(f"holiday__{code}"))
        out = out.join(days, F.col(p.time).cast("date") == F.col("d__"), "left").drop("d__")
        if as_dummies:
            names = sorted({slug(n) for n in HOLIDAYS[code]} | ({slug(f"{n} (observed)") for n in HOLIDAYS[code]} if observed and code == "US" else set()))
            out = out.withColumns({f"holiday__{code}_{n}": F.coalesce((F.col(f"holiday__{code}") == n).cast("int"), F.lit(0)) for n in names}).drop(f"holiday__{code}")
    return out


def add_fourier_terms(df: DataFrame, sp: int, K: int) -> DataFrame:
    """cos_{sp}_{k}, sin_{sp}_{k} for k = 1..K of the row's phase (position modulo sp over sp)."""
    if K > sp:
        raise ValueError("K must not exceed sp")
    p = PanelSpec.of(df)
    phase = F.pmod(F.row_number().over(Window.partitionBy(p.entity).orderBy(p.time)) - 1, F.lit(sp)) / sp
    terms = [f(2 * math.pi * k * F.col("p__")).alias(f"{n}_{sp}_{k}") for k in range(1, K + 1) for n, f in (("cos", F.cos), ("sin", F.sin))]
    return df.withColumn("p__", phase).select(*df.columns, *terms)


def shifted(time: Column, steps: Column, freq: str, kind: str) -> Column:
    """The time `steps` periods on, counted from `time` itself (months end with their last day)."""
    f = Freq.parse(freq)
    if f.is_integer:
        return (time + steps * f.n).cast(kind)
    if f.months:
        day = F.add_months(time, (steps * f.months).cast("int"))
        moved = F.timestamp_add("MICROSECOND", micros(time) - micros(F.date_trunc("day", time)), day.cast("timestamp_ntz"))
        return (day if kind == "date" else moved).cast(kind)
    return from_micros(micros(time) + steps * f.micros).cast(kind)


def make_future_ranges(cutoffs: DataFrame, fh: int, freq: str) -> DataFrame:
    """(entity, last time) -> a row for each of the next fh times: entity, time, step (1..fh)."""
    entity, time = cutoffs.columns[:2]
    kind = dict(cutoffs.dtypes)[time]
    rows = cutoffs.select(entity, F.col(time).alias("t__"), F.explode(F.sequence(F.lit(1), F.lit(fh))).alias("step"))
    return rows.select(entity, shifted(F.col("t__"), F.col("step"), freq, kind).alias(time), "step")


def future_of(df: DataFrame, fh: int, freq: str) -> DataFrame:
    """The next fh times behind each entity's last one."""
    p = PanelSpec.of(df)
    return make_future_ranges(df.groupBy(p.entity).agg(F.max(p.time).alias(p.time)), fh, freq)


def make_future_calendar_effects(df: DataFrame, attrs: Sequence[str], fh: int, freq: str) -> DataFrame:
    return add_calendar_effects(future_of(df, fh, freq).drop("step"), attrs)


def make_future_holiday_effects(df: DataFrame, country_codes: Sequence[str], fh: int, freq: str) -> DataFrame:
    return add_holiday_effects(future_of(df, fh, freq).drop("step"), country_codes)


def wide_to_long(df: DataFrame, time: str, entity: str = "entity", value: str = "value") -> DataFrame:
    """One row per (entity, time) from a column per entity."""
    names = [c for c in df.columns if c != time]
    return df.unpivot([time], names, entity, value).select(entity, time, value)


def long_to_wide(df: DataFrame, entities: Sequence[str] | None = None) -> DataFrame:
    """A column per entity, sorted by time. Entities are looked up where not given (at most 1000)."""
    p = PanelSpec.of(df)
    if entities is None:
        entities = sorted(r[0] for r in df.select(p.entity).distinct().limit(1001).collect())
        if len(entities) > 1000:
            raise ValueError("more than 1000 entities don't make a wide table")
    return df.groupBy(p.time).pivot(p.entity, list(entities)).agg(F.first(p.values[0], True)).orderBy(p.time)

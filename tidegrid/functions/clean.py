"""Reading dirty panel columns: spelling of names, prices that are no prices, time as a number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegrid.spec import FIXED_UNITS

# White space in the sense of Unicode (property White_Space), plus zero-width space and byte order mark.
BLANKS = r"[\s\u0085\u00a0\u1680\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]+"


def name_key(name: Column) -> Column:
    """One spelling for all spellings of a name: runs of white space become one blank, none at the ends, lower case.

    ASCII names whose only white space is single blanks inside, the usual ones, are spared the regular expression."""
    usual = (F.octet_length(name) == F.length(name)) & ~F.startswith(name, F.lit(" ")) & ~F.endswith(name, F.lit(" "))
    for blank in ("  ", "\t", "\n", "\x0b", "\f", "\r"):
        usual = usual & ~F.contains(name, F.lit(blank))
    return F.lower(F.when(usual, name).otherwise(F.trim(F.regexp_replace(name, BLANKS, " "))))


def real(value: Column) -> Column:
    """The value as double, null where it is null, NaN or infinite."""
    v = value.cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), v)


def micros(time: Column) -> Column:
    """Microseconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), time.cast("timestamp_ntz"))


def from_micros(us: Column) -> Column:
    """The inverse of `micros`."""
    return F.timestamp_add("MICROSECOND", us, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def freq_micros(freq: Column) -> Column:
    """Length of a fixed frequency such as `10m`, `3h`, `1d` in microseconds; null if it isn't one."""
    sizes = F.create_map(*[F.lit(x) for pair in FIXED_UNITS.items() for x in pair])
    whole = F.when(freq.rlike(r"^[1-9]\d{0,8}(us|ms|s|m|h|d|w)$"), freq)
    return F.try_element_at(sizes, F.regexp_extract(whole, r"\D+", 0)) * F.regexp_extract(whole, r"\d+", 0).cast("bigint")


def floor_to(us: Column, step: Column) -> Column:
    """The multiple of `step` at or below `us`."""
    return us - F.pmod(us, step)

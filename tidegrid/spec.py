"""Panel description and frequency aliases."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Alias -> microseconds for units of fixed length, alias -> months for calendar units.
FIXED_UNITS = {"us": 1, "ms": 1_000, "s": 1_000_000, "m": 60_000_000, "h": 3_600_000_000, "d": 86_400_000_000, "w": 604_800_000_000}
CALENDAR_UNITS = {"mo": 1, "q": 3, "y": 12}

# Usual seasonal periods of a frequency.
SEASONAL_PERIODS = {
    "1s": [60, 3_600, 86_400, 604_800, 31_557_600],
    "1m": [60, 1_440, 10_080, 525_960],
    "30m": [48, 336, 17_532],
    "1h": [24, 168, 8_766],
    "1d": [7, 365],
    "1w": [52],
    "1mo": [12],
    "3mo": [4],
    "1q": [4],
    "1y": [1],
}


@dataclass(frozen=True)
class Freq:
    """A step of the time axis: `n` steps of unit `unit` (`i` for integer time)."""

    n: int
    unit: str

    @staticmethod
    def parse(text: str) -> "Freq":
        found = re.fullmatch(r"\s*(\d+)\s*(us|ms|mo|s|m|h|d|w|q|y|i)\s*", text)
        if not found or int(found[1]) < 1:
            raise ValueError(f"not a frequency: {text!r}")
        return Freq(int(found[1]), found[2])

    @property
    def months(self) -> int:
        return self.n * CALENDAR_UNITS.get(self.unit, 0)

    @property
    def micros(self) -> int:
        return self.n * FIXED_UNITS.get(self.unit, 0)

    @property
    def is_integer(self) -> bool:
        return self.unit == "i"


def freq_to_sp(freq: str) -> list[int]:
    """Seasonal periods usual for `freq`, shortest first; ValueError for one without an entry."""
    try:
        return list(SEASONAL_PERIODS[freq])
    except KeyError:
        raise ValueError(f"no seasonal periods are known for {freq!r}") from None


@dataclass(frozen=True)
class PanelSpec:
    """Names of a long panel's columns: entity, time, then values (the target is the last one)."""

    entity: str
    time: str
    values: tuple[str, ...]

    @staticmethod
    def of(df: DataFrame) -> "PanelSpec":
        """Positional reading of a frame: first column entity, second time, the rest values."""
        if len(df.columns) < 2:
            raise ValueError("a panel has an entity and a time column at least")
        return PanelSpec(df.columns[0], df.columns[1], tuple(df.columns[2:]))

    @property
    def target(self) -> str:
        return self.values[-1]


def numeric_columns(df: DataFrame, among: tuple[str, ...]) -> list[str]:
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return [c for c in among if isinstance(kinds[c], T.NumericType)]

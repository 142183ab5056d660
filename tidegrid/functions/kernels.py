"""Features that no aggregate expresses: numpy kernels over one ordered series, all wanted ones in one Arrow pass.

A series is one entity's values in order of time (ties: by value); null and NaN are left out. A series must fit into a
worker's memory. Kernels return a float, or a list of floats, and NaN or an empty list where a series is too short.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Kernel = Callable[[np.ndarray], object]


def _embedded(x: np.ndarray, m: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(x, m) if len(x) >= m else np.zeros((0, m))


def _ball_counts(x: np.ndarray, m: int, r: float, block: int = 512) -> np.ndarray:
    """For every run of m values, how many runs (itself among them) lie within r in every place; by blocks of rows."""
    runs = _embedded(x, m)
    out = np.zeros(len(runs), np.int64)
    for a in range(0, len(runs), block):
        part = runs[a : a + block]
        near = np.ones((len(part), len(runs)), bool)
        for k in range(m):
            near &= np.abs(part[:, k, None] - runs[None, :, k]) <= r
        out[a : a + block] = near.sum(1)
    return out


def approximate_entropy(run_length: int = 2, filtering_level: float = 0.2, scale_by_std: bool = True) -> Kernel:
    """Phi(m) - Phi(m+1) with balls of radius level (times the sample standard deviation); 0 for fewer than m+1 values."""

    def run(x: np.ndarray) -> float:
        n = len(x)
        if n < run_length + 1:
            return 0.0
        r = filtering_level * (np.std(x, ddof=1) if scale_by_std else 1.0)
        phi = [float(np.log(_ball_counts(x, m, r) / (n - m + 1)).mean()) for m in (run_length, run_length + 1)]
        return abs(phi[0] - phi[1])

    return run


def sample_entropy(ratio: float = 0.2, m: int = 2) -> Kernel:
    """ln(B/A) of matching pairs of runs of m and m+1 values within ratio population standard deviations; infinite
    without pairs of the longer, NaN without any or for fewer than m values."""

    def run(x: np.ndarray) -> float:
        if len(x) < m + 1:
            return math.nan
        r = ratio * np.std(x)
        b = int(_ball_counts(x, m, r).sum()) - (len(x) - m + 1)
        a = int(_ball_counts(x, m + 1, r).sum()) - (len(x) - m)
        return math.log(b / a) if a > 0 and b > 0 else math.inf if b > 0 else math.nan

    return run


def autoregressive_coefficients(n_lags: int) -> Kernel:
    """Least squares coefficients of lags 1..n_lags, then the intercept."""

    def run(x: np.ndarray) -> list[float]:
        if len(x) < 2 * n_lags + 1:
            return []
        z = _embedded(x, n_lags + 1)
        design = np.c_[z[:, :-1][:, ::-1], np.ones(len(z))]
        return np.linalg.lstsq(design, z[:, -1], rcond=None)[0].tolist()

    return run


def augmented_dickey_fuller(n_lags: int) -> Kernel:
    """t statistic of the level in the regression of the change on level, n_lags earlier changes and a constant."""

    def run(x: np.ndarray) -> float:
        d = np.diff(x)
        if len(d) < 2 * n_lags + 4:
            return math.nan
        z = _embedded(d, n_lags + 1)
        design = np.c_[x[n_lags:-1], z[:, :-1], np.ones(len(z))]
        beta, *_ = np.linalg.lstsq(design, z[:, -1], rcond=None)
        free = len(z) - design.shape[1]
        error = ((z[:, -1] - design @ beta) ** 2).sum() / free
        spread = math.sqrt(max(error * float(np.linalg.pinv(design.T @ design)[0, 0]), 0.0))
        return float(beta[0]) / spread if spread else math.nan

    return run


def ricker(points: int, width: float) -> np.ndarray:
    """Mexican hat wavelet at `points` places around its middle."""
    t = (np.arange(points) - (points - 1) / 2) / width
    return 2 / (math.sqrt(3 * width) * math.pi**0.25) * (1 - t * t) * np.exp(-t * t / 2)


def _cwt(x: np.ndarray, widths: tuple[int, ...]) -> np.ndarray:
    return np.array([np.convolve(x, ricker(min(10 * w, len(x)), w)[::-1], "same")[: len(x)] for w in widths])


def cwt_coefficients(widths: tuple[int, ...] = (2, 5, 10, 20), n_coefficients: int = 14) -> Kernel:
    """The first n_coefficients wavelet coefficients, for each place one for each width."""
    return lambda x: _cwt(x, widths)[:, :n_coefficients].T.ravel().tolist() if len(x) else []


def welch(x: np.ndarray, segment: int = 256) -> np.ndarray:
    """One-sided power density by averaged Hann windows of min(n, segment) values, half overlapping, means removed."""
    n = min(len(x), segment)
    if n == 0:
        return np.zeros(0)
    window = np.hanning(n + 1)[:-1] if n > 1 else np.ones(1)
    parts = _embedded(x, n)[:: max(1, n - n // 2)]
    spectrum = np.abs(np.fft.rfft((parts - parts.mean(1, keepdims=True)) * window, axis=1)) ** 2 / (window @ window)
    spectrum[:, 1 : (n + 1) // 2] *= 2
    return spectrum.mean(0)


def spkt_welch_density(n_coeffs: int | None = None) -> Kernel:
    return lambda x: welch(x)[:n_coeffs].tolist()


def fourier_entropy(n_bins: int = 10) -> Kernel:
    """Entropy over n_bins bins of the power density relative to its greatest; NaN for a single value."""

    def run(x: np.ndarray) -> float:
        p = welch(x)
        if len(x) < 2:
            return math.nan
        p = p / p.max() if p.max() > 0 else p
        share = np.histogram(p, bins=n_bins)[0] / len(p)
        return float(-(share[share > 0] * np.log(share[share > 0])).sum())

    return run


def friedrich_coefficients(polynomial_order: int = 3, n_quantiles: int = 30) -> Kernel:
    """Polynomial through (mean value, mean change) of the quantile bins, highest power first."""

    def run(x: np.ndarray) -> list[float]:
        if len(x) < polynomial_order + 2:
            return []
        at, d = x[:-1], np.diff(x)
        edges = np.unique(np.quantile(at, np.linspace(0, 1, n_quantiles + 1)))
        place = np.clip(np.searchsorted(edges, at, "left") - 1, 0, max(len(edges) - 2, 0))
        k = np.bincount(place)
        some = k > 0
        if some.sum() <= polynomial_order:
            return []
        return np.polyfit(np.bincount(place, at)[some] / k[some], np.bincount(place, d)[some] / k[some], polynomial_order).tolist()

    return run


def number_cwt_peaks(max_width: int = 5) -> Kernel:
    """Ridge lines of local maxima over widths max_width..1 that are long enough and rise above the noise."""

    def run(x: np.ndarray) -> float:
        if len(x) < 3:
            return 0.0
        table = _cwt(x, tuple(range(1, max_width + 1)))
        peaks = np.zeros_like(table, bool)
        peaks[:, 1:-1] = (table[:, 1:-1] > table[:, :-2]) & (table[:, 1:-1] > table[:, 2:])
        lines: list[list[tuple[int, int]]] = []
        for row in range(max_width - 1, -1, -1):
            reach = math.ceil((row + 1) / 4) + 1
            for c in np.flatnonzero(peaks[row]):
                near = [line for line in lines if abs(line[-1][1] - c) <= reach and 0 < line[-1][0] - row <= 2]
                if near:
                    min(near, key=lambda line: abs(line[-1][1] - c)).append((row, int(c)))
                else:
                    lines.append([(row, int(c))])
        size = max(1, math.ceil(len(x) / 20))
        noise = [np.quantile(np.abs(table[0, max(0, k - size // 2) : k + size // 2 + 1]), 0.1) for k in range(len(x))]
        long = [line for line in lines if len(line) >= math.ceil(max_width / 4)]
        return float(sum(table[line[-1][0], line[-1][1]] >= noise[line[-1][1]] for line in long))

    return run


def fft_coefficients() -> Kernel:
    """Real parts, imaginary parts and angles in degrees of the Fourier transform, one after another."""

    def run(x: np.ndarray) -> list[float]:
        c = np.fft.rfft(x) if len(x) else np.zeros(0, complex)
        return np.r_[c.real, c.imag, np.degrees(np.arctan2(c.imag, c.real))].tolist()

    return run


def lempel_ziv_complexity(threshold: float, as_ratio: bool = True) -> Kernel:
    """Number of phrases never met before when the bits x > threshold are read on (an unfinished last one not counted),
    over n where as_ratio."""

    def run(x: np.ndarray) -> float:
        phrases: set[tuple[bool, ...]] = set()
        phrase: tuple[bool, ...] = ()
        for bit in x > threshold:
            phrase += (bool(bit),)
            if phrase not in phrases:
                phrases.add(phrase)
                phrase = ()
        if not len(x):
            return math.nan
        return len(phrases) / len(x) if as_ratio else float(len(phrases))

    return run


def cusum(threshold: float, warmup_period: int, drift: float = 0.0) -> Kernel:
    """1 where the two-sided cumulative sum of standardised deviations passes the threshold, else 0. Mean and (population)
    deviation come from the warm-up, which begins anew after each event."""

    def run(x: np.ndarray) -> list[float]:
        out = [0.0] * len(x)
        begin, up, down = 0, 0.0, 0.0
        mean = spread = 0.0
        for t, value in enumerate(x):
            seen = t - begin
            if seen < warmup_period:
                continue
            if seen == warmup_period:
                mean, spread = float(np.mean(x[begin:t])), float(np.std(x[begin:t])) if t > begin else 0.0
            z = (value - mean) / spread if spread > 0 else 0.0
            up, down = max(0.0, up + z - drift), max(0.0, down - z - drift)
            if up > threshold or down > threshold:
                out[t] = 1.0
                begin, up, down = t + 1, 0.0, 0.0
        return out

    return run


def extract_arrays(df: DataFrame, entity: str, time: str, value: str, kernels: dict[str, Kernel]) -> DataFrame:
    """One row per entity: the entity, then an array of doubles for each kernel (single figures as arrays of one).

    Series are gathered and sorted as arrays by Spark, so that Python gets many of them in one Arrow batch."""
    rows = df.select(F.col(entity), F.col(time).alias("t"), F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    series = rows.groupBy(entity).agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "v"))), lambda s: s["v"]).alias("x__"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            xs = [np.asarray(x, float) for x in pdf["x__"]]
            yield pd.DataFrame({entity: pdf[entity], **{k: [np.atleast_1d(np.asarray(f(x), float)) for x in xs] for k, f in kernels.items()}})

    kind = dict(rows.dtypes)[entity]
    return series.mapInPandas(run, ", ".join([f"`{entity}` {kind}", *[f"`{k}` array<double>" for k in kernels]]))

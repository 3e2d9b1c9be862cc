"""Spectral and amplitude features of short windows, as row-local array expressions: no Python, no shuffle.

The discrete Fourier transform is taken by definition, so these forms suit windows up to some hundred samples; longer windows
go through the Arrow functions, which use an FFT.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A share of power that is no more than the square of rounding.
ROUNDING = 1e-24


def bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) where f uses x inside a lambda: x is evaluated once for a row, not once for each element."""
    return F.flatten(F.transform(F.array(x), f))


def added(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def mean_of(x: Column) -> Column:
    return added(x) / F.nullif(F.size(x), F.lit(0))


def centred(x: Column) -> Column:
    """Each value less the mean, which is taken once (bound by a one-element array)."""
    return F.flatten(F.transform(F.array(mean_of(x)), lambda m: F.transform(x, lambda v: v - m)))


def moments(x: Column) -> Column:
    """struct n, mean, m2, m3, m4 (central, divided by n)."""
    c = centred(x)
    power = lambda k: added(F.transform(c, lambda v: v**k if k > 2 else v * v)) / F.size(x)
    return F.struct(F.size(x).alias("n"), mean_of(x).alias("mean"), power(2).alias("m2"), power(3).alias("m3"), power(4).alias("m4"))


def power_spectrum(x: Column, n: int) -> Column:
    """|DFT|^2 / n for the bins 0 to n / 2 of a window of n samples. Cosines come from a constant table of whole-turn fractions."""
    turn = [2 * math.pi * m / n for m in range(n)]
    cos, sin = (F.array(*[F.lit(f(a)) for a in turn]) for f in (math.cos, math.sin))

    def bin_power(y: Column, k: Column) -> Column:
        at = lambda table, i: F.get(table, k * i % n)
        re = added(F.transform(y, lambda v, i: v * at(cos, i)))
        im = added(F.transform(y, lambda v, i: v * at(sin, i)))
        return (re * re + im * im) / n

    return bound(x, lambda y: F.transform(F.sequence(F.lit(0), F.lit(n // 2)), lambda k: bin_power(y, k)))


def band_sum(psd: Column, n: int, fs: float, low: float, high: float) -> Column:
    """Bins with low <= k fs / n < high."""
    step = fs / n
    return added(F.filter(psd, lambda _, k: (k * step >= low) & (k * step < high)))


def band_peak(psd: Column, n: int, fs: float, low: float, high: float, closed: bool = False) -> Column:
    """struct p, k of the largest bin in the band; the first of equals."""
    step = fs / n
    inside = lambda k: (k * step >= low) & ((k * step <= high) if closed else (k * step < high))
    rows = F.filter(F.transform(psd, lambda p, k: F.struct(p.alias("p"), (-k).alias("k"))), lambda r: inside(-r["k"]))
    return F.array_max(rows)


def spread(psd: Column) -> Column:
    """Shannon entropy of the positive bins (those above rounding) over that of an even spread; 0 under two bins."""
    pos = bound(added(psd), lambda t: F.filter(psd, lambda p: p > ROUNDING * t))
    h = -F.transform(F.array(added(pos)), lambda s: F.aggregate(pos, F.lit(0.0), lambda a, p: a + p / s * F.ln(p / s)))[0]
    return F.when(F.size(pos) < 2, F.lit(0.0)).otherwise(h / F.nullif(F.ln(F.size(pos)), F.lit(0.0)))


def lag_correlation(x: Column, low: int, high: int) -> Column:
    """Autocorrelation at the lags low to high of a centred window, divided by lag 0; null for a constant."""
    return F.flatten(F.transform(F.array(centred(x)), lambda c: F.transform(F.sequence(F.lit(low), F.lit(high)), lambda k: added(F.zip_with(F.slice(c, F.lit(1), F.size(c) - k), F.slice(c, k + 1, F.size(c) - k), lambda a, b: a * b)) / F.nullif(added(F.transform(c, lambda v: v * v)), F.lit(0.0)))))


def papr_time(x: Column) -> Column:
    c = F.transform(centred(x), lambda v: v * v)
    return F.array_max(c) / F.nullif(mean_of(c), F.lit(0.0))


def papr_spectrum(x: Column, n: int) -> Column:
    p = power_spectrum(centred(x), n)
    return F.array_max(p) / F.nullif(mean_of(p), F.lit(0.0))


def local_maxima(x: Column) -> Column:
    """Positions of strict local maxima."""
    return F.filter(F.transform(x, lambda v, i: F.when((i > 0) & (i < F.size(x) - 1) & (v > F.try_element_at(x, i)) & (v > F.try_element_at(x, i + 2)), i)), lambda i: i.isNotNull())


def amplitude_stability(x: Column, size: int) -> Column:
    """Smallest over largest of the parts' greatest absolute values; a rest is dropped."""
    n = F.floor(F.size(x) / size).cast("int")
    top = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_max(F.transform(F.slice(x, i * size + 1, F.lit(size)), lambda v: F.abs(v))))
    return F.when(n >= 1, F.coalesce(F.array_min(top) / F.nullif(F.array_max(top), F.lit(0.0)), F.lit(0.0))).otherwise(F.lit(0.0))

"""Artefacts on raw windows as Column expressions. Random numbers are counted, not drawn: each is the MD5 of the window's name, a place and the seed, so a
window has the same noise in any order, partition, rerun or engine that has MD5."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from pulsegrid.operators import spectral as S

#: Bursts of a motion artefact, their deviation, and the range of its sine in Hz.
BURSTS, BURST, SWAY = 3, 2.0, (0.1, 0.5)


def digest(name: Column, place: Column | str, seed: int) -> Column:
    return F.md5(F.concat_ws(":", name.cast("string"), place if isinstance(place, Column) else F.lit(place), F.lit(str(seed))))


def uniform(digest: Column, part: int = 0) -> Column:
    """In (0, 1), by eight hex digits of the digest."""
    return (F.conv(F.substring(digest, 8 * part + 1, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)


def normal(digest: Column) -> Column:
    """Standard normal, by the first two uniform numbers of the digest (Box and Muller)."""
    return F.sqrt(-2 * F.ln(uniform(digest, 0))) * F.cos(2 * math.pi * uniform(digest, 1))


def white(x: Column, name: Column, seed: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(x) - 1), lambda i: S.bound(F.array(digest(name, i.cast("string"), seed)), lambda d: F.transform(d, normal))[0])


def motion(x: Column, fs: float, name: Column, seed: int) -> Column:
    """A slow sine of any phase and bursts of a second each."""
    n, long = F.size(x), int(fs)
    sine = digest(name, "sine", seed)
    rate, phase = SWAY[0] + (SWAY[1] - SWAY[0]) * uniform(sine, 0), 2 * math.pi * uniform(sine, 1)
    starts = [F.floor(uniform(digest(name, f"burst {b}", seed)) * F.greatest(n - long, F.lit(1))) for b in range(BURSTS)]
    drawn = S.bound(F.array(F.struct(rate.alias("rate"), phase.alias("phase"), *[a.alias(f"b{k}") for k, a in enumerate(starts)])), lambda p: p)

    def at(p: Column, i: Column) -> Column:
        out = F.sin(2 * math.pi * p["rate"] * i / fs + p["phase"])
        for k in range(BURSTS):
            inside = (i >= p[f"b{k}"]) & (i < p[f"b{k}"] + long)
            out = out + F.when(inside, BURST * normal(digest(name, F.concat(F.lit(f"burst {k}:"), i.cast("string")), seed))).otherwise(F.lit(0.0))
        return out

    return F.flatten(F.transform(drawn, lambda p: F.transform(F.sequence(F.lit(0), n - 1), lambda i: at(p, i))))


def corrupted(x: Column, name: Column, fs: float, kind: str, snr_db: float, seed: int = 0) -> Column:
    """The window with noise at a signal-to-noise ratio (of the window's variance to the noise's mean square): ``white``, or ``motion``. Null and empty
    windows stay; a missing sample stays missing and counts neither way; a flat window has no power, so it gets no noise."""
    noise = white(x, name, seed) if kind == "white" else motion(x, fs, name, seed)

    def added(n: Column) -> Column:
        known = F.filter(x, lambda v: v.isNotNull())
        mean = S.mean_of(known)
        power = S.bound(F.array(mean), lambda m: F.transform(m, lambda a: S.mean_of(F.transform(known, lambda v: (v - a) * (v - a)))))[0] / 10 ** (snr_db / 10)
        scale = F.sqrt(power / F.nullif(S.mean_of(F.transform(n, lambda v: v * v)), F.lit(0.0)))
        return F.flatten(F.transform(F.array(F.coalesce(scale, F.lit(0.0))), lambda s: F.zip_with(x, n, lambda v, e: v + s * e)))

    return F.when(F.size(x) > 0, S.bound(noise, added)).otherwise(x)

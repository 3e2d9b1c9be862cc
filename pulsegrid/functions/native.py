"""Column expressions: array transforms by higher-order functions, weight maps, fusion. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-9


def num(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


# Arrays


def shifted(x: Column, k: int) -> Column:
    """k > 0 delays, k < 0 advances; zeros come in."""
    n = F.size(x)
    if k == 0:
        return x
    zeros = F.array_repeat(F.lit(0.0), F.least(F.lit(abs(k)), n))
    if k > 0:
        return F.concat(zeros, F.slice(x, F.lit(1), F.greatest(n - k, F.lit(0))))
    return F.concat(F.slice(x, F.lit(1 - k), F.greatest(n + k, F.lit(0))), zeros)


def flipped(x: Column, flag: Column | bool) -> Column:
    sign = F.when(flag if isinstance(flag, Column) else F.lit(flag), F.lit(-1.0)).otherwise(F.lit(1.0))
    return F.transform(x, lambda v: v * sign)


def trimmed(x: Column, start: Column | int, end: Column | int) -> Column:
    """The first and last samples become null."""
    n = F.size(x)
    return F.transform(x, lambda v, i: F.when((i >= start) & (i < n - end), v))


def trim_samples(seconds: float, fs: float) -> int:
    return round(seconds * fs)


def unit_range(x: Column) -> Column:
    """To [-1, 1]; flat becomes zeros."""
    low, high = F.array_min(x), F.array_max(x)
    return F.transform(x, lambda v: F.when(high > low, 2 * (v - low) / F.nullif(high - low, F.lit(0.0)) - 1).otherwise(F.lit(0.0)))


def min_max_range(x: Column) -> Column:
    """To [0, 1]; null if flat or not finite."""
    low, high = F.array_min(x), F.array_max(x)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(~bad & (high - low >= 1e-12), F.transform(x, lambda v: (v - low) / F.nullif(high - low, F.lit(0.0))))


def thinned(x: Column, most: int = 500) -> Column:
    k = F.greatest(F.floor(F.size(x) / most), F.lit(1))
    return F.when(F.size(x) > most, F.filter(x, lambda v, i: i % k == 0)).otherwise(x)


def windows_of(x: Column, size: int, hop: int) -> Column:
    """array<struct<win_idx, samples>> of the complete windows, counted from sample 0."""
    n = F.floor((F.size(x) - size) / hop).cast("int")
    return F.when(F.size(x) >= size, F.transform(F.sequence(F.lit(0), n), lambda i: F.struct(i.alias("win_idx"), F.slice(x, i * hop + 1, F.lit(size)).alias("samples")))).otherwise(F.array().cast("array<struct<win_idx:int,samples:array<double>>>"))


def safe_corr(x: str, y: str) -> Column:
    """Aggregate Pearson correlation; 0 where either side has no spread."""
    sx, sy = F.stddev_pop(x), F.stddev_pop(y)
    return F.when((sx > 0) & (sy > 0), F.covar_pop(x, y) / F.nullif(sx * sy, F.lit(0.0))).otherwise(F.lit(0.0))


# Weight maps over expert columns


def total(columns: Sequence[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out + c
    return out


def softmax_weights(errors: Sequence[str], scale: Column | float) -> list[Column]:
    """softmax(-error / (scale + eps)); a missing error weighs 0; the sum falls short of 1 by eps."""
    s = num(scale) + EPS
    z = [-F.col(e) / s for e in errors]
    top = F.greatest(*z) if len(z) > 1 else z[0]
    w = [F.coalesce(F.exp(x - top), F.lit(0.0)) for x in z]
    return [x / (total(w) + EPS) for x in w]


def decay_weights(errors: Sequence[str], e0: Column | float, tau: Column | float, zero: str = "equal") -> list[Column]:
    """1 up to e0, then exp(-(error - e0) / tau); missing weighs 0. A row without weight is equal, or stays 0 with zero='keep'."""
    raw = [F.when(F.col(e).isNull(), F.lit(0.0)).when(F.greatest(F.col(e), F.lit(0.0)) <= num(e0), F.lit(1.0)).otherwise(F.exp(-(F.col(e) - num(e0)) / num(tau))) for e in errors]
    s = total(raw)
    return [F.when(s > 0, x / F.nullif(s, F.lit(0.0))).otherwise(F.lit(1.0 / len(raw) if zero == "equal" else 0.0)) for x in raw]


def blended_weights(weights: Sequence[Column], trusts: Sequence[Column | float]) -> list[Column]:
    """trust * w + (1 - trust) / K with trusts clipped to [0, 1], then divided by the sum."""
    k = len(weights)
    t = [F.least(F.greatest(num(x), F.lit(0.0)), F.lit(1.0)) for x in trusts]
    b = [a * w + (1 - a) / k for a, w in zip(t, weights, strict=True)]
    return [x / F.nullif(total(b), F.lit(0.0)) for x in b]


def quality_weights(qualities: Sequence[str], beta: float = 4.0, floor: float = 0.05) -> list[Column]:
    """softmax(beta * quality), lifted so that none falls under the floor."""
    z = [F.col(q) * beta for q in qualities]
    top = F.greatest(*z)
    e = [F.exp(x - top) for x in z]
    return [(1 - len(z) * floor) * x / total(e) + floor for x in e]


def proportional_weights(qualities: Sequence[str], floor: float = 0.05) -> list[Column]:
    raw = [F.greatest(F.col(q), F.lit(0.0)) + floor for q in qualities]
    return [x / total(raw) for x in raw]


def equal_weights(k: int) -> list[Column]:
    return [F.lit(1.0 / k)] * k


def fused(weights: Sequence[Column], probabilities: Sequence[str]) -> Column:
    return total([w * F.col(p) for w, p in zip(weights, probabilities, strict=True)])


def entropy_experts(weights: Sequence[Column]) -> Column:
    """exp of the weights' entropy: how many experts count."""
    return F.exp(-total([F.when(w > 0, w * F.ln(w)).otherwise(F.lit(0.0)) for w in weights]))


def unit_clip(x: Column, low: Column, high: Column) -> Column:
    """(x - low) / (high - low) clipped to [0, 1]; missing or no spread is 0.5."""
    u = (x - low) / F.nullif(high - low, F.lit(0.0))
    return F.coalesce(F.least(F.greatest(u, F.lit(0.0)), F.lit(1.0)), F.lit(0.5))


def kurtosis_quality(k: Column, clean: float = 3.0) -> Column:
    return F.coalesce(F.least(F.greatest(1 - F.greatest(k - clean, F.lit(0.0)) / 10, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))


def rate_agrees(rate: Column, reference: Column, tol: float = 10.0) -> Column:
    """Do two rates lie within ``tol``? Null where either is missing or not finite."""
    off = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return F.when(~off(rate) & ~off(reference), F.abs(rate - reference) <= tol)


def best_of(columns: Sequence[str]) -> Column:
    """The largest value among a modality's channels; missing ones are left out."""
    c = [F.col(x) for x in columns]
    return F.greatest(*c) if len(c) > 1 else c[0]


def mean_of_present(columns: Sequence[str]) -> Column:
    """The mean over a modality's channels that have a value; null without any."""
    n = total([F.col(x).isNotNull().cast("int") for x in columns])
    return total([F.coalesce(F.col(x), F.lit(0.0)) for x in columns]) / F.nullif(n.cast("double"), F.lit(0.0))


def smooth_l1(a: Column, b: Column) -> Column:
    d = F.abs(a - b)
    return F.when(d < 1, 0.5 * d * d).otherwise(d - 0.5)


def discordance(p: Sequence[str]) -> list[Column]:
    """Distance of each expert to the median of the others."""
    out = []
    for i, x in enumerate(p):
        rest = [F.col(y) for j, y in enumerate(p) if j != i]
        s = F.array_sort(F.array(*rest))
        n = len(rest)
        med = F.element_at(s, n // 2 + 1) if n % 2 else (F.element_at(s, n // 2) + F.element_at(s, n // 2 + 1)) / 2
        out.append(F.abs(F.col(x) - med))
    return out


def meta_features(p: Sequence[str]) -> dict[str, Column]:
    """The experts, their mean, population spread, extremes and pairwise distances."""
    c = [F.col(x) for x in p]
    mean = total(c) / len(c)
    out = {x: F.col(x) for x in p} | {"mean": mean, "std": F.sqrt(total([(x - mean) * (x - mean) for x in c]) / len(c)), "max": F.greatest(*c), "min": F.least(*c)}
    for i in range(len(c)):
        for j in range(i + 1, len(c)):
            out[f"d{i}{j}"] = F.abs(c[i] - c[j])
    return out


def seeded_uniform(key: Column, factor: int = 48271) -> Column:
    """A reproducible number in [0, 1) from an integer key, by one step of a multiplicative generator."""
    return (key * factor % 2147483647) / F.lit(2147483647.0)

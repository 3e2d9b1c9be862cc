"""Arrow functions that apply the window kernels to array columns. One call returns all fields of a block as a struct."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from pulsegrid.functions import dsp
from pulsegrid.functions import rr as R
from pulsegrid.functions import window_features as W
from pulsegrid.functions.detectors import detector


def as_array(x) -> np.ndarray | None:
    """A window as float64; None for null. Missing samples are NaN."""
    return None if x is None else np.asarray([np.nan if v is None else v for v in x] if getattr(x, "dtype", None) == object else x, np.float64)


def whole(x: np.ndarray | None) -> bool:
    """Windows with a missing sample have no features: missing, not partial."""
    return x is not None and len(x) > 0 and bool(np.isfinite(x).all())


def struct_function(kernel: Callable[[np.ndarray], dict[str, float]], keys: tuple[str, ...]) -> Callable[[Column], Column]:
    """kernel(window) -> dict as a struct of doubles; NaN and unusable windows become null."""

    @F.pandas_udf(", ".join(f"`{k}` double" for k in keys))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        with np.errstate(all="ignore"):
            for b in batches:
                rows = [kernel(x) if whole(x) else {} for x in map(as_array, b)]
                table = pd.DataFrame(rows, columns=list(keys), index=range(len(rows))).astype(float)
                yield table.where(np.isfinite(table), None).astype(object).where(lambda t: t.notna(), None)

    return run


def scalar_function(kernel: Callable[[np.ndarray], float]) -> Callable[[Column], Column]:
    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        with np.errstate(all="ignore"):
            for b in batches:
                v = [kernel(x) if whole(x) else None for x in map(as_array, b)]
                yield pd.Series([None if u is None or not np.isfinite(u) else float(u) for u in v], dtype=object)

    return run


def array_function(kernel: Callable[[np.ndarray], np.ndarray], kind: str = "array<double>") -> Callable[[Column], Column]:
    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        with np.errstate(all="ignore"):
            for b in batches:
                yield pd.Series([None if x is None else kernel(x) for x in map(as_array, b)], dtype=object)

    return run


def peaks(name: str | Callable, fs: float) -> Callable[[Column], Column]:
    """Positions by a detector, named or a caller's own; an unknown name is refused here, on the driver."""
    find = detector(name)

    def safe(x: np.ndarray) -> np.ndarray:
        try:
            return np.asarray(find(x, fs)).astype(np.int32)
        except (ValueError, IndexError):
            return np.zeros(0, np.int32)

    return array_function(safe, "array<int>")


def band_passed(low: float, high: float, fs: float, order: int = 4) -> Callable[[Column], Column]:
    """Zero-phase band-pass. Signals of one length run through the recursion together, some at a time. A signal that is too short or has a
    missing sample gives null."""
    sections = dsp.butter_sections(order, low, high, fs)
    pad, most = 3 * (2 * len(sections) + 1), 2_000_000

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            rows = [as_array(x) for x in b]
            out: list = [None] * len(rows)
            sizes: dict[int, list[int]] = {}
            for i, x in enumerate(rows):
                if whole(x) and len(x) > pad:
                    sizes.setdefault(len(x), []).append(i)
            for n, at in sizes.items():
                step = max(1, most // n)
                for k in range(0, len(at), step):
                    part = at[k : k + step]
                    for i, y in zip(part, dsp.zero_phase(sections, np.stack([rows[i] for i in part])), strict=True):
                        out[i] = y
            yield pd.Series(out, dtype=object)

    return run


def resampled(m: int) -> Callable[[Column], Column]:
    return array_function(lambda x: dsp.fft_resample(x, m))


def spectrum(n: int, centred: bool) -> Callable[[Column], Column]:
    """Periodogram bins 0 to n / 2 of windows of n samples: one FFT call for a whole batch. Other sizes and missing samples give null."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            rows = [as_array(x) for x in b]
            ok = [i for i, x in enumerate(rows) if whole(x) and len(x) == n]
            out: list = [None] * len(rows)
            if ok:
                m = np.stack([rows[i] for i in ok])
                psd = np.abs(np.fft.rfft(m - m.mean(axis=1, keepdims=True) if centred else m, axis=1)) ** 2 / n
                for i, p in zip(ok, psd, strict=True):
                    out[i] = p
            yield pd.Series(out, dtype=object)

    return run


def moving_mean(size: int) -> Callable[[Column], Column]:
    return array_function(lambda x: dsp.moving_mean(x, size))


def drift_corrected(initial: int, final: int) -> Callable[[Column], Column]:
    return array_function(lambda x: dsp.correct_drift(x, initial, final))


def rr_of(source: str | Callable, fs: float) -> Callable[[Column], Column]:
    """RR series in ms by source name or detector; null where the detector finds too little."""
    if callable(source) or source not in R.RR_SOURCES:
        detector(source)
    return array_function(lambda x: R.rr_series(x, fs, source))


def signal_features(fs: float, source: str, use_af_rr: bool = True, legacy: bool = False) -> Callable[[Column], Column]:
    return struct_function(lambda x: W.signal_block(x, fs, source, use_af_rr, legacy), W.signal_keys(use_af_rr, legacy))


def bcg_features(fs: float, level: int = 6) -> Callable[[Column], Column]:
    return struct_function(lambda x: W.bcg_block(x, fs, level), W.bcg_keys(level))


def summary() -> Callable[[Column], Column]:
    return struct_function(W.summary_stats, W.BCG_STATS)


def sqi(fs: float, kind: str) -> Callable[[Column], Column]:
    return struct_function(lambda x: W.sqi_block(x, fs, kind), W.SQI_KEYS)


def af_features() -> Callable[[Column], Column]:
    """Of an array of RR in ms."""
    return struct_function(lambda rr: R.af_block(rr), R.AF_KEYS)


def rr_errors() -> Callable[[Column, Column], Column]:
    """Of two arrays of RR in ms: valid, hr_err, cosen_err, drr_sd_err."""
    kinds = ("hr_err", "cosen_err", "drr_sd_err")

    @F.pandas_udf("valid boolean, " + ", ".join(f"{k} double" for k in kinds))
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        with np.errstate(all="ignore"):
            for a, b in batches:
                rows = [R.error_metrics(as_array(x), as_array(y)) for x, y in zip(a, b, strict=True)]
                yield pd.DataFrame({"valid": [r["valid"] for r in rows]} | {k: pd.Series([float(r[k]) if np.isfinite(r[k]) else None for r in rows], dtype=object) for k in kinds})

    return run


def reference_quality(fs: float) -> Callable[[Column], Column]:
    keys = ("gt_conf", "gt_n_strong", "gt_nbeat_range", "gt_hr_median", "gt_fallback_agree")
    return struct_function(lambda x: R.reference_confidence(x, fs), keys)


#: Window scalars by name, each (window, fs) -> double.
SCALARS: dict[str, Callable[[np.ndarray, float], float]] = {
    "sample_entropy": lambda x, fs: W.sample_entropy(x),
    "papr_time": lambda x, fs: W.papr(x, "time"),
    "papr_spectrum": lambda x, fs: W.papr(x, "spectrum"),
    "t_sqi": W.t_sqi,
    "peak_snr": W.peak_snr,
    "rr_plausibility": W.rr_plausibility,
    "spectral_concentration": W.spectral_concentration,
    "beat_count_ok": W.beat_count_ok,
    "cor_sqi": W.cor_sqi,
    "a_sqi": W.a_sqi,
    "acceptable": lambda x, fs: float(W.acceptable(x, fs)),
}


def scalar(name: str, fs: float) -> Callable[[Column], Column]:
    kernel = SCALARS[name]
    return scalar_function(lambda x: kernel(x, fs))

"""Peak detectors: each takes (signal, fs) and returns sample positions. Addressed by name through ``DETECTORS``."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from pulsegrid.functions.dsp import band_energy, band_pass, boxcar_energy, cwt, fft_resample, find_peaks, moving_mean

# Scales that band-energy detectors draw from.
BCG_SCALES = np.geomspace(2, 64, 80)
CECG_SCALES = np.geomspace(2, 60, 100)


def by_prominence(x: np.ndarray, fs: float, factor: float = 0.3) -> np.ndarray:
    return find_peaks(x, distance=max(1, int(0.4 * fs)), prominence=factor * np.std(x))


def by_amplitude(x: np.ndarray, fs: float) -> np.ndarray:
    """As ``by_prominence``; a constant signal has no prominence test."""
    s = np.std(x)
    return find_peaks(x, distance=max(1, int(0.4 * fs)), prominence=0.3 * s if s > 0 else None)


def smoothed(x: np.ndarray, fs: float) -> np.ndarray:
    return by_amplitude(moving_mean(x, max(3, int(0.1 * fs))), fs)


def energetic(x: np.ndarray, fs: float) -> np.ndarray:
    return by_amplitude(moving_mean(np.diff(x, prepend=x[:1]) ** 2, max(3, int(0.1 * fs))), fs)


def bcg_wavelet(x: np.ndarray, fs: float, scale: float = 20) -> np.ndarray:
    """Peaks at one Gaussian scale of the signal resampled to 50 Hz."""
    y = cwt(fft_resample(x, len(x) * 50 // int(fs)), "gaus2", np.array([float(scale)]))[0]
    return find_peaks(y, distance=15) * int(fs) // 50


def bcg_band(x: np.ndarray, fs: float) -> np.ndarray:
    e = band_energy(x, fs, "gaus2", BCG_SCALES, 1.5, 12)
    p = find_peaks(e, height=np.quantile(e, 0.7), distance=max(1, int(0.4 * fs)))
    return p if len(p) >= 4 else find_peaks(e, height=np.quantile(e, 0.5), distance=max(1, int(0.4 * fs)))


def cecg_band(x: np.ndarray, fs: float, seconds: float = 20, quantile: float = 0.8) -> np.ndarray:
    """Band energy 5-15 Hz in segments; a rest of less than a second is left out."""
    size, out = int(seconds * fs), []
    for a in range(0, len(x), size):
        part = x[a : a + size]
        if len(part) >= fs:
            e = band_energy(part, fs, "morlet", CECG_SCALES, 5, 15)
            out.append(a + find_peaks(e, height=np.quantile(e, quantile), distance=max(1, int(0.4 * fs))))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def rolling_mean_beats(x: np.ndarray, fs: float, low: float = 30, high: float = 220) -> np.ndarray:
    """One peak in each region above a raised 0.75 s mean, of peaks under 60 / high seconds apart the higher; of the raises the one
    with the least RR spread at a plausible rate. Beats whose RR leaves mean +- max(30 %, 300 ms) go, and 10-beat stretches with more than three of these."""
    best, spread = np.zeros(0, np.int64), np.inf
    scaled = (x - np.min(x)) / (np.ptp(x) or 1) * 1024
    mean = moving_mean(scaled, max(3, int(0.75 * fs)))
    for raise_by in (5, 10, 15, 20, 25, 30, 40, 50, 60, 70, 80, 90, 100, 110, 120, 150, 200, 300):
        above = np.flatnonzero(np.diff(np.concatenate([[0], scaled > mean + mean.mean() * raise_by / 100, [0]]).astype(int)))
        peaks = np.array([a + int(np.argmax(scaled[a:b])) for a, b in zip(above[::2], above[1::2], strict=True)], np.int64)
        for i in np.argsort(scaled[peaks], kind="stable"):
            near = np.abs(peaks - peaks[i]) < 60 / high * fs
            if (scaled[peaks[near]] > scaled[peaks[i]]).any():
                peaks[i] = -(10**9) - i * 10**6
        peaks = peaks[peaks >= 0]
        if len(peaks) > 2:
            rr = np.diff(peaks) / fs * 1000
            if low <= 60 * len(peaks) / (len(x) / fs) <= high and 0.1 < rr.std() < spread:
                best, spread = peaks, rr.std()
    return best


def accepted_rr(peaks: np.ndarray, fs: float) -> tuple[np.ndarray, float]:
    """(RR in ms without outliers and spoiled stretches, share of rejected beats)."""
    rr = np.diff(peaks) / fs * 1000
    if not len(rr):
        return rr, 1.0
    m = rr.mean()
    ok = np.abs(rr - m) <= max(0.3 * m, 300)
    bad = ~ok
    for a in range(0, len(rr), 10):
        if bad[a : a + 10].sum() > 3:
            ok[a : a + 10] = False
    return rr[ok], float(1 - ok.mean())


def r_peaks(x: np.ndarray, fs: float) -> np.ndarray:
    """Squared 5-15 Hz signal over its mean + half a deviation, 0.3 s apart."""
    e = band_pass(x, 5, 15, fs, order=2) ** 2
    return find_peaks(e, height=e.mean() + 0.5 * e.std(), distance=max(1, int(0.3 * fs)))


def r_gradient(x: np.ndarray, fs: float) -> np.ndarray:
    """Steep stretches (short mean of the absolute gradient over its long mean); the most prominent sample of each, 0.3 s apart."""
    g = np.abs(np.gradient(band_pass(x, 0.5, min(40, 0.45 * fs), fs, order=2)))
    short, long = moving_mean(g, max(1, int(0.1 * fs))), moving_mean(g, max(1, int(0.75 * fs)))
    edge = np.flatnonzero(np.diff(np.concatenate([[0], short > 1.5 * long, [0]]).astype(int)))
    starts, ends = edge[::2], edge[1::2]
    size = ends - starts
    out, last = [], -np.inf
    for a, b in zip(starts, ends, strict=True):
        if b - a >= 0.4 * size.mean():
            p = a + int(np.argmax(x[a:b]))
            if p - last >= 0.3 * fs:
                out.append(p)
                last = p
    return np.array(out, np.int64)


def r_integrated(x: np.ndarray, fs: float) -> np.ndarray:
    """Band-pass, derivative, square, integration; adaptive signal and noise levels."""
    y = boxcar_energy(band_pass(x, 5, 15, fs, order=2), fs)
    signal, noise, out = 0.25 * y.max(), 0.5 * y.mean(), []
    for p in find_peaks(y, distance=max(1, int(0.25 * fs))):
        if y[p] > noise + 0.25 * (signal - noise):
            a, b = max(0, p - int(0.1 * fs)), p + int(0.1 * fs) + 1
            out.append(a + int(np.argmax(x[a:b])))
            signal += 0.125 * (y[p] - signal)
        else:
            noise += 0.125 * (y[p] - noise)
    return np.unique(np.array(out, np.int64))


def r_slopes(x: np.ndarray, fs: float) -> np.ndarray:
    """Absolute derivative of the 8-16 Hz signal, averaged over 80 ms; medians of the last eight peaks and noises set the level."""
    y = moving_mean(np.abs(np.diff(band_pass(x, 8, 16, fs, order=2), prepend=0)), max(1, int(0.08 * fs)))
    beats, noises, out = [0.5 * y.max()], [0.0], []
    for p in find_peaks(y, distance=max(1, int(0.2 * fs))):
        n, b = np.median(noises[-8:]), np.median(beats[-8:])
        if y[p] > n + 0.45 * (b - n):
            a, e = max(0, p - int(0.1 * fs)), p + int(0.1 * fs) + 1
            out.append(a + int(np.argmax(x[a:e])))
            beats.append(y[p])
        else:
            noises.append(y[p])
    return np.unique(np.array(out, np.int64))


REFERENCE_DETECTORS: dict[str, Callable] = {"gradient": r_gradient, "integrated": r_integrated, "slopes": r_slopes}


def r_peaks_all(x: np.ndarray, fs: float, names: tuple[str, ...] = tuple(REFERENCE_DETECTORS)) -> dict[str, np.ndarray]:
    """Every named detector that works on the signal; the others are missing from the result."""
    out = {}
    for name in names:
        try:
            out[name] = REFERENCE_DETECTORS[name](x, fs)
        except (KeyError, ValueError):
            continue
    return out


def recording_r_peaks(x: np.ndarray, fs: float) -> np.ndarray:
    """A whole recording at once; missing samples become the median. Falls back to integrated energy over 0.3 (mean + deviation)."""
    x = np.where(np.isfinite(x), x, np.nanmedian(x) if np.isfinite(x).any() else 0.0)
    try:
        got = r_gradient(x, fs)
    except ValueError:
        got = np.zeros(0, np.int64)
    if len(got) >= 2:
        return got
    y = boxcar_energy(x, fs)
    return find_peaks(y, height=0.3 * (y.mean() + y.std()), distance=max(1, int(0.2 * fs)))


def oriented_peaks(x: np.ndarray, fs: float) -> np.ndarray:
    """Median-centred and turned towards its larger excursion; none if short, flat or not finite."""
    x = np.asarray(x, float)
    if len(x) < 8 or not np.isfinite(x).all() or not x.std() > 0:
        return np.zeros(0, np.int64)
    c = x - np.median(x)
    c = -c if -c.min() > c.max() else c
    return find_peaks(c, distance=max(1, int(0.3 * fs)), prominence=0.5 * c.std())


DETECTORS: dict[str, Callable[[np.ndarray, float], np.ndarray]] = {
    "prominence": by_prominence,
    "amplitude": by_amplitude,
    "smoothed": smoothed,
    "energy": energetic,
    "bcg_wavelet": bcg_wavelet,
    "bcg_band": bcg_band,
    "cecg_band": cecg_band,
    "rolling_mean": rolling_mean_beats,
    "r_peaks": r_peaks,
    "oriented": oriented_peaks,
    "recording": recording_r_peaks,
    **REFERENCE_DETECTORS,
}


def detector(name: str | Callable) -> Callable[[np.ndarray, float], np.ndarray]:
    """By name, or a caller's own function of (signal, fs); an unknown name is refused before any work is handed out."""
    if callable(name):
        return name
    if name not in DETECTORS:
        raise ValueError(f"unknown detector {name!r}; known: {', '.join(sorted(DETECTORS))}")
    return DETECTORS[name]

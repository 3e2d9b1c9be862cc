"""Signal kernels in numpy: filters, peaks, spectra, wavelets. Written from their public definitions."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

# Daubechies-4 decomposition low-pass taps.
DB4_LOW = np.array([-0.010597401785069032, 0.0328830116668852, 0.030841381835560764, -0.18703481171909309, -0.027983769416859854, 0.6308807679298589, 0.7148465705529157, 0.2303778133088965])
DB4_HIGH = DB4_LOW[::-1] * np.where(np.arange(8) % 2, 1.0, -1.0)
# Pass band of each channel kind in Hz (low, high).
BANDS = {"cecg": (0.5, 35.0), "ppg": (0.6, 3.6), "bcg": (0.6, 10.0), "gt": (0.5, 35.0)}


@lru_cache(64)
def butter_sections(order: int, low: float, high: float, fs: float) -> np.ndarray:
    """(order, 6) second-order sections b0 b1 b2 1 a1 a2 of a Butterworth band-pass: prototype poles on the left
    half circle, moved to the pre-warped band and to the z-plane by the bilinear map."""
    warp = 2 * fs * np.tan(np.pi * np.array([low, high]) / fs)
    width, centre = warp[1] - warp[0], np.sqrt(warp[0] * warp[1])
    proto = np.exp(1j * np.pi * (2 * np.arange(order) + order + 1) / (2 * order))
    half = proto * width / 2
    root = np.sqrt(half * half - centre * centre)
    z = [(2 * fs + p) / (2 * fs - p) for p in np.concatenate([half + root, half - root])]
    upper = sorted((p for p in z if p.imag > 1e-12), key=abs)
    real = sorted(p.real for p in z if abs(p.imag) <= 1e-12)
    dens = [np.array([1, -2 * p.real, abs(p) ** 2]) for p in upper] + [np.array([1, -(a + b), a * b]) for a, b in zip(real[::2], real[1::2], strict=False)]
    mid = np.exp(1j * 2 * np.arctan(centre / (2 * fs)))
    out = []
    for d in dens:
        gain = abs((1 - mid**-2) / (d[0] + d[1] / mid + d[2] / mid**2))
        out.append([1 / gain, 0, -1 / gain, *d])
    return np.array(out)


def section_state(s: np.ndarray) -> np.ndarray:
    """Both delays of a section (transposed form II) after a long input of ones."""
    b0, b1, b2, _, a1, a2 = s
    y = (b0 + b1 + b2) / (1 + a1 + a2)
    return np.array([b1 - a1 * y + b2 - a2 * y, b2 - a2 * y])


#: Fewer rows than this are filtered one by one.
FEW = 16


def recursion(b0: float, b1: float, b2: float, a1: float, a2: float, z0: float, z1: float, x: list[float]) -> list[float]:
    """One section over one row."""
    y = []
    for v in x:
        o = b0 * v + z0
        z0 = b1 * v - a1 * o + z1
        z1 = b2 * v - a2 * o
        y.append(o)
    return y


def run_sections(sections: np.ndarray, x: np.ndarray, steady: bool) -> np.ndarray:
    """Filter the rows of x. The recursion runs over time once, for all rows at a time; a few rows go one by one, in plain numbers, which are faster then."""
    x = np.atleast_2d(x).astype(float)
    first = x[:, :1]
    for s in sections:
        b0, b1, b2, _, a1, a2 = s
        z = section_state(s)[None] * first if steady else np.zeros((len(x), 2))
        if steady:
            first = first * ((b0 + b1 + b2) / (1 + a1 + a2))
        if len(x) < FEW:
            x = np.array([recursion(*map(float, (b0, b1, b2, a1, a2)), *map(float, d), v.tolist()) for d, v in zip(z, x, strict=True)]).reshape(x.shape)
            continue
        z0, z1 = z[:, 0].copy(), z[:, 1].copy()
        y = np.empty_like(x)
        for t in range(x.shape[1]):
            v = x[:, t]
            o = b0 * v + z0
            z0 = b1 * v - a1 * o + z1
            z1 = b2 * v - a2 * o
            y[:, t] = o
        x = y
    return x


def zero_phase(sections: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Forward and backward over an odd extension at both ends, in the steady state of its first sample."""
    rows = np.atleast_2d(np.asarray(x, float))
    pad = 3 * (2 * len(sections) + 1)
    if rows.shape[1] <= pad:
        raise ValueError(f"needs more than {pad} samples")
    left, right = 2 * rows[:, :1] - rows[:, pad:0:-1], 2 * rows[:, -1:] - rows[:, -2 : -pad - 2 : -1]
    y = run_sections(sections, np.concatenate([left, rows, right], axis=1), True)
    y = run_sections(sections, y[:, ::-1], True)[:, ::-1][:, pad:-pad]
    return y[0] if np.ndim(x) == 1 else y


def settled(sections: np.ndarray) -> int:
    """Samples after which the state at the start has faded by 2^80, far under the last bit of any output."""
    return int(np.ceil(np.log(2.0**-80) / np.log(np.sqrt(sections[:, 5].max()))))


def band_pass(x: np.ndarray, low: float, high: float, fs: float, order: int = 4) -> np.ndarray:
    return zero_phase(butter_sections(order, float(low), float(high), float(fs)), x)


def find_peaks(x: np.ndarray, height: float | None = None, distance: float | None = None, prominence: float | None = None) -> np.ndarray:
    """Strict local maxima (the middle of a plateau), then height, then distance (higher peaks first), then prominence."""
    x = np.asarray(x, float)
    if len(x) < 3:
        return np.zeros(0, np.int64)
    edge = np.flatnonzero(np.diff(x) != 0)
    begin, end = np.append(0, edge + 1), np.append(edge, len(x) - 1)
    v = x[begin]
    top = np.flatnonzero((v[1:-1] > v[:-2]) & (v[1:-1] > v[2:])) + 1
    peaks = (begin[top] + end[top]) // 2
    if height is not None:
        peaks = peaks[x[peaks] >= height]
    if distance is not None and len(peaks):
        gap = int(np.ceil(distance))
        keep = np.ones(len(peaks), bool)
        for i in np.argsort(x[peaks], kind="stable")[::-1]:
            if keep[i]:
                near = np.abs(peaks - peaks[i]) < gap
                near[i] = False
                keep &= ~near
        peaks = peaks[keep]
    if prominence is not None and len(peaks):
        peaks = peaks[prominences(x, peaks) >= prominence]
    return peaks


def prominences(x: np.ndarray, peaks: np.ndarray) -> np.ndarray:
    """Height over the higher of the two lowest points on the way to a higher sample or to the edge."""
    out = np.empty(len(peaks))
    for k, p in enumerate(peaks):
        above = np.flatnonzero(x > x[p])
        at = np.searchsorted(above, p)
        a = above[at - 1] + 1 if at else 0
        b = above[at] if at < len(above) else len(x)
        out[k] = x[p] - max(x[a : p + 1].min(), x[p:b].min())
    return out


def moving_mean(x: np.ndarray, size: int) -> np.ndarray:
    """Centred mean with half-sample reflection at the edges; an even size takes one sample more on the left."""
    left, right = size // 2, size - size // 2 - 1
    n = len(x)
    at = np.arange(-left, n + right) % (2 * n)
    y = np.asarray(x, float)[np.where(at < n, at, 2 * n - 1 - at)]
    c = np.concatenate([[0.0], np.cumsum(y)])
    return (c[size:] - c[:-size]) / size


def fft_resample(x: np.ndarray, m: int) -> np.ndarray:
    """Resample to m points by cutting or extending the spectrum; an unpaired Nyquist bin is halved or doubled."""
    n = len(x)
    f = np.fft.rfft(x)
    k = min(n, m)
    g = np.zeros(m // 2 + 1, complex)
    g[: k // 2 + 1] = f[: k // 2 + 1]
    if k % 2 == 0:
        g[k // 2] *= 0.5 if m > n else 2 if m < n else 1
        if m < n:
            g[k // 2] = g[k // 2].real
    return np.fft.irfft(g, m) * (m / n)


def wavelet(name: str, scale: float) -> np.ndarray:
    """A scaled wavelet on whole samples, divided by the square root of its scale."""
    if name == "morlet":
        half = int(np.ceil(4 * scale))
        t = np.arange(-half, half + 1) / scale
        return np.exp(-t * t / 2) * np.cos(5 * t) / np.sqrt(scale)
    half = int(np.ceil(5 * scale))
    t = np.arange(-half, half + 1) / scale
    # The negative second derivative of a Gaussian exp(-t^2), of unit energy.
    return (2 / np.pi) ** 0.25 * (2 / np.sqrt(3)) * (1 - 2 * t * t) * np.exp(-t * t) / np.sqrt(scale)


CENTRE = {"morlet": 0.8125, "gaus2": 0.3}


def cwt(x: np.ndarray, name: str, scales: np.ndarray) -> np.ndarray:
    """(scales, samples) correlation with each scaled wavelet, by one FFT of the signal."""
    x = np.asarray(x, float)
    waves = [wavelet(name, s) for s in scales]
    n = 1 << int(np.ceil(np.log2(len(x) + max(map(len, waves)))))
    f = np.fft.rfft(x, n)
    out = np.empty((len(waves), len(x)))
    for i, w in enumerate(waves):
        full = np.fft.irfft(f * np.fft.rfft(w[::-1], n), n)
        out[i] = full[len(w) // 2 : len(w) // 2 + len(x)]
    return out


def band_energy(x: np.ndarray, fs: float, name: str, scales: np.ndarray, low: float, high: float) -> np.ndarray:
    """Sum of squared coefficients over the scales whose frequency lies in the band; only those are computed."""
    f = CENTRE[name] * fs / scales
    inside = scales[(f >= low) & (f <= high)]
    return (cwt(x, name, inside) ** 2).sum(axis=0) if len(inside) else np.zeros(len(x))


def swt(x: np.ndarray, level: int = 6) -> list[tuple[np.ndarray, np.ndarray]]:
    """(approximation, detail) of each level: periodic a-trous convolution. The signal is extended at its end by
    reflection to a multiple of 2^level and the coefficients cut back."""
    n, unit = len(x), 1 << level
    a = np.pad(np.asarray(x, float), (0, -n % unit), "symmetric")
    out = []
    size = len(a)
    for j in range(level):
        step = 1 << j
        at = (np.arange(size)[:, None] + (np.arange(8)[None, :] - 4) * step) % size
        part = a[at]
        a, d = part @ DB4_LOW[::-1], part @ DB4_HIGH[::-1]
        out.append((a[:n], d[:n]))
    return out


def periodogram(x: np.ndarray, fs: float, centred: bool) -> tuple[np.ndarray, np.ndarray]:
    """(frequencies, |rfft|^2 / N), with or without removing the mean."""
    x = np.asarray(x, float)
    f = np.fft.rfft(x - x.mean() if centred else x)
    return np.fft.rfftfreq(len(x), 1 / fs), np.abs(f) ** 2 / len(x)


def autocorrelation(x: np.ndarray) -> np.ndarray | None:
    """Non-negative lags, mean removed, divided by lag 0; None for a constant."""
    x = np.asarray(x, float)
    x = x - x.mean()
    if not x.std() > 0:
        return None
    n = 1 << int(np.ceil(np.log2(2 * len(x))))
    r = np.fft.irfft(np.abs(np.fft.rfft(x, n)) ** 2, n)[: len(x)]
    return r / r[0]


def shift(x: np.ndarray, k: int) -> np.ndarray:
    """k > 0 delays, k < 0 advances; zeros come in."""
    out = np.zeros(len(x))
    if k >= 0:
        out[k:] = x[: max(0, len(x) - k)]
    else:
        out[:k] = x[-k:]
    return out


def correct_drift(x: np.ndarray, initial: int, final: int) -> np.ndarray:
    """Shift by ``initial``, then read at positions that drift linearly by final - initial; 0 outside."""
    n = len(x)
    y = shift(np.asarray(x, float), initial)
    at = np.arange(n)
    return np.interp(at + np.linspace(0, final - initial, n), at, y, left=0.0, right=0.0)


def correct_drift_part(x: np.ndarray, begin: int, n: int, initial: int, final: int, at: np.ndarray) -> np.ndarray:
    """The samples ``at`` of ``correct_drift`` of a signal of ``n`` samples, of which ``x`` are those from ``begin`` on."""
    if initial == 0 and final == 0:
        return x[at - begin]
    pos = at + at * ((final - initial) / max(n - 1, 1))
    grid = np.arange(max(int(np.floor(pos.min())), 0), min(int(np.ceil(pos.max())), n - 1) + 1)
    if not len(grid):
        return np.zeros(len(at))
    src = grid - initial
    y = np.where((src >= 0) & (src < n), x[np.clip(src - begin, 0, len(x) - 1)], 0.0)
    return np.where((pos < 0) | (pos > n - 1), 0.0, np.interp(pos, grid, y))


def to_unit(x: np.ndarray) -> np.ndarray:
    """Scaled to [-1, 1]; a flat signal becomes zeros."""
    low, high = np.min(x), np.max(x)
    return np.zeros(len(x)) if high == low else 2 * (x - low) / (high - low) - 1


def min_max(x: np.ndarray) -> np.ndarray | None:
    """Scaled to [0, 1]; None if flat or not finite."""
    x = np.asarray(x, float)
    if not len(x) or not np.isfinite(x).all() or np.ptp(x) < 1e-12:
        return None
    return (x - x.min()) / np.ptp(x)


def thin(x: np.ndarray, most: int = 500) -> np.ndarray:
    return x[:: len(x) // most] if len(x) > most else x


def boxcar_energy(x: np.ndarray, fs: float, seconds: float = 0.15) -> np.ndarray:
    """Squared first difference, integrated over a sliding box."""
    d = np.diff(x, prepend=x[0]) ** 2
    size = max(1, int(seconds * fs))
    return np.convolve(d, np.ones(size) / size, "same")


def corrupted(x: np.ndarray, fs: float, kind: str, snr_db: float, seed: int) -> np.ndarray:
    """The window with added noise at a signal-to-noise ratio: ``white``, or ``motion`` (a slow sine and bursts)."""
    rng = np.random.default_rng(seed)
    n = len(x)
    if kind == "white":
        noise = rng.normal(size=n)
    else:
        noise = np.sin(2 * np.pi * rng.uniform(0.1, 0.5) * np.arange(n) / fs + rng.uniform(0, 2 * np.pi))
        for _ in range(3):
            at = int(rng.integers(0, max(1, n - int(fs))))
            noise[at : at + int(fs)] += rng.normal(0, 2, len(noise[at : at + int(fs)]))
    power = np.mean(np.square(x - np.mean(x))) / 10 ** (snr_db / 10)
    return x + noise * np.sqrt(power / max(np.mean(noise**2), 1e-300))

"""Signal processing in numpy; no Spark here. Signals are (rows, time) float64 arrays."""

from __future__ import annotations

from functools import lru_cache

import numpy as np


@lru_cache(64)
def butter_bandpass(low: float, high: float, fs: float, order: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients of a digital Butterworth band-pass (bilinear transform, pre-warped edges)."""
    poles = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    w1, w2 = (2 * fs * np.tan(np.pi * f / fs) for f in (low, high))
    width, centre = w2 - w1, np.sqrt(w1 * w2)
    half = poles * width / 2
    root = np.sqrt(half**2 - centre**2)
    analog = np.concatenate((half + root, half - root))
    digital = (2 * fs + analog) / (2 * fs - analog)
    gain = np.real(width**order * (2 * fs) ** order / np.prod(2 * fs - analog))
    b = gain * np.real(np.poly(np.concatenate((np.ones(order), -np.ones(order)))))
    return b, np.real(np.poly(digital))


def lfilter(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray | None = None) -> np.ndarray:
    """Causal filter along time, direct form II transposed; state: (rows, len(a) - 1)."""
    return lfilter_on(b, a, x, state)[0]


#: Samples that the filters take at once.
STEP = 64


def lfilter_on(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """lfilter, and the state after it. STEP samples are one product with the filter's responses to each sample and each number of the state."""
    z = np.zeros((len(x), len(a) - 1)) if state is None else state.copy()
    y = np.empty_like(x, float)
    at = 0
    if x.shape[1] >= STEP and np.isfinite(x).all():
        m = _responses(tuple(b.tolist()), tuple(a.tolist()))
        while at + STEP <= x.shape[1]:
            out = np.concatenate((x[:, at : at + STEP], z), 1) @ m
            y[:, at : at + STEP], z = out[:, :STEP], out[:, STEP:]
            at += STEP
    rest, z = _one_by_one(b, a, x[:, at:], z)
    y[:, at:] = rest
    return y, z


def _one_by_one(b: np.ndarray, a: np.ndarray, x: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    y, z = np.empty_like(x, float), z.copy()
    for t in range(x.shape[1]):
        y[:, t] = b[0] * x[:, t] + z[:, 0]
        z[:, :-1] = z[:, 1:] + np.outer(x[:, t], b[1:-1]) - np.outer(y[:, t], a[1:-1])
        z[:, -1] = b[-1] * x[:, t] - a[-1] * y[:, t]
    return y, z


@lru_cache(32)
def _responses(b: tuple, a: tuple) -> np.ndarray:
    """(STEP + order, STEP + order): from samples and state to outputs and state."""
    b, a = np.array(b), np.array(a)
    unit = np.eye(STEP + len(a) - 1)
    return np.concatenate(_one_by_one(b, a, unit[:, :STEP], unit[:, STEP:]), 1)


def steady_state(b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """The filter's state after an endless step of height 1."""
    n = len(a) - 1
    companion = np.zeros((n, n))
    companion[:, 0] = -a[1:]
    companion[np.arange(n - 1), np.arange(1, n)] = 1
    return np.linalg.solve(np.eye(n) - companion, b[1:] - a[1:] * b[0])


def filtfilt(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Forwards and backwards, with odd extension by three times the filter's length. Short signals take one product with what it makes of each sample."""
    if len(x) > 1 and x.shape[1] <= 256 and np.isfinite(x).all():
        return x @ _both_ways(tuple(b.tolist()), tuple(a.tolist()), x.shape[1])
    return _filtfilt(b, a, x)


@lru_cache(32)
def _both_ways(b: tuple, a: tuple, n: int) -> np.ndarray:
    return _filtfilt(np.array(b), np.array(a), np.eye(n))


def _filtfilt(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    pad = 3 * max(len(a), len(b))
    if x.shape[1] <= pad:
        raise ValueError(f"needs more than {pad} samples, has {x.shape[1]}")
    ext = np.concatenate((2 * x[:, :1] - x[:, pad:0:-1], x, 2 * x[:, -1:] - x[:, -2 : -pad - 2 : -1]), 1)
    zi = steady_state(b, a)
    y = lfilter(b, a, ext, ext[:, :1] * zi)
    y = lfilter(b, a, y[:, ::-1], y[:, -1:] * zi)[:, ::-1]
    return y[:, pad:-pad]


def bandpass(x: np.ndarray, fps: float, low: float = 0.65, high: float = 4.0, order: int = 6) -> np.ndarray:
    return filtfilt(*butter_bandpass(low, high, fps, order), x)


def notch(centre: np.ndarray, q: float, fs: float) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (rows, 3) of second-order notch filters at the centres (Hz), each -3 dB wide by centre / q."""
    w = 2 * np.pi * np.asarray(centre, float)[:, None] / fs
    gain = 1 / (1 + np.tan(w / (2 * q)))
    b = gain * np.concatenate((np.ones_like(w), -2 * np.cos(w), np.ones_like(w)), 1)
    return b, np.concatenate((np.ones_like(w), -2 * gain * np.cos(w), 2 * gain - 1), 1)


def lfilter_rows(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Causal second-order filters, each row with its own coefficients (rows, 3)."""
    first, second, y = np.zeros(len(x)), np.zeros(len(x)), np.empty_like(x, float)
    for t in range(x.shape[1]):
        y[:, t] = b[:, 0] * x[:, t] + first
        first = second + b[:, 1] * x[:, t] - a[:, 1] * y[:, t]
        second = b[:, 2] * x[:, t] - a[:, 2] * y[:, t]
    return y


@lru_cache(32)
def _trend(n: int, smoothing: float) -> np.ndarray:
    d = np.zeros((max(0, n - 2), n))
    rows = np.arange(max(0, n - 2))
    d[rows, rows], d[rows, rows + 1], d[rows, rows + 2] = 1, -2, 1
    return np.linalg.inv(np.eye(n) + smoothing**2 * d.T @ d)


def detrend(x: np.ndarray, det_lambda: float = 10.0, absolute: bool = False) -> np.ndarray:
    """Smoothness priors; lambda is time / det_lambda, or det_lambda itself where absolute."""
    n = x.shape[1]
    return x - x @ _trend(n, det_lambda if absolute else n / det_lambda).T


def savgol(x: np.ndarray, window: int = 31, degree: int = 5) -> np.ndarray:
    """Least-squares smoothing; the edges take the values of the polynomial fitted to the end windows."""
    half = window // 2
    basis = np.vander(np.arange(-half, half + 1) / half, degree + 1, increasing=True)
    fit = basis @ np.linalg.pinv(basis)
    n = x.shape[1]
    if n < window:
        raise ValueError(f"needs {window} samples, has {n}")
    views = np.lib.stride_tricks.sliding_window_view(x, window, 1)
    out = np.empty_like(x, float)
    out[:, half : n - half] = views @ fit[half]
    out[:, :half] = x[:, :window] @ fit[:half].T
    out[:, n - half :] = x[:, n - window :] @ fit[half + 1 :].T
    return out


@lru_cache(8)
def _waves(n: int, nfft: int, bins: tuple[int, ...]) -> np.ndarray:
    """(n, 2 x bins): cosines and sines of the bins under a periodic Hann window."""
    t = np.arange(n)
    turn = 2 * np.pi * (np.outer(t, bins) % nfft) / nfft
    return (0.5 - 0.5 * np.cos(2 * np.pi * t / n))[:, None] * np.concatenate((np.cos(turn), np.sin(turn)), 1)


def welch(x: np.ndarray, fs: float, low: float = 0.65, high: float = 4.0, nfft: int = 2048, overlap: float = 0.8) -> tuple[np.ndarray, np.ndarray]:
    """(BPM of the bins inside the band, one-sided density): periodic Hann, segments' means removed. Band ends are excluded."""
    n = x.shape[1]
    seg = n if n < 256 else 256
    hop = seg - (int(overlap * n) if n < 256 else 200)
    nfft = max(nfft, seg)
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(seg) / seg)
    parts = np.lib.stride_tricks.sliding_window_view(x, seg, 1)[:, ::hop]
    f = (np.arange(nfft // 2 + 1) * fs / nfft).astype(np.float32)
    band = (f > low) & (f < high)
    # the band's bins alone, as one product with their waves under the window
    bins, turns = int(band.sum()), _waves(seg, nfft, tuple(np.flatnonzero(band).tolist()))
    power = np.zeros((len(x), bins))
    for k in range(parts.shape[1]):
        s = (parts[:, k] - parts[:, k].mean(1, keepdims=True)) @ turns
        power += s[:, :bins] ** 2 + s[:, bins:] ** 2
    sides = np.where((np.flatnonzero(band) == 0) | (2 * np.flatnonzero(band) == nfft), 1, 2)
    return f[band].astype(float) * 60, power * sides / (parts.shape[1] * fs * (hann**2).sum())


def stft_track(x: np.ndarray, fs: float, window: float = 5.0, low: float = 0.65, high: float = 4.0) -> tuple[np.ndarray, np.ndarray]:
    """(times, BPM of the strongest bin) of one signal, a step of a second; the ends are mirrored by half a window."""
    n, hop = int(window * fs), max(1, int(fs))
    nfft = max(2048, int(120 * fs))
    half = n // 2
    ext = np.concatenate((x[half:0:-1], x, x[-2 : -half - 2 : -1]))
    ext = np.concatenate((ext, np.zeros(-(len(ext) - n) % hop)))
    f = np.arange(nfft // 2 + 1) * fs / nfft
    band = (f > low) & (f < high)
    parts = np.lib.stride_tricks.sliding_window_view(ext, n)[::hop]
    best = np.empty(len(parts), int)
    for k in range(0, len(parts), 512):
        s = parts[k : k + 512] @ _waves(n, nfft, tuple(np.flatnonzero(band).tolist()))
        best[k : k + 512] = (s[:, : s.shape[1] // 2] ** 2 + s[:, s.shape[1] // 2 :] ** 2).argmax(1)
    return np.arange(len(parts)) * hop / fs, 60 * f[band][best]


def filtfilt_many(b: np.ndarray, a: np.ndarray, signals: list[np.ndarray]) -> list[np.ndarray]:
    """filtfilt of signals of any lengths: those of like length are filtered together, filled up behind their ends, which a causal filter doesn't see."""
    pad, zi = 3 * max(len(a), len(b)), steady_state(b, a)
    if short := [len(x) for x in signals if len(x) <= pad]:
        raise ValueError(f"needs more than {pad} samples, has {short[0]}")
    ext = [np.concatenate((2 * x[:1] - x[pad:0:-1], x, 2 * x[-1:] - x[-2 : -pad - 2 : -1])) for x in signals]
    like: dict = {}
    for k, x in enumerate(ext):
        like.setdefault((len(x).bit_length(), bool(np.isfinite(x).all())), []).append(k)
    out: list = [None] * len(signals)
    for at in like.values():
        own = [ext[k] for k in at]
        for _ in range(2):  # forwards, then backwards
            block = np.zeros((len(own), -(-max(map(len, own)) // STEP) * STEP))
            for row, x in zip(block, own, strict=True):
                row[: len(x)] = x
            y = lfilter(b, a, block, block[:, :1] * zi)
            own = [row[: len(x)][::-1] for row, x in zip(y, own, strict=True)]
        for k, y in zip(at, own, strict=True):
            out[k] = y[pad:-pad]
    return out


def qrs_band(signals: list[np.ndarray], fs: float) -> list[np.ndarray]:
    """Signals of any lengths in the band of an ECG's QRS complexes."""
    return filtfilt_many(*butter_bandpass(5.0, min(15.0, 0.45 * fs), fs, 2), signals)


def r_peaks(x: np.ndarray, fs: float, y: np.ndarray | None = None) -> np.ndarray:
    """Places of an ECG's R peaks: band-passed slope energy over 0.15 s, then its maxima over a running threshold, 0.3 s apart. y: qrs_band of x, if it is known."""
    y = qrs_band([x], fs)[0] if y is None else y
    energy = np.convolve(np.gradient(y) ** 2, np.ones(max(1, int(0.15 * fs))), "same")
    gap = int(0.3 * fs)
    out = _apart(energy, np.flatnonzero(~(energy < 0.3 * _running_max(energy, int(2 * fs)))), gap)
    near = int(0.1 * fs)
    return np.array(sorted(max(0, p - near) + int(np.argmax(x[max(0, p - near) : p + near + 1])) for p in out))


def _running_max(x: np.ndarray, reach: int) -> np.ndarray:
    """The largest value within `reach` places of each, by spans that double: a few passes, whatever the reach."""
    n = 2 * reach + 1
    out, span = np.pad(x, reach, constant_values=-np.inf), 1
    while 2 * span <= n:
        out, span = np.maximum(out[:-span], out[span:]), 2 * span
    return np.maximum(out[: len(x)], out[n - span : n - span + len(x)])


def _apart(height: np.ndarray, places: np.ndarray, gap: int) -> list[int]:
    """Of the places in order of height, the first of equals first, those that aren't within the gap of a taken one."""
    order, free, out = places[np.argsort(-height[places], kind="stable")], np.ones(len(height), bool), []
    while len(order):
        k = int(order[0])
        out.append(k)
        free[max(0, k - gap) : k + gap + 1] = False
        order = order[free[order]]
    return out


def heart_rate(peaks: np.ndarray, fs: float) -> tuple[np.ndarray, np.ndarray]:
    """(times, BPM) from successive peaks; the time is the later peak's."""
    gaps = np.diff(peaks)
    return peaks[1:] / fs, 60 * fs / gaps


def gauss_sigma(power: np.ndarray, freqs: np.ndarray, mu: float, sigma: float = 1.0) -> dict[str, float]:
    """Width of a Gaussian of height 1 at mu that fits the power best, by damped Gauss-Newton from 1; with chi square, AIC and BIC."""
    d2 = (freqs - mu) ** 2

    def residual(s):
        return power - np.exp(-d2 / (2 * s * s))

    cost = float((residual(sigma) ** 2).sum())
    for _ in range(200):
        model = np.exp(-d2 / (2 * sigma * sigma))
        slope = model * d2 / sigma**3
        if (curve := float(slope @ slope)) < 1e-300:
            break
        step = float(slope @ (power - model)) / curve
        scale = 1.0
        while scale > 1e-10:
            new = sigma + scale * step
            if new != 0 and (c := float((residual(new) ** 2).sum())) < cost:
                break
            scale /= 2
        else:
            break
        done = abs(new - sigma) < 1e-10 * max(1.0, abs(sigma))
        sigma, cost = new, c
        if done:
            break
    n = len(power)
    floor = max(cost, 1e-300)
    return {"sigma": abs(sigma), "chi2": cost, "redchi": cost / max(1, n - 1), "aic": n * np.log(floor / n) + 2, "bic": n * np.log(floor / n) + np.log(n)}


def peak_snr(power: np.ndarray, freqs: np.ndarray, centre: float, sigma: float) -> float:
    """Power within two sigma of the centre over the rest; 0 where there is hardly any rest."""
    near = (freqs >= centre - 2 * sigma) & (freqs <= centre + 2 * sigma)
    rest = power[~near].sum()
    return float(power[near].sum() / rest) if rest >= 1e-7 else 0.0


def snr_db(power: np.ndarray, freqs: np.ndarray, bpm: float | np.ndarray, tolerance: float = 12.0) -> np.ndarray:
    """10 log10 of the power around the rate (one, or a column of one for each row) and its double over the rest, by row."""
    near = (np.abs(freqs - bpm) <= tolerance) | (np.abs(freqs - 2 * bpm) <= tolerance)
    with np.errstate(divide="ignore", invalid="ignore"):
        return 10 * np.log10((power * near).sum(1) / (power * ~near).sum(1))


def psnr(a: np.ndarray, b: np.ndarray) -> float:
    return float(10 * np.log10(1 / np.mean((a - b) ** 2)))

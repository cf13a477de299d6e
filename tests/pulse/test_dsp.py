import numpy as np
import pytest

from sanguine.functions import bvp, circle, dsp


def sine(hz, fps=30.0, seconds=8.0, n=1):
    t = np.arange(int(fps * seconds)) / fps
    return np.tile(np.sin(2 * np.pi * hz * t), (n, 1))


@pytest.mark.parametrize("fps", [10, 20, 25, 29.97, 30, 35])
def test_butter_edges(fps):
    b, a = dsp.butter_bandpass(0.65, 4.0, fps, 6)
    gain = lambda f: abs(np.polyval(b, np.exp(2j * np.pi * f / fps)) / np.polyval(a, np.exp(2j * np.pi * f / fps)))
    assert len(b) == len(a) == 13
    assert abs(gain(0.65) - 0.5**0.5) < 1e-3 and abs(gain(4.0) - 0.5**0.5) < 1e-3 and abs(gain(1.6) - 1) < 1e-3


def test_filtfilt_keeps_the_band_without_delay():
    x = sine(1.5) + 5
    y = dsp.bandpass(x, 30)
    assert abs(y[:, 60:-60] - sine(1.5)[:, 60:-60]).max() < 0.05
    with pytest.raises(ValueError):
        dsp.bandpass(x[:, :39], 30)


@pytest.mark.parametrize("hz", [0.9, 1.2, 2.5, 3.3])
@pytest.mark.parametrize("overlap", [0.6, 0.8])
def test_welch_peak(hz, overlap):
    f, p = dsp.welch(sine(hz), 30, overlap=overlap)
    assert abs(f[p[0].argmax()] - 60 * hz) <= 60 * 30 / 2048
    assert f.min() > 39 and f.max() < 240


def test_detrend_and_savgol():
    t = np.linspace(0, 1, 240)
    assert abs(dsp.detrend((3 + 7 * t)[None])).max() < 1e-6
    poly = np.polyval([1, -2, 3, 0.5, -1, 2], t)[None]
    assert abs(poly - dsp.savgol(poly)).max() < 1e-9


def test_chirp_track():
    fs, t = 30.0, np.arange(1800) / 30.0
    hz = 1.0 + 0.5 * t / 60
    times, bpm = dsp.stft_track(np.sin(2 * np.pi * np.cumsum(hz) / fs), fs)
    inner = (times > 3) & (times < 57)
    assert abs(bpm[inner] - 60 * (1 + 0.5 * times[inner] / 60)).max() < 3


def test_r_peaks():
    fs, x = 250.0, np.zeros(5000)
    at = np.arange(100, 4900, 200)
    x[at] = 1
    x = np.convolve(x, np.hanning(15), "same")
    got = dsp.r_peaks(x, fs)
    assert len(got) == len(at) and abs(got - at).max() <= 2
    assert abs(dsp.heart_rate(got, fs)[1] - 75).max() < 2


def test_gauss_sigma():
    f = np.linspace(40, 240, 230)
    fit = dsp.gauss_sigma(np.exp(-((f - 72) ** 2) / (2 * 4.2**2)), f, 72)
    assert abs(fit["sigma"] - 4.2) < 1e-4 and fit["chi2"] < 1e-8


def skin(hz=1.2, fps=30.0, seconds=8.0, n=3, seed=0):
    rng = np.random.default_rng(seed)
    t = np.arange(int(fps * seconds)) / fps
    base, depth = np.array([120, 90, 70.0]), np.array([0.3, 0.8, 0.5])
    x = base[:, None] * (1 + depth[:, None] * 0.005 * np.sin(2 * np.pi * hz * t)) + rng.normal(0, 0.02, (n, 3, len(t)))
    return x


@pytest.mark.parametrize("name", list(bvp.METHODS))
def test_methods_find_the_pulse(name):
    x = skin()
    out = bvp.extract(name, x, 30.0, "all_comp")
    f, p = dsp.welch(dsp.bandpass(out, 30), 30)
    best = p.max(1).argmax() if name in ("PCA", "ICA") else None
    peaks = f[p.argmax(1)]
    assert abs(peaks - 72).min() < 1 if best is not None else (abs(peaks - 72) < 1).all()


def test_method_identities():
    x = skin(n=1)
    assert (bvp.green(x) == x[:, 1]).all()
    assert np.allclose(bvp.chrom(x * 7), 7 * bvp.chrom(x))
    u = x[0, :, 0] / np.linalg.norm(x[0, :, 0])
    whole = x[0] - np.outer(u, u @ x[0])
    assert np.allclose(bvp.omit(x)[0], whole[1]) and np.allclose(u @ whole, 0)
    left = np.linalg.svd(x[0], full_matrices=False)[0][:, 0]
    assert np.allclose(bvp.lgi(x)[0], (x[0] - np.outer(left, left @ x[0]))[1], atol=1e-8)
    assert np.isnan(bvp.chrom(np.ones((1, 3, 50)))).all()
    assert bvp.pos(x, 30)[0, 0] == 0
    slow, w = np.zeros(x.shape[2]), 48
    for n in range(w, x.shape[2]):
        c = x[0, :, n - w + 1 : n + 1]
        c = c / (c.mean(1, keepdims=True) + 1e-9)
        s1, s2 = c[1] - c[2], -2 * c[0] + c[1] + c[2]
        h = s1 + s1.std() / (s2.std() + 1e-9) * s2
        slow[n - w + 1 : n + 1] += h - h.mean()
    assert np.allclose(bvp.pos(x, 30)[0], slow)
    with pytest.raises(ValueError):
        bvp.plain_name("cpu_NOPE")
    assert bvp.plain_name("cupy_chrom") == "CHROM"


def test_jade_unmixes():
    rng = np.random.default_rng(3)
    t = np.arange(4000)
    s = np.stack([np.sign(np.sin(t / 17)), np.sin(t / 5.3), rng.laplace(size=4000)])
    a = np.array([[1, 0.4, 0.3], [0.2, 1, 0.5], [0.6, 0.1, 1]])
    x = a @ s
    got = bvp.jade(x) @ x
    match = abs(np.corrcoef(np.vstack((got, s)))[:3, 3:])
    assert (match.max(0) > 0.99).all() and (match.max(1) > 0.99).all()


def test_clustering_repeats_and_finds_the_pulse():
    x = np.vstack((sine(1.2, n=14), sine(2.5, n=6))) + np.random.default_rng(1).normal(0, 0.3, (20, 240))
    f, p = dsp.welch(x, 30)
    first = circle.estimate(p, f, seed=5)
    assert first == circle.estimate(p, f, seed=5)
    assert {round(first[1] / 6), round(first[2] / 6)} == {12, 25}
    assert circle.estimate(p[:0], f, 1) == (0.0, 0.0, 0.0)
    assert abs(circle.estimate(p[:1], f, 1)[0] - 72) < 1


def test_adjusted_sees_earlier_replacements():
    es = np.array([70.0, 71, 150, 72, 70, 71])
    assert circle.adjusted(es, es, np.where(es > 100, 73.0, 40.0), 3)[2] == 73
    assert circle.adjusted(es, np.zeros(6), np.zeros(6), 3)[2] == pytest.approx(np.median(es[:5]))


def test_tails_of_chi_square_and_range():
    import math

    from sanguine.operators import stats

    assert abs(stats.chi2_tail(3.841459, 1) - 0.05) < 1e-6
    assert abs(stats.chi2_tail(7.814728, 3) - 0.05) < 1e-6
    assert abs(stats.chi2_tail(9.487729, 4) - 0.05) < 1e-6
    for k, q in enumerate(stats.Q_05, 2):
        assert abs(stats.range_tail(q * math.sqrt(2), k) - 0.05) < 3e-4
    assert abs(stats._critical(11) - 3.219) < 2e-3

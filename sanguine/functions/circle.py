"""Bi-partition of spectra on a circle, and the vote between the two groups' peaks."""

from __future__ import annotations

import numpy as np

from .dsp import gauss_sigma, peak_snr


def cosine_distances(power: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(power, axis=1, keepdims=True)
    unit = np.divide(power, norm, out=np.zeros_like(power), where=norm > 0)
    d = np.clip(1 - unit @ unit.T, 0, None)
    np.fill_diagonal(d, 0)
    return d


def angles(w: np.ndarray, seed: int, eps: float = 0.01, most_rounds: int = 1000) -> np.ndarray:
    """An angle for each element, of distances w, so that distant ones come to lie opposite; coordinates are improved one at a time from a seeded start."""
    theta = np.random.default_rng(seed).random(len(w)) * 2 * np.pi
    pull = w @ np.exp(1j * theta)

    def turn(k: int, by: complex) -> None:
        pull[:] += w[k] * by

    return _settled(theta, lambda k: pull[k], turn, eps, most_rounds)


def angles_of(power: np.ndarray, seed: int, eps: float = 0.01, most_rounds: int = 1000) -> np.ndarray:
    """angles for the cosine distances of spectra (estimators, bins), without the table of distances: their sum over
    e^(i theta) follows from two sums over the estimators, of e^(i theta) and of unit spectrum x e^(i theta)."""
    theta = np.random.default_rng(seed).random(len(power)) * 2 * np.pi
    norm = np.linalg.norm(power, axis=1)
    scale = np.divide(1.0, norm, out=np.zeros_like(norm), where=norm > 0)
    own = (norm > 0).astype(float)  # a unit spectrum's product with itself
    at = np.exp(1j * theta)
    # cosine and sine parts side by side
    both = np.stack([(c * scale) @ power for c in (at.real, at.imag)], 1)
    sums = [at.sum()]

    def pull(k: int) -> complex:
        c = (power[k] @ both) * scale[k]
        return sums[0] - complex(c[0], c[1]) - (1 - own[k]) * at[k]

    def turn(k: int, by: complex) -> None:
        sums[0] += by
        at[k] += by
        both[:] += np.outer(power[k], (by.real * scale[k], by.imag * scale[k]))

    return _settled(theta, pull, turn, eps, most_rounds)


def _settled(theta: np.ndarray, pull, turn, eps: float, most_rounds: int) -> np.ndarray:
    for _ in range(most_rounds):
        still = True
        for k in range(len(theta)):
            new = np.angle(-pull(k)) % (2 * np.pi)
            if abs(new - theta[k]) > eps:
                turn(k, np.exp(1j * new) - np.exp(1j * theta[k]))
                still = False
            theta[k] = new
        if still:
            return theta
    raise RuntimeError(f"circle clustering did not settle in {most_rounds} rounds")


def partition(theta: np.ndarray, opt_factor: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Masks of the two sides of the mean angle, without members far from their side's most central one. A side may be empty."""
    side = np.sin(theta.mean() - theta) > 0
    out = []
    for mask in (side, ~side):
        idx = np.flatnonzero(mask)
        if len(idx) > 1:
            at = np.exp(1j * theta[idx])
            fit = ((at.conj() * at.sum()).real - 1) / (len(idx) - 1)  # mean cosine to the others
            idx = idx[(fit >= fit.max() - opt_factor * fit.std()) | (np.arange(len(idx)) == fit.argmax())]
        kept = np.zeros(len(theta), bool)
        kept[idx] = True
        out.append(kept)
    return out[0], out[1]


def _side(power: np.ndarray, mask: np.ndarray, freqs: np.ndarray, by_variance: bool) -> dict[str, float]:
    curve = power.sum(0, where=mask[:, None])
    curve = curve / curve.max() if curve.max() > 0 else curve
    peak = float(freqs[int(curve.argmax())])
    fit = gauss_sigma(curve, freqs, peak)
    snr = peak_snr(curve, freqs, peak, fit["sigma"]) / (fit["sigma"] ** 2 if by_variance else fit["sigma"])
    return fit | {"peak": peak, "snr": snr}


def _votes(a: dict, b: dict, median: float) -> tuple[float, float]:
    score = {"a": 0.0, "b": 0.0}

    def give(wins: bool, weight: float = 1.0) -> None:
        score["a" if wins else "b"] += weight

    if abs(a["sigma"] - b["sigma"]) > 0.1:
        low, high = sorted((a["sigma"], b["sigma"]))
        give(a["sigma"] < b["sigma"], max(1.0, high / low))
    if abs(a["chi2"] - b["chi2"]) > 0.1:
        give(a["chi2"] < b["chi2"])
    least = min(a["aic"], b["aic"])
    if least and -abs(a["aic"] - b["aic"]) / least > 0.1:
        give(a["aic"] < b["aic"])
    if abs(a["snr"] - b["snr"]) > 0.1:
        give(a["snr"] > b["snr"])
    give(abs(median - a["peak"]) < abs(median - b["peak"]))
    return score["a"], score["b"]


def estimate(power: np.ndarray, freqs: np.ndarray, seed: int, opt_factor: float = 0.5, by_variance: bool = True, few_by_maximum: bool = False, tie_by_snr: bool = True) -> tuple[float, float, float]:
    """(chosen rate, rates of the two groups) of one window's spectra (estimators, bins).

    Fewer than three estimators: the global maximum where few_by_maximum is set. With one group empty (or one estimator)
    the other group's peak stands for both. A tie of votes goes to the first group if its SNR per sigma is smaller, to the
    second where tie_by_snr isn't set.
    """
    if not len(power):
        return 0.0, 0.0, 0.0
    if len(power) == 1 or few_by_maximum and len(power) < 3:
        peak = float(freqs[np.unravel_index(power.argmax(), power.shape)[1]])
        return peak, peak, peak
    p, q = partition(angles_of(power, seed), opt_factor)
    if not p.any() or not q.any():
        one = _side(power, p | q, freqs, by_variance)["peak"]
        return one, one, one
    a, b = _side(power, p, freqs, by_variance), _side(power, q, freqs, by_variance)
    va, vb = _votes(a, b, float(np.median(freqs[power.argmax(1)])))
    first = va > vb or va == vb and tie_by_snr and a["snr"] / a["sigma"] < b["snr"] / b["sigma"]
    return (a if first else b)["peak"], a["peak"], b["peak"]


def adjusted(chosen: np.ndarray, first: np.ndarray, second: np.ndarray, reach: int, limit: float = 10.0) -> np.ndarray:
    """Rates far from the median around them are swapped for the losing group's if that is near, else for the median. Later rows see earlier replacements."""
    out = np.array(chosen, float)
    for k in range(len(out)):
        around = out[max(0, k - reach) : k + reach]
        med = np.median(around)
        room = limit + np.median(np.abs(around - med))
        if abs(out[k] - med) <= room:
            continue
        other = second[k] if abs(out[k] - first[k]) < 1e-8 else first[k] if abs(out[k] - second[k]) < 1e-8 else np.inf
        out[k] = other if abs(med - other) < room else med
    return out

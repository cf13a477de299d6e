"""Blood-volume-pulse methods in numpy: (estimators, 3, time) -> (outputs, time). Written from the methods' publications."""

from __future__ import annotations

from functools import lru_cache, partial

import numpy as np


def green(x: np.ndarray) -> np.ndarray:
    return x[:, 1].copy()


def chrom(x: np.ndarray) -> np.ndarray:
    """Chrominance (de Haan and Jeanne, 2013)."""
    r, g, b = x[:, 0], x[:, 1], x[:, 2]
    u, v = 3 * r - 2 * g, 1.5 * r + g - 1.5 * b
    s = v.std(1)
    return u - (u.std(1) / np.where(s == 0, np.nan, s))[:, None] * v


def pos(x: np.ndarray, fps: float, eps: float = 1e-9) -> np.ndarray:
    """Plane orthogonal to skin (Wang et al., 2016): windows of 1.6 s at every frame, overlap-added; frame 0 lies in none.

    Short signals go by their windows' moments, sums as products with one matrix; those that hardly change in some window, whose
    deviations moments don't give exactly, by the windows themselves.
    """
    n, w = x.shape[2], int(1.6 * fps)
    if not w < n <= 256:
        return _overlap_added(x, w, eps)
    out, exact = _by_moments(x, w, eps)
    if not exact.all():
        out[~exact] = _overlap_added(x[~exact], w, eps)
    return out


def _overlap_added(x: np.ndarray, w: int, eps: float) -> np.ndarray:
    n = x.shape[2]
    out = np.zeros((len(x), n))
    if n <= w:
        return out
    views = np.lib.stride_tricks.sliding_window_view(x[:, :, 1:], w, 2)  # (e, 3, ends, w)
    c = views / (views.mean(3, keepdims=True) + eps)
    s1, s2 = c[:, 1] - c[:, 2], -2 * c[:, 0] + c[:, 1] + c[:, 2]
    h = s1 + (s1.std(2) / (s2.std(2) + eps))[..., None] * s2
    h -= h.mean(2, keepdims=True)
    for k in range(w):
        out[:, 1 + k : 1 + k + h.shape[1]] += h[:, :, k]
    return out


@lru_cache(8)
def _inside(n: int, w: int) -> np.ndarray:
    """(n, windows): 1 where a sample lies in a window of w samples."""
    after = np.arange(n)[:, None] - np.arange(n - w + 1)
    return ((after >= 0) & (after < w)).astype(float)


def _by_moments(x: np.ndarray, w: int, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """(signals, are they exact)."""
    y = np.ascontiguousarray(x[:, :, 1:])
    inside = _inside(y.shape[2], w)
    sums = lambda z, by: (z.reshape(-1, z.shape[-1]) @ by).reshape(*z.shape[:-1], by.shape[1])  # noqa: E731 - one product, not one a signal
    m = sums(y, inside) / w
    d = m + eps
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        squares, k = sums(y * y, inside) / w, 1 / d
        kr, kg, kb = k[:, 0], k[:, 1], k[:, 2]
        rr, gg, bb = ((squares - m * m) * k * k).transpose(1, 0, 2)
        # with the next channel: rg, gb, br
        rg, gb, rb = ((sums(y * np.roll(y, -1, 1), inside) / w - m * np.roll(m, -1, 1)) * k * np.roll(k, -1, 1)).transpose(1, 0, 2)
        v1, v2 = gg + bb - 2 * gb, 4 * rr + gg + bb - 4 * rg - 4 * rb + 2 * gb
        # the products' own size, against which the variances are rounded
        size = 1e-6 * (1 + (squares * k * k).sum(1))
        exact = ((v1 > size) & (v2 > size)).all(1)
        a = np.sqrt(np.maximum(v1, 0)) / (np.sqrt(np.maximum(v2, 0)) + eps)
        weights = np.stack((-2 * a * kr, (1 + a) * kg, (a - 1) * kb), 1)
        out = np.zeros(x[:, 0].shape)
        out[:, 1:] = (sums(weights, inside.T) * y).sum(1) - (weights * m).sum(1) @ inside.T
    return out, exact


def _without_direction(x: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The green row of each signal after its component along the unit vector u is taken out."""
    return x[:, 1] - u[:, 1:2] * np.einsum("ec,ect->et", u, x)


def lgi(x: np.ndarray) -> np.ndarray:
    """Local group invariance (Pilz et al., 2018): the dominant direction of the uncentred signal is removed."""
    _, vectors = np.linalg.eigh(np.einsum("ect,edt->ecd", x, x))
    return _without_direction(x, vectors[:, :, -1])


def omit(x: np.ndarray) -> np.ndarray:
    """Orthogonal matrix image transformation (Casado and Lopez, 2022): the first sample's direction is removed."""
    first = x[:, :, 0]
    with np.errstate(divide="ignore", invalid="ignore"):
        return _without_direction(x, first / np.linalg.norm(first, axis=1, keepdims=True))


def pbv(x: np.ndarray) -> np.ndarray:
    """Blood-volume signature (de Haan and van Leest, 2014), by Cramer's rule; NaN where singular."""
    mean = x.mean(2, keepdims=True)
    c = x / np.where(mean == 0, np.nan, mean)
    s = c.std(2)
    norm = np.linalg.norm(s, axis=1, keepdims=True)
    p = s / np.where(norm == 0, np.nan, norm)
    q = c @ c.transpose(0, 2, 1)

    def det(m: np.ndarray) -> np.ndarray:
        return m[:, 0, 0] * (m[:, 1, 1] * m[:, 2, 2] - m[:, 1, 2] * m[:, 2, 1]) - m[:, 0, 1] * (m[:, 1, 0] * m[:, 2, 2] - m[:, 1, 2] * m[:, 2, 0]) + m[:, 0, 2] * (m[:, 1, 0] * m[:, 2, 1] - m[:, 1, 1] * m[:, 2, 0])

    whole = det(q)
    w = np.stack([det(np.where(np.arange(3) == j, p[:, :, None], q)) for j in range(3)], 1) / np.where(whole == 0, np.nan, whole)[:, None]
    scale = (p * w).sum(1, keepdims=True)
    return np.einsum("ec,ect->et", w / np.where(scale == 0, np.nan, scale), c)


def _chosen(rows: np.ndarray, component: str, of_all: int) -> np.ndarray:
    if component == "all_comp":
        return rows[:, :of_all].reshape(-1, rows.shape[-1])
    if component == "second_comp":
        return rows[:, 1]
    raise ValueError(f"component: all_comp or second_comp, not {component}")


def pca(x: np.ndarray, component: str = "second_comp") -> np.ndarray:
    """Principal components over the channels, scaled by their variance; the entry of largest size is positive."""
    d = x - x.mean(1, keepdims=True)
    _, s, v = np.linalg.svd(d, full_matrices=False)
    rows = v * (s**2 / (x.shape[1] - 1))[..., None]
    top = np.take_along_axis(rows, np.abs(rows).argmax(2)[..., None], 2)
    return _chosen(rows * np.where(top < 0, -1, 1), component, 2)


def _unmixing(x: np.ndarray, most_sweeps: int) -> np.ndarray:
    """jade for many mixtures (mixtures, channels, time) at once; those that have settled are turned no more."""
    n, m, t = x.shape
    y = x - x.mean(2, keepdims=True)
    values, vectors = np.linalg.eigh(y @ y.transpose(0, 2, 1) / t)
    white = vectors[:, :, ::-1].transpose(0, 2, 1) / np.sqrt(np.maximum(values[:, ::-1], 1e-300))[:, :, None]
    z = white @ y
    eye = np.eye(m)
    cumulants = []
    for p in range(m):
        for q in range(p + 1):
            k = (z * (z[:, p] * z[:, q])[:, None]) @ z.transpose(0, 2, 1) / t - np.outer(eye[p], eye[q]) - np.outer(eye[q], eye[p]) - eye * (p == q)
            cumulants.append(k if p == q else np.sqrt(2) * k)
    stack, rotation = np.stack(cumulants, 1), np.tile(eye, (n, 1, 1))
    open_ = np.arange(n)
    for _ in range(most_sweeps):
        turned = np.zeros(n, bool)
        for p in range(m - 1):
            for q in range(p + 1, m):
                d, o = stack[open_, :, p, p] - stack[open_, :, q, q], stack[open_, :, p, q] + stack[open_, :, q, p]
                on, off = (d * d).sum(1) - (o * o).sum(1), 2 * (d * o).sum(1)
                angle = 0.5 * np.arctan2(off, on + np.hypot(on, off))
                turn = np.abs(angle) > 1e-6 / np.sqrt(t)
                if not turn.any():
                    continue
                at, angle = open_[turn], angle[turn]
                turned[at] = True
                g = np.tile(eye, (len(at), 1, 1))
                g[:, p, p] = g[:, q, q] = np.cos(angle)
                g[:, p, q], g[:, q, p] = -np.sin(angle), np.sin(angle)
                stack[at], rotation[at] = g.transpose(0, 2, 1)[:, None] @ stack[at] @ g[:, None], rotation[at] @ g
        open_ = np.flatnonzero(turned)
        if not len(open_):
            break
    unmix = rotation.transpose(0, 2, 1) @ white
    order = np.argsort(-(np.linalg.pinv(unmix) ** 2).sum(1), 1, kind="stable")
    unmix = np.take_along_axis(unmix, order[:, :, None], 1)
    return unmix * np.where(unmix[:, :, :1] < 0, -1, 1)


def jade(x: np.ndarray, most_sweeps: int = 100) -> np.ndarray:
    """Unmixing matrix by joint approximate diagonalisation of fourth-order cumulants (Cardoso and Souloumiac, 1993)."""
    return _unmixing(x[None], most_sweeps)[0]


def ica(x: np.ndarray, component: str = "second_comp") -> np.ndarray:
    return _chosen(_unmixing(x, 100) @ x, component, 3)


def ssr(correlations: np.ndarray, fps: float) -> np.ndarray:
    """Spatial subspace rotation (Wang et al., 2015) from each frame's 3 x 3 correlation matrix of skin pixels."""
    n, l = len(correlations), int(fps)
    values, vectors = np.linalg.eigh(correlations)
    values, vectors = values[:, ::-1], vectors[:, :, ::-1]
    # eigenvectors have no sign of their own: each keeps to its predecessor's side
    for k in range(1, n):
        vectors[k] *= np.where((vectors[k] * vectors[k - 1]).sum(0) < 0, -1, 1)
    out = np.zeros(n)
    for k in range(l, n):
        tau = k - l
        lead = vectors[tau:k, :, 0]
        rotation = sum(np.sqrt(values[tau:k, 0] / max(values[tau, j], 1e-300))[:, None] * np.outer(lead @ vectors[tau, :, j], vectors[tau, :, j]) for j in (1, 2))
        s0, s1 = rotation[:, 0], rotation[:, 1]
        p = s0 - (s0.std() / s1.std() if s1.std() else 0.0) * s1
        out[tau:k] += p - p.mean()
    return out


#: name -> (function, does it take fps, does it take component)
METHODS = {"GREEN": (green, False, False), "CHROM": (chrom, False, False), "POS": (pos, True, False), "LGI": (lgi, False, False), "PBV": (pbv, False, False), "PCA": (pca, False, True), "OMIT": (omit, False, False), "ICA": (ica, False, True)}


def register(name: str, function, by_fps: bool = False, by_component: bool = False) -> None:
    """Adds a method under its name: function(x, fps=, component=) of traces [n, 3, frames] gives [n x outputs, frames].

    It takes the arguments it is registered for only. Nothing is loaded from paths; a task gets the function itself.
    """
    METHODS[name.upper()] = (function, by_fps, by_component)


def plain_name(name: str) -> str:
    """A method's name without its device prefix."""
    for prefix in ("cpu_", "cupy_", "torch_"):
        if name.lower().startswith(prefix):
            name = name[len(prefix) :]
    if name.upper() not in METHODS:
        raise ValueError(f"no such method: {name}; there are {', '.join(METHODS)}")
    return name.upper()


def method(name: str, fps: float, component: str = "second_comp"):
    """The method by name as a function of traces alone."""
    f, by_fps, by_component = METHODS[plain_name(name)]
    return partial(f, **{"fps": fps} if by_fps else {}, **{"component": component} if by_component else {})


def extract(name: str, x: np.ndarray, fps: float, component: str = "second_comp") -> np.ndarray:
    return method(name, fps, component)(x)

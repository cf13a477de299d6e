"""A character-level bidirectional LSTM with CRF transitions, trained and decoded in numpy.

Its squashing functions are rational, x / (1 + |x|) for tanh and half of that plus a half for the gates: numpy works them out
several times as fast, and every character of a corpus goes through them.
"""

from __future__ import annotations

import numpy as np

#: Printable ASCII and the line end have ids of their own; other letters, digits and the rest share three.
_ASCII = {c: k + 4 for k, c in enumerate([chr(c) for c in range(32, 127)] + ["\n"])}
PAD, LETTER, DIGIT, OTHER = range(4)
CHARS = 4 + len(_ASCII)
_IDS = np.full(0x110000, OTHER, np.uint8)
for _c, _k in _ASCII.items():
    _IDS[ord(_c)] = _k
for _c in range(128, 0x3000):
    if chr(_c).isalpha():
        _IDS[_c] = LETTER
    elif chr(_c).isdigit():
        _IDS[_c] = DIGIT


def char_ids(text: str) -> np.ndarray:
    return _IDS[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]


def _squash(x):
    return x / (1 + np.abs(x))


def _gate(x):
    return 0.5 + 0.5 * _squash(x)


def _slope(s):
    """The slope of _squash where its value is s."""
    return (1 - np.abs(s)) ** 2


class Tagger:
    """Tags 0 (outside), then 2k + 1 (begin) and 2k + 2 (inside) for each kind k. A window's padding is masked.

    least: by how much a span has to lead in `decode`, as calibrated on windows that have none.
    """

    least = -np.inf

    def __init__(self, kinds: int, embed: int = 12, hidden: int = 16, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.tags, self.hidden = 2 * kinds + 1, hidden
        w = lambda *shape: (rng.standard_normal(shape) * (1.0 / np.sqrt(shape[0]))).astype(np.float32)
        self.p = {"E": w(CHARS, embed) * 2, "O": w(2 * hidden, self.tags), "o": np.zeros(self.tags, np.float32), "T": np.zeros((self.tags, self.tags), np.float32)}
        for d in "fb":
            self.p |= {f"W{d}": w(embed, 4 * hidden), f"U{d}": w(hidden, 4 * hidden), f"b{d}": np.zeros(4 * hidden, np.float32)}
            self.p[f"b{d}"][hidden : 2 * hidden] = 1
        self.forbidden = np.zeros((self.tags, self.tags), bool)
        for k in range(kinds):
            self.forbidden[:, 2 * k + 2] = True
            self.forbidden[[2 * k + 1, 2 * k + 2], 2 * k + 2] = False

    def _lstm(self, x: np.ndarray, d: str, keep: bool):
        """x: (time, batch, embed), already in the direction's order; the states are gone where the input is padding."""
        n, b, _ = x.shape
        h, c = np.zeros((b, self.hidden), np.float32), np.zeros((b, self.hidden), np.float32)
        out = np.empty((n, b, self.hidden), np.float32)
        z = x @ self.p[f"W{d}"] + self.p[f"b{d}"]
        trace, u, s = [], self.p[f"U{d}"], self.hidden
        for t in range(n):
            g = z[t] + h @ u
            i, f, o, a = _gate(g[:, :s]), _gate(g[:, s : 2 * s]), _gate(g[:, 2 * s : 3 * s]), _squash(g[:, 3 * s :])
            before = c
            c = f * c + i * a
            tc = _squash(c)
            if keep:
                trace.append((h, before, i, f, o, a, tc))
            h = o * tc
            out[t] = h
        return out, trace

    def _lstm_back(self, x, d, trace, grad, out):
        u, s = self.p[f"U{d}"], self.hidden
        dh, dc = np.zeros_like(grad[0]), np.zeros_like(grad[0])
        dz = np.empty((*grad.shape[:2], 4 * s), np.float32)
        for t in range(len(grad) - 1, -1, -1):
            h, before, i, f, o, a, tc = trace[t]
            dh = dh + grad[t]
            dc = dc + dh * o * _slope(tc)
            dz[t] = np.concatenate((dc * a * 0.5 * _slope(2 * i - 1), dc * before * 0.5 * _slope(2 * f - 1), dh * tc * 0.5 * _slope(2 * o - 1), dc * i * _slope(a)), 1)
            out[f"U{d}"] += h.T @ dz[t]
            dh, dc = dz[t] @ u.T, dc * f
        flat = dz.reshape(-1, 4 * s)
        out[f"W{d}"] += x.reshape(-1, x.shape[-1]).T @ flat
        out[f"b{d}"] += flat.sum(0)
        return dz @ self.p[f"W{d}"].T

    def scores(self, ids: np.ndarray, keep: bool = False):
        """Emission scores (time, batch, tags) of windows (batch, time)."""
        x = self.p["E"][ids.T] * (ids.T != PAD)[..., None]
        hf, tf = self._lstm(x, "f", keep)
        hb, tb = self._lstm(x[::-1], "b", keep)
        h = np.concatenate((hf, hb[::-1]), 2)
        return h @ self.p["O"] + self.p["o"], (x, h, tf, tb)

    def _transitions(self):
        return np.where(self.forbidden, np.float32(-1e4), self.p["T"])

    def step(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
        """Mean negative log likelihood of the tags and the parameters' gradients."""
        e, (x, h, tf, tb) = self.scores(ids, keep=True)
        n, b, k = e.shape
        real = (ids.T != PAD).astype(np.float32)
        tr = self._transitions()
        start = np.where(self.forbidden[0], np.float32(-1e4), 0)
        alpha = np.empty_like(e)
        alpha[0] = e[0] + start
        for t in range(1, n):
            m = alpha[t - 1][:, :, None] + tr
            top = m.max(1)
            new = top + np.log(np.exp(m - top[:, None]).sum(1)) + e[t]
            alpha[t] = np.where(real[t][:, None] > 0, new, alpha[t - 1])
        top = alpha[-1].max(1)
        log_z = top + np.log(np.exp(alpha[-1] - top[:, None]).sum(1))
        beta = np.zeros_like(e)
        for t in range(n - 2, -1, -1):
            m = tr + (e[t + 1] + beta[t + 1])[:, None, :]
            top = m.max(2)
            new = top + np.log(np.exp(m - top[:, :, None]).sum(2))
            beta[t] = np.where(real[t + 1][:, None] > 0, new, beta[t + 1])
        de = np.exp(alpha + beta - log_z[None, :, None]) * real[..., None]
        gold = tags.T
        rows = np.arange(b)
        dt = np.zeros_like(tr)
        score = e[0, rows, gold[0]]
        for t in range(n):
            de[t, rows, gold[t]] -= real[t]
            if t:
                pair = np.exp(alpha[t - 1][:, :, None] + tr + (e[t] + beta[t])[:, None, :] - log_z[:, None, None]) * real[t][:, None, None]
                dt += pair.sum(0)
                np.subtract.at(dt, (gold[t - 1], gold[t]), real[t])
                score = score + (e[t, rows, gold[t]] + tr[gold[t - 1], gold[t]]) * real[t]
        de /= b
        out = {q: np.zeros_like(v) for q, v in self.p.items()}
        out["T"] = np.where(self.forbidden, 0, dt / b).astype(np.float32)
        out["O"], out["o"] = np.tensordot(h, de, ((0, 1), (0, 1))), de.sum((0, 1))
        dh = de @ self.p["O"].T
        dx = self._lstm_back(x, "f", tf, dh[..., : self.hidden], out) + self._lstm_back(x[::-1], "b", tb, dh[::-1, :, self.hidden :], out)[::-1]
        np.add.at(out["E"], ids.T, dx * real[..., None])
        return float((log_z - score).mean()), out

    def fit(self, ids: np.ndarray, tags: np.ndarray, epochs: int = 8, batch: int = 128, rate: float = 0.02, seed: int = 3) -> list[float]:
        """Adam over shuffled batches; the mean loss of each epoch."""
        rng = np.random.default_rng(seed)
        m, v, t, losses = ({q: np.zeros_like(x) for q, x in self.p.items()} for _ in range(2)), None, 0, []
        m, v = m
        for _ in range(epochs):
            total = 0.0
            order = rng.permutation(len(ids))
            for k in range(0, len(order), batch):
                rows = order[k : k + batch]
                loss, grad = self.step(ids[rows], tags[rows])
                total += loss * len(rows)
                t += 1
                norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
                for q, g in grad.items():
                    g = g * min(1.0, 5.0 / (norm + 1e-9))
                    m[q] = 0.9 * m[q] + 0.1 * g
                    v[q] = 0.999 * v[q] + 0.001 * g * g
                    self.p[q] = (self.p[q] - rate * (m[q] / (1 - 0.9**t)) / (np.sqrt(v[q] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
            losses.append(total / max(1, len(ids)))
        return losses

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        """The same scores as `scores`, for many windows: characters' input terms come from a table, states are kept in place."""
        p, size, steps = self.p, self.hidden, ids.T.astype(np.intp)
        n, b = steps.shape
        known = (np.arange(CHARS) != PAD)[:, None]
        out = np.empty((n, b, self.tags), np.float32)
        hs, x = np.empty((n, b, size), np.float32), np.empty((b, 4 * size), np.float32)
        for d in "fb":
            table = ((p["E"] * known) @ p[f"W{d}"] + p[f"b{d}"]).astype(np.float32)
            u = p[f"U{d}"]
            g = np.empty((b, 4 * size), np.float32)
            gt = np.empty((4 * size, b), np.float32)
            i, f, o, a = (gt[k * size : (k + 1) * size] for k in range(4))
            gates, size_of = gt[: 3 * size], np.empty((4 * size, b), np.float32)
            h, c, tc = np.zeros((b, size), np.float32), np.zeros((size, b), np.float32), np.empty((size, b), np.float32)
            for t in range(n) if d == "f" else range(n - 1, -1, -1):
                np.matmul(h, u, out=g)
                np.take(table, steps[t], axis=0, out=x, mode="clip")
                g += x
                np.copyto(gt, g.T)
                np.abs(gt, out=size_of)
                size_of += 1
                gt /= size_of
                gates *= 0.5
                gates += 0.5
                c *= f
                a *= i
                c += a
                np.abs(c, out=tc)
                tc += 1
                np.divide(c, tc, out=tc)
                tc *= o
                h = hs[t]
                h[:] = tc.T
            part = (hs.reshape(-1, size) @ (p["O"][:size] if d == "f" else p["O"][size:])).reshape(out.shape)
            if d == "f":
                out[:] = part
            else:
                out += part
        out += p["o"]
        out[steps == PAD, 1:] = -1e4
        return out

    def _may_tag(self, e: np.ndarray) -> np.ndarray:
        """Windows in which a span leads the path that leaves it outside; in all others that path is the best for certain.

        Of each kind the best lead of a span that ends at each place is followed, as if it stood alone: the spans of a path
        that leads in all would have to have one among them that does.
        """
        tr, to = self._transitions(), self.p["T"][0, 0]
        first = e[..., 1::2] - e[..., :1] + (np.maximum(tr[:, 1::2].max(0), to) - to)
        then = e[..., 2::2] - e[..., :1] + (np.maximum(np.diagonal(tr[1::2, 2::2]), np.diagonal(tr[2::2, 2::2])) - to)
        leave = np.maximum(0, np.maximum(tr[1::2, 0], tr[2::2, 0]) - to)
        lead = first[0].copy()
        top = lead.copy()
        for t in range(1, len(e)):
            lead += then[t]
            np.maximum(lead, first[t], out=lead)
            np.maximum(top, lead, out=top)
        return (top + leave > 0).any(1)

    def viterbi(self, e: np.ndarray) -> np.ndarray:
        """The best path (batch, time) for scores (time, batch, tags)."""
        n, b, k = e.shape
        tr = self._transitions()
        best, back = e[0] + np.where(self.forbidden[0], np.float32(-1e4), 0), np.empty((n, b, k), np.int8)
        for t in range(1, n):
            m = best[:, :, None] + tr
            back[t] = m.argmax(1)
            best = m.max(1) + e[t]
        out = np.empty((n, b), np.int64)
        out[-1] = best.argmax(1)
        rows = np.arange(b)
        for t in range(n - 1, 0, -1):
            out[t - 1] = back[t, rows, out[t]]
        return out.T

    def margins(self, e: np.ndarray, tags: np.ndarray):
        """(window, first, end, lead) of each span of tags (batch, time): by how much its path leads the same one with the span left outside."""
        tr = self._transitions()
        for w in np.flatnonzero(tags.any(1)):
            row = tags[w]
            starts = np.flatnonzero(row % 2 == 1)
            for a in starts.tolist():
                end = a + 1
                while end < len(row) and row[end] == row[a] + 1:
                    end += 1
                lead = float((e[np.arange(a, end), w, row[a:end]] - e[a:end, w, 0]).sum())
                if a:
                    lead += tr[row[a - 1], row[a]] - tr[row[a - 1], 0]
                lead += float(tr[row[a : end - 1], row[a + 1 : end]].sum()) - tr[0, 0] * (end - a - 1)
                if end < len(row):
                    lead += tr[row[end - 1], row[end]] - tr[0, row[end]]
                yield int(w), a, end, lead

    def decode(self, ids: np.ndarray, least: float = -np.inf) -> np.ndarray:
        """The best tags (batch, time) of windows (batch, time) by Viterbi; padding is outside, as are spans that lead by less than `least`."""
        e = self.emissions(ids)
        some = np.flatnonzero(self._may_tag(e))
        out = np.zeros(ids.shape, np.int8)
        if len(some):
            e = e[:, some]
            tags = np.where(ids[some] == PAD, 0, self.viterbi(e))
            if least > -np.inf:
                for w, a, end, lead in list(self.margins(e, tags)):
                    if lead < least:
                        tags[w, a:end] = 0
            out[some] = tags
        return out

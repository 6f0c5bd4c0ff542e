"""Character tagger: bidirectional LSTM with CRF transitions, in numpy.

Windows of characters are tagged begin/inside for each kind, or outside.  Training
maximises the conditional log-likelihood of the labelled tag sequences (forward and
backward passes of the CRF, backpropagation through both LSTMs, Adam).
"""

from __future__ import annotations

import numpy as np

SYMBOLS = 100  # printable ASCII, line end, letter beyond ASCII, other, padding


def codes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.int64)
    out = np.where((raw >= 32) & (raw < 127), raw - 32, 96)
    out[(raw == 10) | (raw == 13)] = 95
    out[raw >= 192] = 97
    return out


PAD = 99


class Tagger:
    def __init__(self, tags: int, embed: int = 12, hidden: int = 16, seed: int = 7):
        rng = np.random.default_rng(seed)
        scale = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.hidden, self.tags = hidden, tags
        self.p = {"E": scale(SYMBOLS, embed), "A": np.zeros((tags, tags), np.float32), "S": np.zeros(tags, np.float32), "O": scale(2 * hidden, tags), "o": np.zeros(tags, np.float32)}
        for d in "fb":
            self.p |= {f"W{d}": scale(embed, 4 * hidden), f"U{d}": scale(hidden, 4 * hidden), f"c{d}": np.zeros(4 * hidden, np.float32)}

    def _lstm(self, x: np.ndarray, d: str, keep: bool):
        """x: time, batch, embed; hidden states of one direction (and what backward needs)."""
        n, b, _ = x.shape
        h = self.hidden
        pre, u = x @ self.p[f"W{d}"] + self.p[f"c{d}"], self.p[f"U{d}"]
        state, cell = np.zeros((b, h), np.float32), np.zeros((b, h), np.float32)
        out, saved = np.empty((n, b, h), np.float32), []
        for t in range(n) if d == "f" else range(n - 1, -1, -1):
            z = pre[t] + state @ u
            gate = 1 / (1 + np.exp(-z[:, : 3 * h]))
            new = np.tanh(z[:, 3 * h :])
            i, f, o = gate[:, :h], gate[:, h : 2 * h], gate[:, 2 * h :]
            last, before = cell, state
            cell = f * last + i * new
            squashed = np.tanh(cell)
            state = o * squashed
            out[t] = state
            if keep:
                saved.append((t, i, f, o, new, last, squashed, before))
        return out, saved

    def emissions(self, x: np.ndarray, keep: bool = False):
        """x: batch, time of codes -> time, batch, tags."""
        e = self.p["E"][x.T]
        forward, sf = self._lstm(e, "f", keep)
        backward, sb = self._lstm(e, "b", keep)
        both = np.concatenate([forward, backward], axis=2)
        return both @ self.p["O"] + self.p["o"], (e, both, sf, sb)

    def _crf(self, em: np.ndarray, y: np.ndarray):
        """Mean negative log-likelihood and gradients of emissions, transitions and starts."""
        n, b, k = em.shape
        a, s = self.p["A"], self.p["S"]
        alpha, beta = np.empty_like(em), np.zeros_like(em)
        alpha[0] = s + em[0]
        for t in range(1, n):
            m = alpha[t - 1][:, :, None] + a[None]
            top = m.max(axis=1)
            alpha[t] = em[t] + top + np.log(np.exp(m - top[:, None, :]).sum(axis=1))
        for t in range(n - 2, -1, -1):
            m = a[None] + (em[t + 1] + beta[t + 1])[:, None, :]
            top = m.max(axis=2)
            beta[t] = top + np.log(np.exp(m - top[:, :, None]).sum(axis=2))
        top = alpha[-1].max(axis=1)
        z = top + np.log(np.exp(alpha[-1] - top[:, None]).sum(axis=1))
        marginal = np.exp(alpha + beta - z[None, :, None])
        rows = np.arange(b)
        gold = s[y[:, 0]] + em[0, rows, y[:, 0]]
        d_em, d_a, d_s = marginal.copy(), np.zeros_like(a), marginal[0].sum(axis=0)
        d_em[0, rows, y[:, 0]] -= 1
        np.add.at(d_s, y[:, 0], -1)
        for t in range(1, n):
            gold += a[y[:, t - 1], y[:, t]] + em[t, rows, y[:, t]]
            d_em[t, rows, y[:, t]] -= 1
            pair = np.exp(alpha[t - 1][:, :, None] + a[None] + (em[t] + beta[t])[:, None, :] - z[:, None, None])
            d_a += pair.sum(axis=0)
            np.add.at(d_a, (y[:, t - 1], y[:, t]), -1)
        return (z - gold).mean(), d_em / b, d_a / b, d_s / b

    def _back(self, d_out: np.ndarray, e: np.ndarray, saved, d: str, g: dict) -> np.ndarray:
        h, u = self.hidden, self.p[f"U{d}"]
        d_pre = np.zeros((*e.shape[:2], 4 * h), np.float32)
        d_state, d_cell = np.zeros_like(d_out[0]), np.zeros_like(d_out[0])
        g[f"U{d}"] = np.zeros_like(u)
        for t, i, f, o, new, last, squashed, before in reversed(saved):
            d_h = d_out[t] + d_state
            d_c = d_cell + d_h * o * (1 - squashed**2)
            dz = np.concatenate([d_c * new * i * (1 - i), d_c * last * f * (1 - f), d_h * squashed * o * (1 - o), d_c * i * (1 - new**2)], axis=1)
            d_pre[t] = dz
            g[f"U{d}"] += before.T @ dz
            d_state, d_cell = dz @ u.T, d_c * f
        g[f"W{d}"] = np.einsum("tbe,tbh->eh", e, d_pre)
        g[f"c{d}"] = d_pre.sum(axis=(0, 1))
        return d_pre @ self.p[f"W{d}"].T

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int, batch: int = 64, rate: float = 0.01, seed: int = 7) -> list[float]:
        rng, losses = np.random.default_rng(seed), []
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        step = 0
        for _ in range(epochs):
            order, total = rng.permutation(len(x)), 0.0
            for at in range(0, len(x), batch):
                rows = order[at : at + batch]
                em, (e, both, sf, sb) = self.emissions(x[rows], keep=True)
                loss, d_em, d_a, d_s = self._crf(em, y[rows])
                g = {"A": d_a, "S": d_s, "O": np.einsum("tbh,tbk->hk", both, d_em), "o": d_em.sum(axis=(0, 1))}
                d_both = d_em @ self.p["O"].T
                d_e = self._back(d_both[:, :, : self.hidden], e, sf, "f", g) + self._back(d_both[:, :, self.hidden :], e, sb, "b", g)
                g["E"] = np.zeros_like(self.p["E"])
                np.add.at(g["E"], x[rows].T, d_e)
                norm = np.sqrt(sum(float((q**2).sum()) for q in g.values()))
                step += 1
                for k, q in g.items():
                    q = q * min(1.0, 5.0 / (norm + 1e-9))
                    m[k] = 0.9 * m[k] + 0.1 * q
                    v[k] = 0.999 * v[k] + 0.001 * q * q
                    self.p[k] = (self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
                total += float(loss) * len(rows)
            losses.append(total / len(x))
        return losses

    def decode(self, em: np.ndarray) -> np.ndarray:
        """Best tag sequence of emissions (time, tags)."""
        n, a = len(em), self.p["A"]
        score, back = self.p["S"] + em[0], np.empty((n, self.tags), np.int64)
        for t in range(1, n):
            m = score[:, None] + a
            back[t] = m.argmax(axis=0)
            score = m[back[t], np.arange(self.tags)] + em[t]
        out = np.empty(n, np.int64)
        out[-1] = score.argmax()
        for t in range(n - 1, 0, -1):
            out[t - 1] = back[t, out[t]]
        return out

"""A character-level bidirectional LSTM with CRF transitions in numpy: training on labelled windows and decoding."""

from __future__ import annotations

import numpy as np

PAD = 0
_OTHER_LETTER, _OTHER = 96, 97
N_CHARS = 98


def char_ids(text: str) -> np.ndarray:
    """Printable ASCII one by one; other letters, and everything else, as one class each."""
    code = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.int64)
    out = np.where((code >= 32) & (code < 127), code - 31, _OTHER)
    far = code >= 127
    if far.any():
        out[far] = [_OTHER_LETTER if chr(c).isalpha() else _OTHER for c in code[far].tolist()]
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - m).sum(axis=axis)) + m.squeeze(axis)


class Tagger:
    """Tag scores by position (emissions) and by neighbouring tags (transitions)."""

    def __init__(self, n_tags: int, embed: int = 12, hidden: int = 20, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        w = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.h = hidden
        self.p = {"emb": w(N_CHARS, embed) * 3, "out": w(2 * hidden, n_tags), "ob": np.zeros(n_tags, np.float32), "tr": np.zeros((n_tags, n_tags), np.float32)}
        for d in "fb":
            self.p |= {f"w{d}": w(embed, 4 * hidden), f"u{d}": w(hidden, 4 * hidden), f"b{d}": np.zeros(4 * hidden, np.float32)}
            self.p[f"b{d}"][hidden : 2 * hidden] = 1

    def _run(self, e: np.ndarray, d: str, save: bool = False) -> tuple[np.ndarray, list]:
        """Hidden states in one direction, and what `_back` needs of every step if it is to be saved."""
        n, steps, _ = e.shape
        h = c = np.zeros((n, self.h), np.float32)
        x = e @ self.p[f"w{d}"] + self.p[f"b{d}"]
        out, saved = np.empty((n, steps, self.h), np.float32), []
        for t in range(steps):
            z = x[:, t] + h @ self.p[f"u{d}"]
            s, g = _sigmoid(z[:, : 3 * self.h]), np.tanh(z[:, 3 * self.h :])
            i, f, o = s[:, : self.h], s[:, self.h : 2 * self.h], s[:, 2 * self.h :]
            before, old = c, h
            c = f * c + i * g
            tc = np.tanh(c)
            h = out[:, t] = o * tc
            if save:
                saved.append((i, f, o, g, before, tc, old))
        return out, saved

    def _back(self, e: np.ndarray, d: str, dh_all: np.ndarray, saved: list, grad: dict) -> np.ndarray:
        n, steps, _ = e.shape
        dz = np.empty((n, steps, 4 * self.h), np.float32)
        dh = dc = np.zeros((n, self.h), np.float32)
        for t in range(steps - 1, -1, -1):
            i, f, o, g, before, tc, old = saved[t]
            dh = dh + dh_all[:, t]
            dc = dc + dh * o * (1 - tc * tc)
            dz[:, t] = np.hstack([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)])
            grad[f"u{d}"] += old.T @ dz[:, t]
            dh, dc = dz[:, t] @ self.p[f"u{d}"].T, dc * f
        flat = dz.reshape(-1, 4 * self.h)
        grad[f"w{d}"] += e.reshape(-1, e.shape[2]).T @ flat
        grad[f"b{d}"] += flat.sum(0)
        return dz @ self.p[f"w{d}"].T

    def emissions(self, x: np.ndarray) -> np.ndarray:
        e = self.p["emb"][x]
        both = np.concatenate([self._run(e, "f")[0], self._run(e[:, ::-1], "b")[0][:, ::-1]], axis=2)
        return both @ self.p["out"] + self.p["ob"]

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of tags y over windows x, and its gradients."""
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        e = self.p["emb"][x]
        (hf, sf), (hb, sb) = self._run(e, "f", True), self._run(e[:, ::-1], "b", True)
        both = np.concatenate([hf, hb[:, ::-1]], axis=2)
        em, tr = both @ self.p["out"] + self.p["ob"], self.p["tr"]
        n, steps, k = em.shape
        alpha, beta = np.empty_like(em), np.zeros_like(em)
        alpha[:, 0] = em[:, 0]
        for t in range(1, steps):
            alpha[:, t] = _lse(alpha[:, t - 1, :, None] + tr, 1) + em[:, t]
        for t in range(steps - 2, -1, -1):
            beta[:, t] = _lse(tr + (em[:, t + 1] + beta[:, t + 1])[:, None], 2)
        z = _lse(alpha[:, -1], 1)
        marginal = np.exp(alpha + beta - z[:, None, None])
        gold = em[np.arange(n)[:, None], np.arange(steps), y].sum(1) + tr[y[:, :-1], y[:, 1:]].sum(1)
        pair = np.exp(alpha[:, :-1, :, None] + tr + (em[:, 1:] + beta[:, 1:])[:, :, None] - z[:, None, None, None]).sum((0, 1))
        np.subtract.at(pair, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
        grad["tr"] = (pair / n).astype(np.float32)
        marginal[np.arange(n)[:, None], np.arange(steps), y] -= 1
        dem = (marginal / n).astype(np.float32)
        grad["out"] = both.reshape(-1, 2 * self.h).T @ dem.reshape(-1, k)
        grad["ob"] = dem.sum((0, 1))
        dboth = dem @ self.p["out"].T
        de = self._back(e, "f", dboth[:, :, : self.h], sf, grad)
        de = de + self._back(e[:, ::-1], "b", dboth[:, ::-1, self.h :], sb, grad)[:, ::-1]
        np.add.at(grad["emb"], x.ravel(), de.reshape(-1, de.shape[2]))
        return float((z - gold).mean()), grad

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 36, rate: float = 0.02, seed: int = 6) -> list[float]:
        """Adam over shuffled batches; the mean loss of each epoch."""
        rng, step, losses = np.random.default_rng(seed), 0, []
        m, v = ({k: np.zeros_like(p) for k, p in self.p.items()} for _ in range(2))
        for epoch in range(epochs):
            total, order = 0.0, rng.permutation(len(x))
            for at in range(0, len(x), batch):
                pick = order[at : at + batch]
                loss, grad = self.gradients(x[pick], y[pick])
                total += loss * len(pick)
                step += 1
                lr = rate * 0.75**epoch * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for k, g in grad.items():
                    g = np.clip(g, -1, 1)
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.001 * (g * g - v[k])
                    self.p[k] -= (lr * m[k] / (np.sqrt(v[k]) + 1e-8)).astype(np.float32)
            losses.append(total / len(x))
        return losses

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tags, emissions) of the best path through each window."""
        em, tr = self.emissions(x), self.p["tr"]
        n, steps, _ = em.shape
        best, from_ = em[:, 0], np.empty(em.shape, dtype=np.int8)
        for t in range(1, steps):
            s = best[:, :, None] + tr
            from_[:, t] = s.argmax(1)
            best = s.max(1) + em[:, t]
        tags = np.empty((n, steps), dtype=np.int8)
        tags[:, -1] = best.argmax(1)
        for t in range(steps - 1, 0, -1):
            tags[:, t - 1] = from_[np.arange(n), t, tags[:, t]]
        return tags, em

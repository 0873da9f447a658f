"""A character-level bidirectional LSTM with CRF transitions, in numpy: training, and decoding of many windows at once."""
from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

CLASSES = 98


def classes(codes: np.ndarray) -> np.ndarray:
    """Code points to input classes: printable ASCII one by one, other white space, everything else."""
    return np.where((codes >= 32) & (codes < 127), codes - 32, np.where(codes < 32, 95, 96)).astype(np.int64)


PAD = 97


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


@dataclass
class Tagger:
    """Parameters by name; ``f`` and ``b`` are the two directions. Tag 0 is "no entity"."""
    p: dict[str, np.ndarray] = field(default_factory=dict)

    @staticmethod
    def new(tags: int, hidden: int, seed: int) -> Tagger:
        r = np.random.default_rng(seed)
        p = {"trans": np.zeros((tags, tags)), "bias": np.zeros(tags)}
        for d in "fb":
            p[f"x{d}"] = r.normal(0, 0.3, (CLASSES, 4 * hidden))
            p[f"x{d}"][:, hidden:2 * hidden] += 1  # gates that forget start open
            p[f"h{d}"] = r.normal(0, hidden ** -0.5, (hidden, 4 * hidden))
            p[f"v{d}"] = r.normal(0, hidden ** -0.5, (hidden, tags))
        return Tagger({k: v.astype(np.float32) for k, v in p.items()})

    def _run(self, ids: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """States of one direction over ids (time x windows), and what the gradient needs."""
        steps, n = ids.shape
        size = self.p[f"h{d}"].shape[0]
        h, c = np.zeros((n, size), np.float32), np.zeros((n, size), np.float32)
        out, kept = np.zeros((steps, n, size), np.float32), [None] * steps
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = self.p[f"x{d}"][ids[t]] + h @ self.p[f"h{d}"]
            gates = _sigmoid(z[:, :3 * size])
            i, f, o = gates[:, :size], gates[:, size:2 * size], gates[:, 2 * size:]
            g = np.tanh(z[:, 3 * size:])
            before, c = (h, c), f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            out[t] = h
            if keep:
                kept[t] = (i, f, o, g, tc, *before)
        return out, kept

    def scores(self, ids: np.ndarray, keep: bool = False):
        f, b = self._run(ids, "f", keep), self._run(ids, "b", keep)
        return f[0] @ self.p["vf"] + b[0] @ self.p["vb"] + self.p["bias"], f, b

    def decode(self, windows: np.ndarray) -> np.ndarray:
        """Best tag path of every window (windows x time)."""
        e, _, _ = self.scores(windows.T)
        back = np.zeros(e.shape, np.int8)
        best = e[0]
        for t in range(1, len(e)):
            every = best[:, :, None] + self.p["trans"]
            back[t] = every.argmax(axis=1)
            best = every.max(axis=1) + e[t]
        path = np.zeros(e.shape[:2], np.int8)
        path[-1] = best.argmax(axis=1)
        for t in range(len(e) - 1, 0, -1):
            path[t - 1] = np.take_along_axis(back[t], path[t][:, None].astype(np.int64), 1)[:, 0]
        return path.T

    def gradient(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of the tag paths (time x windows each) and its gradient."""
        e, (hf, kf), (hb, kb) = self.scores(ids, keep=True)
        steps, n, k = e.shape
        trans = self.p["trans"]

        def lse(x: np.ndarray, axis: int) -> np.ndarray:
            top = x.max(axis=axis, keepdims=True)
            return (np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)
        alpha, beta = e.copy(), np.zeros_like(e)
        for t in range(1, steps):
            alpha[t] += lse(alpha[t - 1][:, :, None] + trans, 1)
        for t in range(steps - 2, -1, -1):
            beta[t] = lse(trans + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        z = lse(alpha[-1], 1)
        de = np.exp(alpha + beta - z[None, :, None])
        gold = np.take_along_axis(e, tags[:, :, None], 2).sum() + trans[tags[:-1], tags[1:]].sum()
        dtrans = np.zeros_like(trans)
        for t in range(1, steps):
            dtrans += np.exp(alpha[t - 1][:, :, None] + trans + (e[t] + beta[t])[:, None, :] - z[:, None, None]).sum(axis=0)
        np.subtract.at(dtrans, (tags[:-1], tags[1:]), 1)
        de[np.arange(steps)[:, None], np.arange(n), tags] -= 1
        de /= n
        g = {"trans": dtrans / n, "bias": de.sum(axis=(0, 1))}
        for d, h, kept in (("f", hf, kf), ("b", hb, kb)):
            g[f"v{d}"] = np.einsum("tnh,tnk->hk", h, de)
            dh_all = de @ self.p[f"v{d}"].T
            dx, dw = np.zeros_like(self.p[f"x{d}"]), np.zeros_like(self.p[f"h{d}"])
            dh, dc = np.zeros_like(h[0]), np.zeros_like(h[0])
            for t in range(steps - 1, -1, -1) if d == "f" else range(steps):
                i, f, o, c_in, tc, h0, c0 = kept[t]
                dh = dh + dh_all[t]
                dc = dc + dh * o * (1 - tc * tc)
                dz = np.concatenate([dc * c_in * i * (1 - i), dc * c0 * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - c_in * c_in)], axis=1)
                np.add.at(dx, ids[t], dz)
                dw += h0.T @ dz
                dh, dc = dz @ self.p[f"h{d}"].T, dc * f
            g[f"x{d}"], g[f"h{d}"] = dx, dw
        return float((z.sum() - gold) / n), g


def train(windows: np.ndarray, tags: np.ndarray, kinds: int, hidden: int = 16, steps: int = 150, batch: int = 64, seed: int = 7) -> Tagger:
    """Fits by Adam on random batches; the same input gives the same model."""
    model = Tagger.new(kinds, hidden, seed)
    r = np.random.default_rng(seed)
    m, v = ({k: np.zeros_like(x) for k, x in model.p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        pick = r.integers(0, len(windows), min(batch, len(windows)))
        _, g = model.gradient(np.ascontiguousarray(windows[pick].T), np.ascontiguousarray(tags[pick].T))
        norm = max(1.0, float(np.sqrt(sum((x * x).sum() for x in g.values()))) / 5)
        for k, x in g.items():
            x = x / norm
            m[k] = 0.9 * m[k] + 0.1 * x
            v[k] = 0.999 * v[k] + 0.001 * x * x
            model.p[k] = (model.p[k] - 0.02 * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    return model

"""A character-level bidirectional LSTM with CRF transitions, in numpy.

Small on purpose: 12-wide embeddings, 20 units a direction. Both directions run as one stacked matrix
product; the backward one reads the window reversed.
"""

from __future__ import annotations

import numpy as np

VOCAB, EMBED, HIDDEN = 130, 12, 20


def codes(text: str, length: int) -> np.ndarray:
    """Character ids: ASCII as it is, 128 for other letters, 129 for the rest; 0 pads."""
    out = np.zeros(length, np.int64)
    out[: len(text)] = [ord(c) if ord(c) < 128 else 128 if c.isalpha() else 129 for c in text]
    return out


def init(tags: int, seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    p = {
        "E": rng.normal(0, 0.3, (VOCAB, EMBED)),
        "W": rng.normal(0, 0.25, (2, EMBED + HIDDEN, 4 * HIDDEN)),
        "b": np.zeros((2, 1, 4 * HIDDEN)),
        "O": rng.normal(0, 0.25, (2 * HIDDEN, tags)),
        "c": np.zeros(tags),
        "T": np.zeros((tags, tags)),
        "s": np.zeros(tags),
    }
    p["b"][:, :, HIDDEN : 2 * HIDDEN] = 1.0
    return {k: v.astype(np.float32) for k, v in p.items()}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def emissions(p: dict, x: np.ndarray, keep: bool = False):
    """Tag scores (n, length, tags) of windows x (n, length)."""
    n, length = x.shape
    both = np.stack([p["E"][x], p["E"][x[:, ::-1]]])  # direction, n, length, embed
    h = np.zeros((2, n, HIDDEN), np.float32)
    c = np.zeros_like(h)
    outs, steps = np.empty((length, 2, n, HIDDEN), np.float32), []
    for t in range(length):
        z = np.concatenate([both[:, :, t], h], axis=2)
        a = z @ p["W"] + p["b"]
        i, f, o = np.split(_sigmoid(a[:, :, : 3 * HIDDEN]), 3, axis=2)
        g = np.tanh(a[:, :, 3 * HIDDEN :])
        before, c = c, f * c + i * g
        th = np.tanh(c)
        h = o * th
        outs[t] = h
        if keep:
            steps.append((z, i, f, o, g, before, th))
    states = np.concatenate([outs[:, 0], outs[::-1, 1]], axis=2).transpose(1, 0, 2)
    scores = states @ p["O"] + p["c"]
    return (scores, states, steps) if keep else scores


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def loss_and_gradients(p: dict, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
    n, length = x.shape
    scores, states, steps = emissions(p, x, keep=True)
    tags = scores.shape[2]
    alpha, beta = np.empty_like(scores), np.zeros_like(scores)
    alpha[:, 0] = p["s"] + scores[:, 0]
    for t in range(1, length):
        alpha[:, t] = _lse(alpha[:, t - 1, :, None] + p["T"], 1) + scores[:, t]
    for t in range(length - 2, -1, -1):
        beta[:, t] = _lse(p["T"] + (scores[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
    total = _lse(alpha[:, -1], 1)
    rows = np.arange(n)
    gold = p["s"][y[:, 0]] + np.take_along_axis(scores, y[:, :, None], 2)[:, :, 0].sum(1) + p["T"][y[:, :-1], y[:, 1:]].sum(1)
    d = np.exp(alpha + beta - total[:, None, None])
    g = {"s": d[:, 0].sum(0), "T": np.zeros_like(p["T"])}
    for t in range(1, length):
        g["T"] += np.exp(alpha[:, t - 1, :, None] + p["T"] + (scores[:, t] + beta[:, t])[:, None, :] - total[:, None, None]).sum(0)
    np.subtract.at(g["T"], (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
    np.subtract.at(g["s"], y[:, 0], 1)
    d[rows[:, None], np.arange(length)[None], y] -= 1
    g["O"] = states.reshape(-1, 2 * HIDDEN).T @ d.reshape(-1, tags)
    g["c"] = d.sum((0, 1))
    ds = (d @ p["O"].T).transpose(1, 0, 2)
    into = np.stack([ds[:, :, :HIDDEN], ds[::-1, :, HIDDEN:]], axis=1)  # length, direction, n, hidden
    g["W"], g["b"], g["E"] = np.zeros_like(p["W"]), np.zeros_like(p["b"]), np.zeros_like(p["E"])
    dh, dc = np.zeros((2, n, HIDDEN), np.float32), np.zeros((2, n, HIDDEN), np.float32)
    turned = np.stack([x, x[:, ::-1]])
    for t in range(length - 1, -1, -1):
        z, i, f, o, gg, before, th = steps[t]
        dh = dh + into[t]
        dc = dc + dh * o * (1 - th * th)
        da = np.concatenate([dc * gg * i * (1 - i), dc * before * f * (1 - f), dh * th * o * (1 - o), dc * i * (1 - gg * gg)], axis=2)
        g["W"] += z.transpose(0, 2, 1) @ da
        g["b"] += da.sum(1, keepdims=True)
        dz = da @ p["W"].transpose(0, 2, 1)
        np.add.at(g["E"], turned[:, :, t].ravel(), dz[:, :, :EMBED].reshape(-1, EMBED))
        dh, dc = dz[:, :, EMBED:], dc * f
    return float((total - gold).sum()), g


def train(x: np.ndarray, y: np.ndarray, tags: int, epochs: int = 10, batch: int = 32, rate: float = 0.015, seed: int = 5) -> dict[str, np.ndarray]:
    """Adam on the CRF's negative log-likelihood."""
    p, rng, step = init(tags, seed), np.random.default_rng(seed), 0
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    for epoch in range(epochs):
        lr = rate * (1 - 0.9 * epoch / epochs)
        for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // batch)):
            _, g = loss_and_gradients(p, x[at], y[at])
            step += 1
            norm = np.sqrt(sum(float((a * a).sum()) for a in g.values())) / len(at)
            for k in p:
                d = g[k] / len(at) / max(1.0, norm / 5)
                m[k] = 0.9 * m[k] + 0.1 * d
                v[k] = 0.999 * v[k] + 0.001 * d * d
                p[k] = (p[k] - lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return p


def decode(p: dict, x: np.ndarray) -> np.ndarray:
    """Viterbi tags (n, length)."""
    scores = emissions(p, x)
    n, length, tags = scores.shape
    back = np.empty((n, length, tags), np.int8)
    best = p["s"] + scores[:, 0]
    for t in range(1, length):
        ways = best[:, :, None] + p["T"]
        back[:, t] = ways.argmax(1)
        best = ways.max(1) + scores[:, t]
    out = np.empty((n, length), np.int64)
    out[:, -1] = best.argmax(1)
    rows = np.arange(n)
    for t in range(length - 1, 0, -1):
        out[:, t - 1] = back[rows, t, out[:, t]]
    return out

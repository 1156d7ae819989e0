"""A bidirectional gated recurrent network over bytes, in numpy, with its training.

Text enters as UTF-8, one step a byte: each byte looks up a row for the trigram it starts (hashed to ``ROWS`` rows), which holds what it
adds to the gates of both directions, and two gated recurrent layers read a window forwards and backwards.  A softmax over both
states gives every byte a probability for each language.  Windows have ``STEPS`` bytes, so all sequences of a batch are equally long.

Both directions run in the same array operations: the second reads its windows from the end.
"""

from __future__ import annotations

import numpy as np

STEPS = 128
ROWS, HIDDEN = 8192, 8

Params = dict[str, np.ndarray]


def new_params(classes: int, seed: int = 3) -> Params:
    rng = np.random.default_rng(seed)

    def near_zero(*shape: int) -> np.ndarray:
        return (rng.standard_normal(shape) / np.sqrt(shape[-2])).astype(np.float32)

    return {
        "table": (rng.standard_normal((2 * ROWS, 3 * HIDDEN)) * 0.3).astype(np.float32), "re": near_zero(2, HIDDEN, 3 * HIDDEN),
        "bi": np.zeros((2, 1, 3 * HIDDEN), np.float32), "out": near_zero(2 * HIDDEN, classes), "bias": np.zeros(classes, np.float32),
    }


def trigram_rows(data: np.ndarray) -> np.ndarray:
    """Table row of the trigram that starts at each byte; the last two see zeros behind them."""
    b = data.astype(np.uint32)
    h = b * np.uint32(2654435761)
    h[:-1] += b[1:] * np.uint32(2246822519)
    h[:-2] += b[2:] * np.uint32(3266489917)
    h ^= h >> np.uint32(15)
    h *= np.uint32(668265263)
    return (h >> np.uint32(19)).astype(np.int32)  # 13 bits


def _both_ways(rows: np.ndarray) -> np.ndarray:
    """Table places (STEPS, 2, windows) that the two directions read in each step."""
    return np.stack([rows.T, rows.T[::-1] + ROWS], axis=1)


def states(p: Params, rows: np.ndarray) -> np.ndarray:
    """States of both directions (windows, STEPS, 2 * HIDDEN) for windows given as (windows, STEPS) table rows.

    As :func:`_traced`, without what training needs: biases and the halves of the sigmoids are put into the table and the
    matrices once, and every step works in the same few arrays.
    """
    n, steps = rows.shape
    at = _both_ways(rows)
    half = np.float32(0.5)
    table = (p["table"].reshape(2, ROWS, -1) + p["bi"]).reshape(2 * ROWS, -1)
    gates, inner = np.ascontiguousarray(table[:, : 2 * HIDDEN]) * half, np.ascontiguousarray(table[:, 2 * HIDDEN :])
    re_gates, re_inner = np.ascontiguousarray(p["re"][..., : 2 * HIDDEN]) * half, np.ascontiguousarray(p["re"][..., 2 * HIDDEN :])
    h, c, v = (np.zeros((2, n, HIDDEN), np.float32) for _ in range(3))
    zr, u = (np.empty((2, n, 2 * HIDDEN), np.float32) for _ in range(2))
    out = np.empty((steps, n, 2 * HIDDEN), np.float32)
    for t in range(steps):
        np.take(gates, at[t], axis=0, out=zr, mode="clip")
        zr += np.matmul(h, re_gates, out=u)
        np.tanh(zr, out=zr)
        zr *= half
        zr += half
        np.take(inner, at[t], axis=0, out=c, mode="clip")
        np.matmul(h, re_inner, out=v)
        v *= zr[..., HIDDEN:]
        c += v
        np.tanh(c, out=c)
        h -= c
        h *= zr[..., :HIDDEN]
        h += c
        out[t, :, :HIDDEN] = h[0]
        out[steps - 1 - t, :, HIDDEN:] = h[1]
    return out.transpose(1, 0, 2)


def _traced(p: Params, rows: np.ndarray) -> tuple[np.ndarray, list]:
    """The states, and of every step what backpropagation needs."""
    n, steps = rows.shape
    at, kind = _both_ways(rows), p["re"].dtype
    h = np.zeros((2, n, HIDDEN), kind)
    out, trace = np.empty((steps, n, 2 * HIDDEN), kind), []
    half = kind.type(0.5)
    for t in range(steps):
        g = p["table"][at[t]] + p["bi"]
        u = h @ p["re"]
        zr = half * np.tanh(half * (g[..., : 2 * HIDDEN] + u[..., : 2 * HIDDEN])) + half
        z, r = zr[..., :HIDDEN], zr[..., HIDDEN:]
        c = np.tanh(g[..., 2 * HIDDEN :] + r * u[..., 2 * HIDDEN :])
        trace.append((h, z, r, c, u[..., 2 * HIDDEN :]))
        h = c + z * (h - c)
        out[t, :, :HIDDEN] = h[0]
        out[steps - 1 - t, :, HIDDEN:] = h[1]
    return out.transpose(1, 0, 2), trace


def log_softmax(scores: np.ndarray) -> np.ndarray:
    most = scores[..., 0]
    for k in range(1, scores.shape[-1]):  # a handful of columns: far faster than a reduction over the last axis
        most = np.maximum(most, scores[..., k])
    scores = scores - most[..., None]
    scores -= np.log(np.exp(scores) @ np.ones((scores.shape[-1], 1), scores.dtype))
    return scores


def forward(p: Params, rows: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """Log-probabilities (windows, STEPS, classes) of windows given as (windows, STEPS) table rows; ``keep`` gets what training needs."""
    if keep is None:
        both = states(p, rows)
    else:
        both, keep["trace"] = _traced(p, rows)
        keep["both"] = both
    return log_softmax(both @ p["out"] + p["bias"])


def gradients(p: Params, rows: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, Params]:
    """Weighted mean loss and its gradient by backpropagation through time; labels and weights are (windows, STEPS)."""
    keep: dict = {}
    logp = forward(p, rows, keep)
    n, steps = rows.shape
    kind = p["re"].dtype
    w = (weights / max(weights.sum(), 1e-9)).astype(kind)
    loss = -float((np.take_along_axis(logp, labels[..., None], 2)[..., 0] * w).sum())
    d = np.exp(logp)
    np.put_along_axis(d, labels[..., None], np.take_along_axis(d, labels[..., None], 2) - 1, 2)
    d *= w[..., None]
    both = keep["both"]
    g: Params = {"out": both.reshape(-1, 2 * HIDDEN).T @ d.reshape(-1, d.shape[2]), "bias": d.sum((0, 1))}
    d_both = (d @ p["out"].T).transpose(1, 0, 2)
    d_in = np.empty((steps, 2, n, 3 * HIDDEN), kind)
    d_re = np.zeros_like(p["re"])
    dh = np.zeros((2, n, HIDDEN), kind)
    back = p["re"].transpose(0, 2, 1)
    for t in range(steps - 1, -1, -1):
        h, z, r, c, uc = keep["trace"][t]
        dh[0] += d_both[t, :, :HIDDEN]
        dh[1] += d_both[steps - 1 - t, :, HIDDEN:]
        dc = dh * (1 - z) * (1 - c * c)
        own = d_in[t]
        own[..., :HIDDEN] = dh * (h - c) * z * (1 - z)
        own[..., HIDDEN : 2 * HIDDEN] = dc * uc * r * (1 - r)
        own[..., 2 * HIDDEN :] = dc
        du = own.copy()
        du[..., 2 * HIDDEN :] *= r
        d_re += h.transpose(0, 2, 1) @ du
        dh = dh * z + du @ back
    g |= {"re": d_re, "bi": d_in.sum((0, 2))[:, None, :]}
    at, each = _both_ways(rows).reshape(-1), d_in.reshape(-1, 3 * HIDDEN)
    order = np.argsort(at, kind="stable")
    first = np.flatnonzero(np.append(True, np.diff(at[order])))
    g["table"] = np.zeros_like(p["table"])
    g["table"][at[order][first]] = np.add.reduceat(each[order], first, axis=0)
    return loss, g


def train(rows: np.ndarray, labels: np.ndarray, weights: np.ndarray, classes: int, *, steps: int = 300, batch: int = 96, rate: float = 0.02, seed: int = 5) -> Params:
    """Parameters after ``steps`` Adam steps; half of the windows are joined from several, to show changes of language."""
    rng = np.random.default_rng(seed)
    p = new_params(classes)
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        a = rng.integers(0, len(rows), batch)
        r, y, w = rows[a].copy(), labels[a].copy(), weights[a].copy()
        for i in range(batch // 2, batch):
            at = 0
            while (at := at + int(rng.integers(24, 96))) < STEPS:
                other = rng.integers(0, len(rows))
                r[i, at:], y[i, at:], w[i, at:] = rows[other, at:], labels[other, at:], weights[other, at:]
        _, g = gradients(p, r, y, w)
        pace = rate * min(1.0, 2.5 * (1 - step / (steps + 1)))
        for k, d in g.items():
            m[k] += np.float32(0.1) * (d - m[k])
            v[k] += np.float32(0.01) * (d * d - v[k])
            p[k] -= np.float32(pace / (1 - 0.9**step)) * m[k] / (np.sqrt(v[k] * np.float32(1 / (1 - 0.99**step))) + np.float32(1e-8))
    return p

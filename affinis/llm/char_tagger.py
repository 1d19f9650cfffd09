"""A character-level bidirectional LSTM with CRF transitions, in numpy: training and decoding."""

from __future__ import annotations

import numpy as np

# Fixed value: characters with a number of their own; digits share one, all others fall into four classes.
ALPHABET = " abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?()[]<>@/-+'\"_#&%*=|\\~$^{}`äöüßéèàâçñíóáúêîôûùëïœÄÖÜÉÈÀÇÑÍÓÁÚ’“”–…°ºª«»\n\t"
_NUMBER = {ch: i + 1 for i, ch in enumerate(ALPHABET)}
DIGIT, UPPER, LOWER, SPACE, OTHER = (len(ALPHABET) + 1 + i for i in range(5))
SYMBOLS = len(ALPHABET) + 6  # 0 is padding
_LOOKUP: np.ndarray | None = None


def symbols(text: str) -> np.ndarray:
    """The number of each character."""
    global _LOOKUP
    if _LOOKUP is None:
        table = np.full(0x110000 >> 4, 0, np.int16)  # the first planes by table, the rest by class
        for code in range(len(table)):
            ch = chr(code)
            table[code] = _NUMBER.get(ch) or (DIGIT if ch.isdigit() else UPPER if ch.isupper() else LOWER if ch.islower() else SPACE if ch.isspace() else OTHER)
        _LOOKUP = table
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(codes < len(_LOOKUP), _LOOKUP[np.minimum(codes, len(_LOOKUP) - 1)], OTHER)


def initial(hidden: int, tags: int, seed: int = 1) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    p = {}
    for d in "fb":
        p["x" + d] = (rng.standard_normal((SYMBOLS, 4 * hidden)) * 0.15).astype(np.float32)
        p["x" + d][:, hidden : 2 * hidden] += 1.0  # the forget gate starts open
        p["h" + d] = (rng.standard_normal((hidden, 4 * hidden)) / np.sqrt(hidden) * 0.7).astype(np.float32)
    p["o"] = (rng.standard_normal((2 * hidden, tags)) / np.sqrt(2 * hidden)).astype(np.float32)
    p["ob"] = np.zeros(tags, np.float32)
    p["t"] = np.zeros((tags, tags), np.float32)
    p["s"] = np.zeros(tags, np.float32)
    return p


def _gates(z: np.ndarray, hidden: int) -> np.ndarray:
    """In place: input, forget and output gates through a sigmoid, the candidate (last quarter) through tanh."""
    z[:, : 3 * hidden] *= 0.5
    np.tanh(z, out=z)
    z[:, : 3 * hidden] *= 0.5
    z[:, : 3 * hidden] += 0.5
    return z


def _run(x: np.ndarray, wh: np.ndarray, ids: np.ndarray, mask: np.ndarray, keep: bool):
    """One direction over ids (time x batch); returns states and, for training, what the way back needs."""
    steps, batch = ids.shape
    hidden = wh.shape[0]
    h, c = np.zeros((batch, hidden), np.float32), np.zeros((batch, hidden), np.float32)
    hs = np.empty((steps, batch, hidden), np.float32)
    gates = np.empty((steps, batch, 4 * hidden), np.float32) if keep else None
    cs = np.empty((steps, batch, hidden), np.float32) if keep else None
    for t in range(steps):
        z = x[ids[t]]
        z += h @ wh
        _gates(z, hidden)
        c = (z[:, hidden : 2 * hidden] * c + z[:, :hidden] * z[:, 3 * hidden :]) * mask[t][:, None]
        h = z[:, 2 * hidden : 3 * hidden] * np.tanh(c)
        hs[t] = h
        if keep:
            gates[t], cs[t] = z, c
    return hs, gates, cs


def _run_back(x: np.ndarray, wh: np.ndarray, ids: np.ndarray, mask: np.ndarray, hs, gates, cs, dhs) -> tuple[np.ndarray, np.ndarray]:
    steps, batch = ids.shape
    hidden = wh.shape[0]
    dx, dwh = np.zeros_like(x), np.zeros_like(wh)
    dh, dc = np.zeros((batch, hidden), np.float32), np.zeros((batch, hidden), np.float32)
    dz_all = np.empty((steps, batch, 4 * hidden), np.float32)
    for t in range(steps - 1, -1, -1):
        z, c = gates[t], cs[t]
        i, f, o, g = (z[:, k * hidden : (k + 1) * hidden] for k in range(4))
        dh = dh + dhs[t]
        tc = np.tanh(c)
        dc = (dc + dh * o * (1 - tc * tc)) * mask[t][:, None]
        before = cs[t - 1] if t else np.zeros_like(c)
        dz = dz_all[t]
        dz[:, :hidden] = dc * g * i * (1 - i)
        dz[:, hidden : 2 * hidden] = dc * before * f * (1 - f)
        dz[:, 2 * hidden : 3 * hidden] = dh * tc * o * (1 - o)
        dz[:, 3 * hidden :] = dc * i * (1 - g * g)
        if t:
            dwh += hs[t - 1].T @ dz
        dh, dc = dz @ wh.T, dc * f
    flat = ids.ravel()
    order = np.argsort(flat, kind="stable")
    cuts = np.flatnonzero(np.r_[True, np.diff(flat[order]) > 0])
    dx[flat[order][cuts]] = np.add.reduceat(dz_all.reshape(-1, 4 * hidden)[order], cuts, axis=0)
    return dx, dwh


def emissions(p: dict, ids: np.ndarray, mask: np.ndarray, keep: bool = False):
    """Tag scores (time x batch x tags) of symbol windows."""
    f = _run(p["xf"], p["hf"], ids, mask, keep)
    b = _run(p["xb"], p["hb"], ids[::-1], mask[::-1], keep)
    both = np.concatenate([f[0], b[0][::-1]], axis=2)
    return both @ p["o"] + p["ob"], (f, b, both)


def _crf(p: dict, e: np.ndarray, mask: np.ndarray, tags: np.ndarray):
    """(loss, gradients of emissions, transitions, start) of the CRF; windows are filled from the left."""
    steps, batch, k = e.shape
    t = p["t"].astype(np.float64)
    expt = np.exp(t)
    alpha = np.empty((steps, batch, k))
    scale = np.empty((steps, batch, 1))
    peak = e.max(axis=2, keepdims=True).astype(np.float64)
    exe = np.exp(e - peak)
    a = np.exp(p["s"].astype(np.float64)) * exe[0]
    scale[0] = a.sum(axis=1, keepdims=True)
    alpha[0] = a / scale[0]
    for i in range(1, steps):
        a = (alpha[i - 1] @ expt) * exe[i]
        m = mask[i][:, None]
        s = a.sum(axis=1, keepdims=True)
        scale[i] = np.where(m > 0, s, 1.0)
        alpha[i] = np.where(m > 0, a / s, alpha[i - 1])
    beta = np.ones((batch, k))
    de, dt = np.zeros((steps, batch, k)), np.zeros((k, k))
    arange = np.arange(batch)
    for i in range(steps - 1, -1, -1):
        m = mask[i][:, None]
        q = alpha[i] * beta
        q /= q.sum(axis=1, keepdims=True)
        de[i] = q * m
        de[i][arange, tags[i]] -= mask[i]
        if i:
            w = exe[i] * beta
            pair = alpha[i - 1][:, :, None] * expt[None] * w[:, None, :]
            pair /= pair.sum(axis=(1, 2), keepdims=True)
            dt += (pair * m[:, :, None]).sum(axis=0)
            np.subtract.at(dt, (tags[i - 1], tags[i]), mask[i])
            b = w @ expt.T
            beta = np.where(m > 0, b / b.sum(axis=1, keepdims=True), beta)
    ds = de[0].sum(axis=0)
    logz = (np.log(scale[..., 0]) * mask + peak[..., 0] * mask).sum()
    gold = (np.take_along_axis(e, tags[:, :, None], 2)[..., 0] * mask).sum() + p["s"][tags[0]].sum() + (p["t"][tags[:-1], tags[1:]] * mask[1:]).sum()
    return logz - gold, de, dt, ds


def _gradients(p: dict, ids: np.ndarray, mask: np.ndarray, tags: np.ndarray):
    e, (f, b, both) = emissions(p, ids, mask, keep=True)
    loss, de, dt, ds = _crf(p, e, mask, tags)
    de = de.astype(np.float32)
    hidden = p["hf"].shape[0]
    g = {"o": np.tensordot(both, de, axes=([0, 1], [0, 1])), "ob": de.sum(axis=(0, 1)), "t": dt.astype(np.float32), "s": ds.astype(np.float32)}
    dboth = de @ p["o"].T
    g["xf"], g["hf"] = _run_back(p["xf"], p["hf"], ids, mask, *f, dboth[..., :hidden])
    g["xb"], g["hb"] = _run_back(p["xb"], p["hb"], ids[::-1], mask[::-1], *b, dboth[::-1, :, hidden:])
    return loss, g


def train(windows: list[np.ndarray], tags: list[np.ndarray], n_tags: int, hidden: int = 32, epochs: int = 12, batch: int = 64, rate: float = 6e-3, seed: int = 1, say=None, pool=None, workers: int = 1, start: dict | None = None) -> dict:
    """Fits the tagger to symbol windows and their tags by Adam; windows of any length up to a few hundred.

    With a ``pool`` of processes, each computes the gradient of its share of a batch; ``start`` continues an earlier fit.
    """
    rng = np.random.default_rng(seed)
    p = {k: x.copy() for k, x in start.items()} if start else initial(hidden, n_tags, seed)
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    step, total = 0, epochs * -(-len(windows) // batch)
    by_length = np.argsort([len(w) for w in windows], kind="stable")
    for epoch in range(epochs):
        loss = 0.0
        groups = np.array_split(by_length, -(-len(windows) // batch))
        for at in rng.permutation(len(groups)):
            shares = [(p, *pad([windows[i] for i in share], [tags[i] for i in share])) for share in np.array_split(groups[at], workers) if len(share)]
            parts = pool.starmap(_gradients, shares, chunksize=1) if pool else [_gradients(*x) for x in shares]
            part, g = sum(x for x, _ in parts), {k: sum(x[k] for _, x in parts) for k in p}
            loss += part
            norm = np.sqrt(sum(float((x * x).sum()) for x in g.values())) / len(groups[at])
            step += 1
            lr = rate * min(1.0, step / 30) * (1 - 0.95 * step / total)
            for k in p:
                d = g[k] / len(groups[at]) * min(1.0, 5.0 / max(norm, 1e-9))
                m[k] += 0.1 * (d - m[k])
                v[k] += 0.01 * (d * d - v[k])
                p[k] -= (lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        if say:
            say(epoch, loss / len(windows), p)
    return p


def pad(windows: list[np.ndarray], tags: list[np.ndarray] | None = None):
    """(ids, mask, tags) as time x batch, filled up with padding."""
    steps = max(map(len, windows))
    ids, mask = np.zeros((steps, len(windows)), np.int64), np.zeros((steps, len(windows)), np.float32)
    gold = np.zeros((steps, len(windows)), np.int64)
    for j, w in enumerate(windows):
        ids[: len(w), j], mask[: len(w), j] = w, 1.0
        if tags is not None:
            gold[: len(w), j] = tags[j]
    return ids, mask, gold


def viterbi(p: dict, e: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The best tag of every position (time x batch)."""
    steps, batch, k = e.shape
    score = p["s"] + e[0]
    back = np.empty((steps, batch, k), np.int8)
    t = np.ascontiguousarray(p["t"].T)[None]  # to x from
    for i in range(1, steps):
        all_ways = score[:, None, :] + t
        back[i] = all_ways.argmax(axis=2)
        new = all_ways.max(axis=2) + e[i]
        score = np.where(mask[i][:, None] > 0, new, score)
    best = np.empty((steps, batch), np.int64)
    tag = score.argmax(axis=1)
    arange = np.arange(batch)
    for i in range(steps - 1, -1, -1):
        best[i] = tag
        if i:
            tag = np.where(mask[i] > 0, back[i][arange, tag], tag)
    return best

"""A small causal self-attention language model in numpy (the model of operator 8).

One attention layer over unit ids, with learned relative positions, a residual connection
and a softmax over output classes, on top of given log priors of a class after an input (counts).  The text is cut into blocks of ``BLOCK`` inputs; a
block is scored in a window of two blocks, itself and the one before, under a
causal mask: windows overlap by half, every token is scored once and sees
between 1 and 2 * BLOCK inputs.  Blocks of many texts make one batch.
"""

from __future__ import annotations

import numpy as np

BLOCK = 16
NAMES = ("embed", "query", "key", "value", "out", "place", "classes", "bias")

_LARGEST = np.float32(60)
# Distance of a key from a query, and what the causal mask lets through.
_DISTANCE = (BLOCK + np.arange(BLOCK))[:, None] - np.arange(2 * BLOCK)[None, :]
_ALLOWED = (_DISTANCE >= 0).astype(np.float32)
_FIRST = np.where(np.arange(2 * BLOCK) < BLOCK, -1e9, 0.0).astype(np.float32)  # a text's first block has none before it


def shapes(inputs: int, classes: int, width: int) -> dict[str, tuple[int, ...]]:
    return {"embed": (inputs, width), "query": (width, width), "key": (width, width), "value": (width, width), "out": (width, width), "place": (2 * BLOCK,), "classes": (classes, width), "bias": (classes,)}


def start(inputs: int, classes: int, width: int, seed: int = 11) -> dict[str, np.ndarray]:
    """First parameters: small output weights, so the untrained model is close to the priors."""
    rng = np.random.default_rng(seed)
    p = {}
    for name, shape in shapes(inputs, classes, width).items():
        scale = {"embed": 0.3, "place": 0.0, "classes": 0.05, "bias": 0.0}.get(name, 1 / np.sqrt(width))
        p[name] = (rng.standard_normal(shape) * scale).astype(np.float32)
    return p


def pack(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[n].ravel() for n in NAMES]).astype(np.float32)


def unpack(flat: np.ndarray, inputs: int, classes: int, width: int) -> dict[str, np.ndarray]:
    p, at = {}, 0
    for name, shape in shapes(inputs, classes, width).items():
        size = int(np.prod(shape))
        p[name] = flat[at : at + size].reshape(shape).copy()
        at += size
    return p


def blocks(inputs: np.ndarray, first: np.ndarray):
    """(blocks, 2 * BLOCK) inputs of the windows, and the added mask (blocks, 2 * BLOCK).

    ``inputs``: (blocks, BLOCK) ids; ``first``: is a block the first one of its text?
    """
    before = np.zeros_like(inputs)
    before[1:] = inputs[:-1]
    return np.concatenate([before, inputs], axis=1), np.where(first[:, None], _FIRST, np.float32(0))


def _bounded(x: np.ndarray) -> None:
    """Scores inside of what float32 can raise e to; cheaper than taking off each row's largest one."""
    np.clip(x, -_LARGEST, _LARGEST, out=x)


def _sums(x: np.ndarray) -> np.ndarray:
    """Sums along the last axis, as a product with ones: several times faster on short rows."""
    return (x @ np.ones(x.shape[-1], x.dtype))[..., None]


def _times(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """x @ weights as one product: numpy would make one of every block."""
    return (x.reshape(-1, x.shape[-1]) @ weights).reshape(*x.shape[:-1], weights.shape[1])


def _attend(p, tables, window, masked):
    """Queries, keys, values, shares of attention, the values mixed by them, and what the classes are read from."""
    own = window[:, BLOCK:]
    q, k, v = np.take(tables[0], own, axis=0), np.take(tables[1], window, axis=0), np.take(tables[2], window, axis=0)
    s = q @ k.transpose(0, 2, 1)
    s += p["place"][np.maximum(_DISTANCE, 0)][None]
    _bounded(s)
    np.exp(s, out=s)
    s *= _ALLOWED
    s[masked[:, 0] < 0, :, :BLOCK] = 0
    s /= _sums(s)
    mixed = s @ v
    h = _times(mixed, p["out"])
    h += np.take(p["embed"], own, axis=0)
    return q, k, v, s, mixed, h


def tables(p):
    """Queries, keys and values of every input id: the layer reads the embeddings only."""
    scale = np.float32(1 / np.sqrt(p["query"].shape[1]))
    return p["embed"] @ p["query"] * scale, p["embed"] @ p["key"], p["embed"] @ p["value"]


def log_probabilities(p, made, prior, window, masked, targets) -> np.ndarray:
    """Natural log probability of the target class of every token (blocks, BLOCK); prior: (inputs, classes)."""
    h = _attend(p, made, window, masked)[-1].reshape(-1, p["embed"].shape[1])
    logits = h @ p["classes"].T
    logits += p["bias"]
    logits += np.take(prior, window[:, BLOCK:].ravel(), axis=0)
    _bounded(logits)
    wanted = logits[np.arange(len(logits)), targets.ravel()]
    np.exp(logits, out=logits)
    return (wanted - np.log(_sums(logits)[:, 0])).reshape(targets.shape)


def gradients(p, prior, window, masked, targets, weights):
    """Mean loss over the weighted tokens of a batch, and its gradient; that of ``embed`` as (rows met, their gradient)."""
    width, embed_type = p["embed"].shape[1], p["embed"].dtype
    scale = np.float32(1 / np.sqrt(width))
    # Only the inputs of the batch have tables and gradients; ``near`` numbers them.
    met = np.zeros(len(p["embed"]), bool)
    met[window.ravel()] = True
    kinds, near = np.flatnonzero(met), np.take(np.cumsum(met) - 1, window)
    prior = np.take(prior, window[:, BLOCK:].ravel(), axis=0)
    p = {**p, "embed": np.take(p["embed"], kinds, axis=0)}
    q, k, v, a, mixed, h = _attend(p, tables(p), near, masked)
    flat = h.reshape(-1, width)
    prob = flat @ p["classes"].T
    prob += p["bias"]
    prob += prior
    _bounded(prob)
    np.exp(prob, out=prob)
    prob /= _sums(prob)
    t, w = targets.ravel(), weights.ravel().astype(np.float32)
    total = max(1.0, float(w.sum()))
    at = np.arange(len(t)), t
    wanted = prob[at]
    loss = float(-(np.log(np.maximum(wanted, 1e-30)) * w).sum() / total)
    prob[at] = wanted - 1
    prob *= (w / total)[:, None]
    g = {"classes": prob.T @ flat, "bias": prob.sum(axis=0)}
    dh = (prob @ p["classes"]).reshape(h.shape)
    g["out"] = mixed.reshape(-1, width).T @ dh.reshape(-1, width)
    dm = _times(dh, p["out"].T)
    dv = a.transpose(0, 2, 1) @ dm
    da = dm @ v.transpose(0, 2, 1)
    da -= np.einsum("bij,bij->bi", da, a)[:, :, None]
    da *= a
    g["place"] = np.bincount(np.maximum(_DISTANCE, 0).ravel(), da.sum(axis=0).ravel() * (_DISTANCE.ravel() >= 0), 2 * BLOCK).astype(np.float32)
    dq, dk = da @ k, da.transpose(0, 2, 1) @ q
    x, xo = np.take(p["embed"], near.ravel(), axis=0), np.take(p["embed"], near[:, BLOCK:].ravel(), axis=0)
    g["query"] = xo.T @ dq.reshape(-1, width) * scale
    g["key"] = x.T @ dk.reshape(-1, width)
    g["value"] = x.T @ dv.reshape(-1, width)
    dx = _times(dk, p["key"].T)
    dx += _times(dv, p["value"].T)
    dh += _times(dq, p["query"].T) * scale
    dx[:, BLOCK:] += dh
    cells = np.take(np.arange(len(kinds) * width).reshape(-1, width), near, axis=0)
    g["embed"] = kinds, np.bincount(cells.ravel(), dx.ravel(), len(kinds) * width).reshape(-1, width).astype(embed_type)
    return loss, g


class Adam:
    """Adam; a table whose gradient comes as (rows, gradient) moves in these rows only, each by its own count of steps.

    The other parameters have one count and move together, as one array."""

    def __init__(self, p, rate: float):
        self.rate, self.t = rate, {n: 0 for n in p}
        self.m, self.v = {}, {}

    def step(self, p, g) -> None:
        whole = [n for n in p if not isinstance(g[n], tuple)]
        for n in p.keys() - set(whole):
            rows, own = g[n]
            if n not in self.m:
                self.t[n] = np.zeros(len(p[n]), np.int32)
                self.m[n], self.v[n] = np.zeros_like(p[n]), np.zeros_like(p[n])
            t = np.take(self.t[n], rows) + 1
            m, v = (np.take(x[n], rows, axis=0) for x in (self.m, self.v))
            p[n][rows] = np.take(p[n], rows, axis=0) - self._move(m, v, own, t[:, None].astype(np.float32))
            self.t[n][rows], self.m[n][rows], self.v[n][rows] = t, m, v
        if whole:
            flat = np.concatenate([g[n].ravel() for n in whole])
            if "" not in self.m:
                self.m[""], self.v[""] = np.zeros_like(flat), np.zeros_like(flat)
            for n in whole:
                self.t[n] += 1
            moves, at = self._move(self.m[""], self.v[""], flat, self.t[whole[0]]), 0
            for n in whole:
                p[n] -= moves[at : at + p[n].size].reshape(p[n].shape)
                at += p[n].size

    def _move(self, m, v, g, t):
        m *= 0.9
        m += 0.1 * g
        v *= 0.99
        v += 0.01 * g * g
        return m * (self.rate * np.sqrt(1 - 0.99**t) / (1 - 0.9**t)) / (np.sqrt(v) + 1e-8)

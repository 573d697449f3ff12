"""A gated recurrent language model in numpy: truncated backpropagation and a class-factored softmax.

Symbols are 0..CLASSES * CLASS_WORDS - 1; symbol s lies in class s // CLASS_WORDS.
The probability of the next symbol is that of its class times that within the
class, so a step costs two small softmaxes. Documents are laid end to end in
lanes that advance together; a document starts from the zero state, and its
state goes on from window to window.
"""

from __future__ import annotations

import heapq
import math

import numpy as np

CLASSES, CLASS_WORDS, HIDDEN = 32, 32, 16
SYMBOLS = CLASSES * CLASS_WORDS
WINDOW, LANES = 32, 256
NAMES = ("table", "u", "out_class", "bias_class", "out_word", "bias_word")


def start(rnd: np.random.Generator, frequency: np.ndarray) -> dict[str, np.ndarray]:
    """Weights for a first epoch; biases start at the symbols' own frequencies."""
    f = (frequency + 0.5).reshape(CLASSES, CLASS_WORDS)
    scale = 1 / np.sqrt(HIDDEN)
    return {
        "table": rnd.normal(0, 0.3, (SYMBOLS + 1, 3 * HIDDEN)).astype(np.float32),  # what a symbol adds to the gates; the last row starts a document
        "u": rnd.normal(0, scale, (HIDDEN, 3 * HIDDEN)).astype(np.float32),
        "out_class": np.zeros((HIDDEN, CLASSES), np.float32),
        "bias_class": np.log(f.sum(1) / f.sum()).astype(np.float32),
        "out_word": np.zeros((CLASSES, HIDDEN, CLASS_WORDS), np.float32),
        "bias_word": np.log(f / f.sum(1, keepdims=True)).astype(np.float32),
    }


def lanes(docs: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, owner) of shape (steps, width): documents laid into lanes, longest first, each in the shortest lane; owner -1 where a lane has ended.

    There are no more lanes than the longest document leaves work for, so that the arrays follow the words.
    """
    longest = max(map(len, docs), default=0)
    width = max(1, min(width, len(docs), 4 * sum(map(len, docs)) // max(1, longest)))
    heap = [(0, k) for k in range(width)]
    parts: list[list[int]] = [[] for _ in range(width)]
    for d in sorted(range(len(docs)), key=lambda d: -len(docs[d])):
        n, k = heapq.heappop(heap)
        parts[k].append(d)
        heapq.heappush(heap, (n + len(docs[d]), k))
    steps = max(n for n, _ in heap)
    symbols, owner = np.zeros((steps, width), np.int32), np.full((steps, width), -1, np.int32)
    for k, own in enumerate(parts):
        at = 0
        for d in own:
            symbols[at : at + len(docs[d]), k] = docs[d]
            owner[at : at + len(docs[d]), k] = d
            at += len(docs[d])
    return symbols, owner


class Space:
    """Arrays by name that each window uses again: asked for anew, most of the time would go into their pages."""

    def __init__(self) -> None:
        self.held: dict[str, np.ndarray] = {}

    def __call__(self, name: str, kind: np.dtype, *shape: int) -> np.ndarray:
        size = math.prod(shape)
        if name not in self.held or self.held[name].size < size:
            self.held[name] = np.empty(size, kind)
        return self.held[name][:size].reshape(shape)


def _forward(w: dict, before: np.ndarray, fresh: np.ndarray, h: np.ndarray, space: Space) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """States after each step, from the symbols before, and what the way back needs of each step; fresh marks steps that start a document."""
    H, kind, (steps, width) = HIDDEN, w["table"].dtype, before.shape
    # the gates' share is negated once, here, instead of at each step
    gate_u, cand_u = -w["u"][:, : 2 * H], np.ascontiguousarray(w["u"][:, 2 * H :])
    gate_x = np.take(-w["table"][:, : 2 * H], before, axis=0, mode="clip", out=space("gate_x", kind, steps, width, 2 * H))
    cand_x = np.take(np.ascontiguousarray(w["table"][:, 2 * H :]), before, axis=0, mode="clip", out=space("cand_x", kind, steps, width, H))
    states, prior, cand, carried = (space(name, kind, steps, width, H) for name in ("states", "prior", "cand", "carried"))
    gates = space("gates", kind, steps, width, 2 * H)
    started = fresh.any(1)
    for t in range(steps):
        if started[t]:
            h = np.where(fresh[t][:, None], kind.type(0), h)
        zr, n, state = gates[t], cand[t], states[t]
        np.matmul(h, gate_u, out=zr)
        zr += gate_x[t]
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        prior[t] = h
        np.matmul(h, cand_u, out=carried[t])
        np.multiply(zr[:, H:], carried[t], out=n)
        n += cand_x[t]
        np.tanh(n, out=n)
        np.subtract(h, n, out=state)
        state *= zr[:, :H]
        state += n
        h = state
    return states, (prior, gates, cand, carried)


def _tame(weights: np.ndarray, bias: np.ndarray) -> bool:
    """Whether no state's logits leave the range that exp has: units lie in -1 to 1. Then softmax needn't look for the largest."""
    return bool((np.abs(weights).sum(-2) + np.abs(bias)).max() < 80)


def _exp(s: np.ndarray, weights: np.ndarray, bias: np.ndarray, tame: bool, goal: tuple[np.ndarray, np.ndarray], out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fills out with exp of the logits, up to a factor for each row; (the logits at goal, with that factor; the sums of exp)."""
    np.matmul(s, weights, out=out)
    out += bias
    if not tame:
        out -= out.max(-1, keepdims=True)
    chosen = out[goal]
    np.exp(out, out=out)
    return chosen, out @ np.ones(out.shape[1], out.dtype)


def _windows(symbols: np.ndarray, owner: np.ndarray):
    """(before, fresh, symbols, owner) window by window."""
    fresh = np.ones(owner.shape, bool)
    fresh[1:] = owner[1:] != owner[:-1]
    before = np.full(symbols.shape, SYMBOLS, np.int32)
    before[1:] = symbols[:-1]
    before[fresh] = SYMBOLS
    for at in range(0, len(symbols), WINDOW):
        yield before[at : at + WINDOW], fresh[at : at + WINDOW], symbols[at : at + WINDOW], owner[at : at + WINDOW]


def log_likelihood(w: dict, docs: list[np.ndarray]) -> np.ndarray:
    """The natural log probability of each document's symbols."""
    total = np.zeros(len(docs))
    docs_here = [d for d in range(len(docs)) if len(docs[d])]
    if not docs_here:
        return total
    symbols, owner = lanes([docs[d] for d in docs_here], LANES)
    kind, space = w["table"].dtype, Space()
    h = np.zeros((symbols.shape[1], HIDDEN), np.float32)
    sums = np.zeros(len(docs_here))
    tame, tame_words = _tame(w["out_class"], w["bias_class"]), _tame(w["out_word"], w["bias_word"])
    for window in _windows(symbols, owner):
        active = (window[3] >= 0).any(0)  # lanes that have ended stay out; go on with the others
        before, fresh, target, own = window if active.all() else (x[:, active] for x in window)
        states, _ = _forward(w, before, fresh, h[active], space)
        h[active] = states[-1]
        s, group, word, at, edges = _by_class(states, target, own, space)
        every = np.arange(len(at))
        got, whole = _exp(s, w["out_class"], w["bias_class"], tame, (every, group), space("p", kind, len(at), CLASSES))
        got -= np.log(whole)
        q = space("q", kind, len(at), CLASS_WORDS)
        for c in np.flatnonzero(np.diff(edges)):
            part = slice(edges[c], edges[c + 1])
            inside, whole[part] = _exp(s[part], w["out_word"][c], w["bias_word"][c], tame_words, (every[: edges[c + 1] - edges[c]], word[part]), q[part])
            got[part] += inside
        sums += np.bincount(own.ravel()[at], got - np.log(whole), len(docs_here))
    total[docs_here] = sums
    return total


def _by_class(states: np.ndarray, target: np.ndarray, own: np.ndarray, space: Space) -> tuple[np.ndarray, ...]:
    """The live steps of a window by the class of their symbol: (states, classes, places in the class, places in the window, where each class begins)."""
    live = np.flatnonzero(own.ravel() >= 0)
    group = target.ravel()[live] // CLASS_WORDS
    order = np.argsort(group.astype(np.int8), kind="stable")  # a radix sort
    at, group = live[order], group[order]
    s = np.take(states.reshape(-1, HIDDEN), at, axis=0, mode="clip", out=space("s", states.dtype, len(at), HIDDEN))
    return s, group, target.ravel()[at] % CLASS_WORDS, at, np.searchsorted(group, np.arange(CLASSES + 1))


def _gradients(w: dict, before: np.ndarray, fresh: np.ndarray, target: np.ndarray, own: np.ndarray, h: np.ndarray, space: Space | None = None) -> tuple[dict, np.ndarray, float, int]:
    H, kind, space = HIDDEN, w["table"].dtype, space or Space()
    states, (prior, gates, cand, carried) = _forward(w, before, fresh, h, space)
    s, group, word, at, edges = _by_class(states, target, own, space)
    n, every = max(1, len(at)), np.arange(len(at))
    ones = np.ones(len(at), kind)
    g = {k: np.zeros_like(v) for k, v in w.items() if k not in ("table",)}
    p = space("p", kind, len(at), CLASSES)
    got, whole = _exp(s, w["out_class"], w["bias_class"], _tame(w["out_class"], w["bias_class"]), (every, group), p)
    p *= (1 / whole)[:, None]
    p[every, group] -= 1
    got -= np.log(whole)
    g["out_class"], g["bias_class"] = s.T @ p / n, ones @ p / n
    ds = np.matmul(p, w["out_class"].T, out=space("ds", kind, len(at), H))
    tame, places = _tame(w["out_word"], w["bias_word"]), space("q", kind, len(at), CLASS_WORDS)
    for c in np.flatnonzero(np.diff(edges)):
        part = slice(edges[c], edges[c + 1])
        q, goal = places[part], (every[: edges[c + 1] - edges[c]], word[part])
        inside, whole[part] = _exp(s[part], w["out_word"][c], w["bias_word"][c], tame, goal, q)
        got[part] += inside
        q *= (1 / whole[part])[:, None]
        q[goal] -= 1
        np.matmul(s[part].T, q, out=g["out_word"][c])
        np.matmul(ones[: len(q)], q, out=g["bias_word"][c])
        ds[part] += q @ w["out_word"][c].T
    g["out_word"] /= n
    g["bias_word"] /= n
    ds /= n
    dstates = space("dstates", kind, own.size, H)
    dstates[:] = 0
    dstates[at] = ds
    dstates = dstates.reshape(states.shape)
    z, r = gates[..., :H], gates[..., H:]
    to_cand, to_z, to_r, spare = (space(name, kind, *states.shape) for name in ("to_cand", "to_z", "to_r", "spare"))
    np.subtract(1, z, out=spare)  # (1 - z) * (1 - cand * cand), (prior - cand) * z * (1 - z), carried * r * (1 - r)
    np.subtract(prior, cand, out=to_z)
    to_z *= z
    to_z *= spare
    np.multiply(cand, cand, out=to_cand)
    np.subtract(1, to_cand, out=to_cand)
    to_cand *= spare
    np.subtract(1, r, out=to_r)
    to_r *= r
    to_r *= carried
    dg, dx = (space(name, kind, *before.shape, 3 * H) for name in ("dg", "dx"))
    back, dh, started = np.ascontiguousarray(w["u"].T), np.zeros(h.shape, kind), fresh.any(1)
    for t in range(len(before) - 1, -1, -1):
        dh = dh + dstates[t]
        dn = dh * to_cand[t]
        np.multiply(dh, to_z[t], out=dg[t, :, :H])
        np.multiply(dn, to_r[t], out=dg[t, :, H : 2 * H])
        np.multiply(dn, r[t], out=dg[t, :, 2 * H :])
        dx[t, :, 2 * H :] = dn
        dh *= z[t]
        dh += dg[t] @ back
        if started[t]:
            dh[fresh[t]] = 0
    dx[:, :, : 2 * H] = dg[:, :, : 2 * H]
    g["u"] = prior.reshape(-1, H).T @ dg.reshape(-1, 3 * H)
    order = np.argsort(before.astype(np.int16), axis=None, kind="stable")  # a radix sort
    sorted_before = before.ravel()[order]
    edges = np.flatnonzero(np.append(True, sorted_before[1:] != sorted_before[:-1]))
    sorted_dx = np.take(dx.reshape(-1, 3 * H), order, axis=0, mode="clip", out=space("sorted_dx", kind, before.size, 3 * H))
    g["table"] = (sorted_before[edges], np.add.reduceat(sorted_dx, edges))
    return g, states[-1], float((np.log(whole) - got).sum()), n


class Adam:
    """Adam over windows of WINDOW steps; the state at a window's end starts the next, the gradient stops there."""

    def __init__(self, w: dict[str, np.ndarray]) -> None:
        self.w = w
        self.m, self.v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
        self.step, self.space = 0, Space()

    def learn(self, docs: list[np.ndarray], rate: float, width: int) -> None:
        """Changes w by one pass over docs."""
        w, m, v = self.w, self.m, self.v
        symbols, owner = lanes(docs, width)
        h = np.zeros((symbols.shape[1], HIDDEN), np.float32)
        for window in _windows(symbols, owner):
            active = (window[3] >= 0).any(0)  # lanes that have ended stay out
            g, h[active], _, _ = _gradients(w, *(x[:, active] for x in window), h[active], self.space)
            self.step += 1
            size = np.sqrt(sum(float(((x[1] if isinstance(x, tuple) else x) ** 2).sum()) for x in g.values()))
            cut, now = min(1.0, 1.0 / (size + 1e-9)), rate * np.sqrt(1 - 0.99**self.step) / (1 - 0.9**self.step)
            for k, x in g.items():
                at, x = x if isinstance(x, tuple) else (slice(None), x)
                x = x * np.float32(cut)
                m[k][at] = 0.9 * m[k][at] + 0.1 * x
                v[k][at] = 0.99 * v[k][at] + 0.01 * x * x
                w[k][at] -= np.float32(now) * m[k][at] / (np.sqrt(v[k][at]) + 1e-6)


def train(docs: list[np.ndarray], frequency: np.ndarray, epochs: int = 4, rate: float = 0.01, width: int = 48, seed: int = 3) -> dict[str, np.ndarray]:
    """First weights from a few documents that one task holds."""
    rnd = np.random.default_rng(seed)
    w = start(rnd, frequency)
    docs = [d for d in docs if len(d)]
    adam = Adam(w)
    for epoch in range(epochs if docs else 0):
        adam.learn([docs[d] for d in rnd.permutation(len(docs))], rate * (0.3 if epoch == epochs - 1 else 1), width)
    return w


def flattened(w: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in NAMES]).astype(np.float32)


def shaped(values: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The weights that flattened made values of."""
    ends = np.cumsum([like[k].size for k in NAMES])[:-1]
    return {k: x.reshape(like[k].shape).copy() for k, x in zip(NAMES, np.split(values, ends), strict=True)}

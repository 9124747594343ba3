"""A gated recurrent language model in numpy with a class-factored output.

The output is P(class | state) times P(word | class, state) for the words of the model, in
classes of equal size by rank; two further classes hold the other counted words and all rarer
or unknown ones, within which a word's share is that of the corpus counts. Biases start
at the counts' logarithms, so that an untrained model is the smoothed unigram model; training
is truncated backpropagation through windows, with the state carried from window to window.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

#: State, embedding, words of a class, classes, hashed inputs of other words.
HIDDEN, EMBED, WIDTH, CLASSES, BUCKETS = 16, 16, 32, 32, 256
#: Documents side by side and steps of a training window; steps of a scoring window.
LANES, WINDOW, SCORE_WINDOW = 256, 16, 32

NAMES = ("emb", "wx", "bx", "u", "wc", "bc", "wo", "bo")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """The logistic function of ``x``, in its place."""
    np.negative(x, x)
    np.exp(x, x)
    x += 1
    return np.reciprocal(x, x)


def _exponentials(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``x``, its exponentials and each row's sum of them; rows are lowered by their largest values where exponentials might leave the range of floats."""
    ones = np.ones(x.shape[1], x.dtype)
    if not x.size or x.max() <= 40:
        e = np.exp(x)
        total = e @ ones
        if not x.size or total.min() > 1e-17:
            return x, e, total
    x = x - x.max(1, keepdims=True)
    e = np.exp(x)
    return x, e, e @ ones


@dataclass
class Gru:
    """Parameters; words of the model have ids below ``WIDTH * CLASSES``."""

    p: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def start(cls, counts: np.ndarray, listed_mass: float, rare_mass: float, seed: int = 11) -> Gru:
        """From the counts of the model's words by rank, and the other classes' counts."""
        rng = np.random.default_rng(seed)
        inputs = WIDTH * CLASSES + BUCKETS + 1  # words, buckets, the start
        grid = np.zeros(WIDTH * CLASSES)
        grid[: len(counts)] = counts
        grid = grid.reshape(CLASSES, WIDTH)
        mass = np.concatenate([grid.sum(1), [listed_mass, rare_mass]])
        f = lambda x: np.asarray(x, np.float32)
        return cls({
            "emb": f(rng.normal(0, 0.3, (inputs, EMBED))), "wx": f(rng.normal(0, EMBED**-0.5, (EMBED, 3 * HIDDEN))), "bx": f(np.concatenate([np.ones(HIDDEN), np.zeros(2 * HIDDEN)])),
            "u": f(rng.normal(0, HIDDEN**-0.5, (HIDDEN, 3 * HIDDEN))), "wc": np.zeros((HIDDEN, CLASSES + 2), np.float32), "bc": f(np.where(mass > 0, np.log(np.maximum(mass, 1e-9)), -30.0) - np.log(max(1.0, mass.sum()))),
            "wo": np.zeros((CLASSES, HIDDEN, WIDTH), np.float32), "bo": f(np.where(
                grid > 0, np.log(np.maximum(grid, 1e-9)), -1e4,
            ) - np.log(np.maximum(1, grid.sum(1, keepdims=True)))),
        })

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].reshape(-1) for k in NAMES])

    def filled(self, flat: np.ndarray) -> Gru:
        out, at = {}, 0
        for k in NAMES:
            n = self.p[k].size
            out[k] = flat[at : at + n].reshape(self.p[k].shape).astype(np.float32)
            at += n
        return Gru(out)

    def output(
        self, h: np.ndarray, target: np.ndarray, klass: np.ndarray, grads: dict | None = None, scale: float = 1.0,
    ) -> tuple[np.ndarray, np.ndarray | None]:
        """Log-probability (natural) of each row's class, and word where that class has words; with ``grads``, adds gradients and returns that of ``h``."""
        p = self.p
        h = np.concatenate([h, np.ones((len(h), 1), h.dtype)], 1)  # biases are the weights of a column of ones
        x, e, total = _exponentials(h @ np.concatenate([p["wc"], p["bc"][None]]))
        rows = np.arange(len(h))
        logp = (x[rows, klass] - np.log(total)).astype(np.float64)
        dh = None
        if grads is not None:
            e *= (scale / total)[:, None]
            e[rows, klass] -= scale
            slope = h.T @ e
            grads["wc"] += slope[:HIDDEN]
            grads["bc"] += slope[HIDDEN]
            dh = e @ p["wc"].T
        order = np.argsort(klass.astype(np.uint16), kind="stable")  # 16 bits are sorted by radix
        cuts = np.concatenate([[0], np.cumsum(np.bincount(klass, minlength=CLASSES + 2))[:CLASSES]])
        order = order[: cuts[-1]]  # rows of words of the model, class by class
        if not len(order):
            return logp, dh
        spans = [(c, int(cuts[c]), int(cuts[c + 1])) for c in np.flatnonzero(np.diff(cuts)).tolist()]
        hs, word = h.take(order, 0), target.take(order) - klass.take(order) * WIDTH
        weights = np.concatenate([p["wo"], p["bo"][:, None]], 1)
        y = np.empty((len(order), WIDTH), np.result_type(h, weights))
        for c, a, b in spans:
            np.matmul(hs[a:b], weights[c], y[a:b])
        y, f, total = _exponentials(y)
        rows = rows[: len(order)]
        logp[order] += y[rows, word] - np.log(total)
        if grads is not None:
            f *= (scale / total)[:, None]
            f[rows, word] -= scale
            back, slope = np.empty((len(order), HIDDEN), y.dtype), np.zeros(weights.shape, y.dtype)
            for c, a, b in spans:
                np.matmul(hs[a:b].T, f[a:b], slope[c])
                np.matmul(f[a:b], p["wo"][c].T, back[a:b])
            grads["wo"] += slope[:, :HIDDEN]
            grads["bo"] += slope[:, HIDDEN]
            dh[order] += back
        return logp, dh


def _lengths_down(lengths: np.ndarray) -> np.ndarray:
    return np.argsort(-lengths, kind="stable")


def _to_gates(p: dict[str, np.ndarray]) -> np.ndarray:
    """What turns embeddings, a column an input with a one below, into what they add to the gates."""
    return np.concatenate([p["wx"], p["bx"][None]]).T.copy()


def _embedded(emb: np.ndarray) -> np.ndarray:
    """Embeddings, a column an input with a one below."""
    return np.concatenate([emb, np.ones((len(emb), 1), emb.dtype)], 1).T.copy()


def _step(gates: np.ndarray, u: np.ndarray, old: np.ndarray) -> tuple[np.ndarray, ...]:
    """One token of documents side by side, a column each, so that all arithmetic runs along them: ``gates`` are the inputs' and are used up.

    Gives the old state, what it adds to the candidate, both gates, the candidate and the new state.
    """
    own = u @ old
    zr = gates[: 2 * HIDDEN]
    zr += own[: 2 * HIDDEN]
    _sigmoid(zr)
    z, r, c, own = zr[:HIDDEN], zr[HIDDEN:], gates[2 * HIDDEN :], own[2 * HIDDEN :]
    c += r * own
    np.tanh(c, c)
    new = old - c
    new *= z
    new += c
    return old, own, z, r, c, new


def score(model: Gru, inputs: np.ndarray, targets: np.ndarray, classes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Natural log-probability of each document's classes and model words; documents follow each other in the arrays."""
    p, order = model.p, _lengths_down(lengths)
    emb, wx, u = _embedded(p["emb"]), _to_gates(p), p["u"].T.copy()
    starts, size = (np.cumsum(lengths) - lengths)[order], lengths[order]
    out, h, longest, t = np.zeros(len(lengths)), np.zeros((HIDDEN, len(lengths)), np.float32), int(size.max(initial=0)), 0
    live = np.searchsorted(-size, -np.arange(longest), "left")  # documents longer than t
    while t < longest:
        states, places, who = [], [], []
        room = 0
        for t in range(t, min(longest, t + SCORE_WINDOW)):  # noqa: B020
            n = int(live[t])
            at = starts[:n] + t
            h = _step(wx @ emb.take(inputs.take(at), 1), u, h[:, :n])[-1]
            states.append(h)
            places.append(at)
            who.append(np.arange(n))
            room += n
            if room > 65_536:
                break
        t += 1
        places, who = np.concatenate(places), np.concatenate(who)
        logp, _ = model.output(np.concatenate(states, 1).T, targets.take(places), classes.take(places))
        out += np.bincount(who, logp, len(out))
    result = np.zeros(len(lengths))
    result[order] = out
    return result


def _grouped(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """The distinct keys, which of them each key is, and the sorting order with the places where a new key begins."""
    order = np.argsort(key.astype(np.uint16) if WIDTH * CLASSES + BUCKETS < 65_535 else key, kind="stable")  # 16 bits are sorted by radix
    sorted_ = key[order]
    new = np.concatenate([[True], sorted_[1:] != sorted_[:-1]])
    place = np.empty(len(key), np.int64)
    place[order] = np.cumsum(new) - 1
    return sorted_[new], place, (order, np.flatnonzero(new))


def train(
    model: Gru, inputs: np.ndarray, targets: np.ndarray, classes: np.ndarray, lengths: np.ndarray, rate: float = 0.1, seed: int = 5,
) -> tuple[Gru, int]:
    """One pass of truncated backpropagation over documents of similar length side by side; (model, tokens seen).

    Steps are AdaGrad's. What an input adds to the gates is looked up in a table made once a window, and its gradient goes to
    the embeddings of the window's inputs only.
    """
    p = {k: v.copy() for k, v in model.p.items()}
    model = Gru(p)
    past = {k: np.full(v.shape, 1e-3, np.float32) for k, v in p.items()}
    order, starts = _lengths_down(lengths), np.cumsum(lengths) - lengths
    groups = [order[k : k + LANES] for k in range(0, len(order), LANES)]
    np.random.default_rng(seed).shuffle(groups)
    seen = 0
    dense = [k for k in NAMES if k != "emb"]
    grads = {k: np.zeros_like(p[k]) for k in dense}
    for group in groups:
        size, first = lengths[group], starts[group]
        longest = int(size.max())
        live = np.searchsorted(-size, -np.arange(longest), "left")  # documents longer than t
        h = np.zeros((HIDDEN, len(group)), np.float32)
        for begin in range(0, longest, WINDOW):
            kept, wx, u = [], _to_gates(p), p["u"].T.copy()
            at = [first[: int(live[t])] + t for t in range(begin, min(longest, begin + WINDOW))]
            places = np.concatenate(at)
            used, place, (order_, starts_) = _grouped(inputs.take(places))
            emb = p["emb"].take(used, 0)
            read, done = _embedded(emb).take(place, 1), 0
            for a in at:
                n = len(a)
                kept.append(_step(wx @ read[:, done : done + n], u, h[:, :n]))
                h = kept[-1][-1]
                done += n
            seen += done
            for g in grads.values():
                g[...] = 0
            _, dh_all = model.output(np.concatenate([k[-1] for k in kept], 1).T, targets.take(places), classes.take(places), grads, 1 / done)
            dh_all = np.ascontiguousarray(dh_all.T)
            d_gates, d_state = np.empty((3, HIDDEN, done), np.float32), np.empty((HIDDEN, done), np.float32)
            carry, end = np.zeros((HIDDEN, 0), np.float32), done
            for old, own, z, r, c, new in reversed(kept):
                n = new.shape[1]
                step = slice(end - n, end)
                dh, g = dh_all[:, step], np.empty((3, HIDDEN, n), np.float32)
                dh[:, : carry.shape[1]] += carry
                keep = dh * z
                dc = dh - keep
                dc *= 1 - c * c
                d_gates[2, :, step] = dc
                np.subtract(old, c, g[0])
                g[0] *= keep
                g[0] *= 1 - z
                dr = dc * r
                np.multiply(dr, own, g[1])
                g[1] *= 1 - r
                g[2] = dr
                d_gates[:2, :, step], d_state[:, step] = g[:2], dr
                carry = p["u"] @ g.reshape(3 * HIDDEN, n)
                carry += keep
                end -= n
            olds = np.concatenate([k[0] for k in kept], 1)
            grads["u"][:, : 2 * HIDDEN] += olds @ d_gates[:2].reshape(2 * HIDDEN, done).T
            grads["u"][:, 2 * HIDDEN :] += olds @ d_state.T
            d_gates = d_gates.reshape(3 * HIDDEN, done)
            slope = read @ d_gates.T
            grads["wx"] += slope[:EMBED]
            grads["bx"] += slope[EMBED]
            d_emb = np.add.reduceat((p["wx"] @ d_gates).take(order_, 1), starts_, axis=1).T  # in the order of ``used``
            norm = np.sqrt(sum(float(np.vdot(g, g)) for g in grads.values()) + float((d_emb * d_emb).sum()))
            cut = min(1.0, 1.0 / (norm + 1e-9))
            for k in dense:
                g = grads[k]
                g *= cut
                past[k] += g * g
                p[k] -= rate * g / np.sqrt(past[k])
            d_emb *= cut
            stepped = past["emb"].take(used, 0)
            stepped += d_emb * d_emb
            past["emb"][used] = stepped
            p["emb"][used] = emb - rate * d_emb / np.sqrt(stepped)
    return model, seen

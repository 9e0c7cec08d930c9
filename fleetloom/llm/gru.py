"""A gated recurrent language model in numpy with a class-factored output."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Order and shapes of the parameters for v input rows, c classes, s words in a head class, h units.
NAMES = ("table", "gates", "cand", "by_class", "class_bias", "by_word", "word_bias")


@dataclass(frozen=True)
class Shape:
    """Input rows: one for each head word, then one for each tail class. Head words fill `head_classes`
    of `class_words` each, by frequency; the other words fall into tail classes by their last bytes."""

    head_classes: int = 32
    class_words: int = 32
    tail_classes: int = 32
    units: int = 16

    @property
    def head(self) -> int:
        return self.head_classes * self.class_words

    @property
    def rows(self) -> int:
        return self.head + self.tail_classes

    @property
    def classes(self) -> int:
        return self.head_classes + self.tail_classes

    def shapes(self) -> dict[str, tuple[int, ...]]:
        h = self.units
        return {
            "table": (self.rows, 3 * h),
            "gates": (h, 2 * h),
            "cand": (h, h),
            "by_class": (h, self.classes),
            "class_bias": (self.classes,),
            "by_word": (self.head_classes, h, self.class_words),
            "word_bias": (self.head_classes, self.class_words),
        }

    def classed(self, tokens: np.ndarray) -> np.ndarray:
        return np.where(tokens < self.head, tokens // self.class_words, self.head_classes + tokens - self.head)


def start(shape: Shape, class_counts: np.ndarray, head_counts: np.ndarray, seed: int = 8) -> dict[str, np.ndarray]:
    """The model that knows word frequencies and no context yet."""
    rng = np.random.Generator(np.random.PCG64(seed))
    out = {n: (rng.standard_normal(s) * 0.1).astype(np.float32) for n, s in shape.shapes().items()}
    out["by_class"] *= 0.1
    out["by_word"] *= 0.1
    out["class_bias"] = np.log((class_counts + 0.5) / (class_counts + 0.5).sum()).astype(np.float32)
    heads = head_counts.reshape(shape.head_classes, shape.class_words) + 0.5
    out["word_bias"] = np.log(heads / heads.sum(axis=1, keepdims=True)).astype(np.float32)
    return out


def flat(params: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([params[n].ravel() for n in NAMES])


def unflat(shape: Shape, values: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for n, s in shape.shapes().items():
        size = int(np.prod(s))
        out[n] = values[at : at + size].reshape(s).astype(np.float32)
        at += size
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x -= x.max(axis=1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


def step(p: dict[str, np.ndarray], x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One step of all lanes: the new state, the gates, the candidate, and what the reset gate scales."""
    units = h.shape[1]
    gates = h @ p["gates"]
    gates += x[:, : 2 * units]
    gates = _sigmoid(gates)
    inner = h @ p["cand"]
    cand = gates[:, units:] * inner
    cand += x[:, 2 * units :]
    np.tanh(cand, out=cand)
    new = cand - h
    new *= gates[:, :units]
    new += h
    return new, gates, cand, inner


def outputs(p: dict[str, np.ndarray], shape: Shape, h: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Natural log probability of each token after its state: of its class, and of a head word within it."""
    classes = shape.classed(tokens)
    logits = h @ p["by_class"]
    logits += p["class_bias"]
    logits = np.exp(logits, out=logits)
    picked = logits[np.arange(len(tokens)), classes]
    out = np.log(picked / logits.sum(axis=1)).astype(np.float64)
    order = np.argsort(classes, kind="stable")
    cuts = np.searchsorted(classes[order], np.arange(shape.head_classes + 1))
    for c in range(shape.head_classes):
        rows = order[cuts[c] : cuts[c + 1]]
        if len(rows):
            inner = np.exp(h[rows] @ p["by_word"][c] + p["word_bias"][c])
            out[rows] += np.log(inner[np.arange(len(rows)), tokens[rows] - c * shape.class_words] / inner.sum(axis=1))
    return out


def scores(p: dict[str, np.ndarray], shape: Shape, texts: list[np.ndarray], window: int = 32) -> np.ndarray:
    """Log probability of whole token sequences. The state goes on from window to window to each one's end."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    sizes = np.array([len(texts[i]) for i in order], np.int64)
    total = np.zeros(len(texts))
    if not len(texts):
        return total
    flat_, starts = np.concatenate([texts[i] for i in order]).astype(np.int64), np.cumsum(sizes) - sizes
    h = np.zeros((len(order), shape.units), np.float32)
    states, asked, whose = [], [], []
    held = 0
    for t in range(int(sizes[0])):
        n = int(np.searchsorted(-sizes, -t, "left"))  # sequences with over t tokens come first
        now = flat_[starts[:n] + t]
        h = h[:n]
        states.append(h)
        asked.append(now)
        whose.append(n)
        held += n
        if held >= 8192 * window // 32 or t + 1 == sizes[0]:
            got = outputs(p, shape, np.concatenate(states), np.concatenate(asked))
            at = 0
            for m in whose:
                total[:m] += got[at : at + m]
                at += m
            states, asked, whose, held = [], [], [], 0
        if t + 1 < sizes[0]:
            h = step(p, p["table"][now], h)[0]
    out = np.zeros(len(texts))
    out[order] = total
    return out


class Trainer:
    """Truncated backpropagation over windows of a stream of documents, with Adam."""

    def __init__(self, params: dict[str, np.ndarray], shape: Shape, rate: float = 0.01):
        self.p = {n: v.copy() for n, v in params.items()}
        self.shape, self.rate, self.steps = shape, rate, 0
        self.m = {n: np.zeros_like(v) for n, v in self.p.items()}
        self.v = {n: np.zeros_like(v) for n, v in self.p.items()}

    def run(self, texts: list[np.ndarray], window: int = 16, most_lanes: int = 1024, least_updates: int = 40) -> int:
        """Learns from all tokens of texts once; how many they were."""
        stream = np.concatenate(texts).astype(np.int64) if texts else np.zeros(0, np.int64)
        n = len(stream)
        if not n:
            return 0
        first = np.zeros(n, bool)
        first[np.cumsum([0] + [len(t) for t in texts[:-1]])] = True
        lanes = int(min(most_lanes, max(8, n // (window * least_updates))))
        length = -(-n // lanes)
        pad = lanes * length - n
        real = np.concatenate([np.ones(n, bool), np.zeros(pad, bool)]).reshape(lanes, length)
        stream = np.concatenate([stream, np.zeros(pad, np.int64)]).reshape(lanes, length)
        first = np.concatenate([first, np.ones(pad, bool)]).reshape(lanes, length)
        h = np.zeros((lanes, self.shape.units), np.float32)
        for at in range(0, length, window):
            h = self._window(stream[:, at : at + window], first[:, at : at + window], real[:, at : at + window], h)
        return n

    def _window(self, tokens: np.ndarray, first: np.ndarray, real: np.ndarray, h: np.ndarray) -> np.ndarray:
        """tokens are predicted from the state before them; a document's first one from the zero state."""
        p, shape, units = self.p, self.shape, self.shape.units
        lanes, width = tokens.shape
        before, kept = [], []
        for t in range(width):
            h = h * ~first[:, t, None]
            before.append(h)
            new, gates, cand, inner = step(p, p["table"][tokens[:, t]], h)
            kept.append((gates, cand, inner))
            h = new
        grads = {n: np.zeros_like(v) for n, v in p.items()}
        states = np.concatenate(before)
        asked, weight = tokens.T.ravel(), real.T.ravel()
        d_states = self._output_grads(states, asked, weight, grads).reshape(width, lanes, units)
        d_x = np.zeros((width, lanes, 3 * units), np.float32)
        d_h = np.zeros((lanes, units), np.float32)
        for t in range(width - 1, -1, -1):
            gates, cand, inner = kept[t]
            z, r, old = gates[:, :units], gates[:, units:], before[t]
            d_cand = d_h * z * (1 - cand * cand)
            d_gates = np.empty_like(gates)
            d_gates[:, :units] = d_h * (cand - old)
            d_gates[:, units:] = d_cand * inner
            d_gates *= gates * (1 - gates)
            d_inner = d_cand * r
            grads["cand"] += old.T @ d_inner
            grads["gates"] += old.T @ d_gates
            d_x[t, :, : 2 * units], d_x[t, :, 2 * units :] = d_gates, d_cand
            d_h = d_h * (1 - z) + d_inner @ p["cand"].T + d_gates @ p["gates"].T + d_states[t]
            d_h *= ~first[:, t, None]
        d_x = d_x.reshape(-1, 3 * units)
        order = np.argsort(asked, kind="stable")
        ranked = asked[order]
        begins = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        grads["table"][ranked[begins]] = np.add.reduceat(d_x[order], begins, axis=0)
        self._adam(grads, max(1, int(weight.sum())))
        return h

    def _output_grads(self, h: np.ndarray, tokens: np.ndarray, weight: np.ndarray, grads: dict[str, np.ndarray]) -> np.ndarray:
        p, shape = self.p, self.shape
        classes = shape.classed(tokens)
        logits = np.exp(h @ p["by_class"] + p["class_bias"])
        logits /= logits.sum(axis=1, keepdims=True)
        logits[np.arange(len(tokens)), classes] -= 1
        logits *= weight[:, None]
        grads["by_class"] += h.T @ logits
        grads["class_bias"] += logits.sum(axis=0)
        d = logits @ p["by_class"].T
        order = np.argsort(classes, kind="stable")
        cuts = np.searchsorted(classes[order], np.arange(shape.head_classes + 1))
        for c in range(shape.head_classes):
            rows = order[cuts[c] : cuts[c + 1]]
            if not len(rows):
                continue
            mine = h[rows]
            inner = np.exp(mine @ p["by_word"][c] + p["word_bias"][c])
            inner /= inner.sum(axis=1, keepdims=True)
            inner[np.arange(len(rows)), tokens[rows] - c * shape.class_words] -= 1
            inner *= weight[rows, None]
            grads["by_word"][c] = mine.T @ inner
            grads["word_bias"][c] = inner.sum(axis=0)
            d[rows] += inner @ p["by_word"][c].T
        return d

    def _adam(self, grads: dict[str, np.ndarray], n: int) -> None:
        self.steps += 1
        scale = self.rate * np.sqrt(1 - 0.99**self.steps) / (1 - 0.9**self.steps)
        for name, g in grads.items():
            g /= n
            m, v = self.m[name], self.v[name]
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            self.p[name] -= (scale * m / (np.sqrt(v) + 1e-6)).astype(np.float32)

"""A gated recurrent language model with a class-factored softmax, in numpy.

Input is the code of the word before, the state is carried from window to window of a text, and the output is a class and, for
the commonest words, the word within its class. Texts are dealt to lanes, longest first, so that one step advances many texts;
a lane resets its state where a text begins. Training propagates errors back through one window.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

STEPS, LANES = 32, 256
WIDE = 1024  # lanes where nothing is learnt


@dataclass(frozen=True)
class Shape:
    """Codes below ``classes * width`` are common words, class by class; the others are a class each."""

    classes: int = 24
    width: int = 32
    others: int = 16
    hidden: int = 16

    @property
    def common(self) -> int:
        return self.classes * self.width

    @property
    def codes(self) -> int:
        return self.common + self.others

    def sizes(self) -> dict[str, tuple[int, ...]]:
        h = self.hidden
        return {"input": (self.codes + 1, 3 * h), "state": (h, 3 * h), "to_class": (h, self.classes + self.others), "class_bias": (self.classes + self.others,), "to_word": (self.classes, h, self.width), "word_bias": (self.classes, self.width)}


def initial(shape: Shape, counts: np.ndarray, seed: int = 11) -> np.ndarray:
    """Parameters that give each code its share of ``counts``, whatever the state."""
    rng = np.random.default_rng(seed)
    own = counts[: shape.common].reshape(shape.classes, shape.width).astype(np.float64)
    mass = np.concatenate([own.sum(axis=1), counts[shape.common :]]) + 0.5
    parts = {k: 0.1 * rng.standard_normal(s) for k, s in shape.sizes().items()}
    parts["class_bias"] = np.log(mass / mass.sum())
    parts["word_bias"] = np.where(own > 0, np.log(np.maximum(own, 1e-9) / np.maximum(own.sum(axis=1, keepdims=True), 1e-9)), -40.0)
    return np.concatenate([parts[k].ravel() for k in shape.sizes()]).astype(np.float32)


def views(shape: Shape, flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in shape.sizes().items():
        n = int(np.prod(s))
        out[k] = flat[at : at + n].reshape(s)
        at += n
    return out


def lanes(sizes: list[int], most: int = LANES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the texts, and start and length of each lane in the joined texts of that order; long lanes first."""
    count = max(1, min(most, len(sizes)))
    load = [(0, i) for i in range(count)]
    held: list[list[int]] = [[] for _ in range(count)]
    for t in sorted(range(len(sizes)), key=lambda t: -sizes[t]):
        n, i = heapq.heappop(load)
        held[i].append(t)
        heapq.heappush(load, (n + sizes[t], i))
    length = {i: n for n, i in load}
    order = sorted(range(count), key=lambda i: -length[i])
    lengths = np.array([length[i] for i in order], dtype=np.int64)
    return np.array([t for i in order for t in held[i]], dtype=np.int64), np.cumsum(lengths) - lengths, lengths


class Model:
    def __init__(self, shape: Shape, flat: np.ndarray):
        self.shape, self.flat = shape, np.array(flat, dtype=np.float32)
        self.p = views(shape, self.flat)
        self.step = 0
        self.first, self.second = np.zeros_like(self.flat), np.zeros_like(self.flat)

    def _windows(self, codes: list[np.ndarray], most: int = LANES) -> Iterator[tuple]:
        """Windows over all lanes: inputs, resets, targets and their places in the joined texts, and which places are real."""
        order, start, length = lanes([len(c) for c in codes], most)
        flat = np.concatenate([codes[t] for t in order]) if len(order) else np.zeros(0, dtype=np.int32)
        begin = np.zeros(len(flat), dtype=bool)
        sizes = np.array([len(codes[t]) for t in order], dtype=np.int64)
        begin[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
        before = np.concatenate([[self.shape.codes], flat[:-1]]) if len(flat) else flat
        before = np.where(begin, self.shape.codes, before)
        text = np.repeat(order, sizes)
        for t in range(0, int(length[0]) if len(length) else 0, STEPS):
            active = int(np.searchsorted(-length, -t))
            steps = int(min(STEPS, length[0] - t))
            place = start[:active] + np.arange(t, t + steps)[:, None]
            real = np.arange(t, t + steps)[:, None] < length[:active]
            place = np.where(real, place, 0)
            yield before[place], begin[place] & real, flat[place], text[place], real, active

    def _forward(self, x: np.ndarray, reset: np.ndarray, h: np.ndarray) -> dict[str, np.ndarray]:
        n, a = x.shape
        k, p = self.shape.hidden, self.p
        ax = p["input"][x]
        ax[:, :, : 2 * k] *= 0.5  # the gates are logistic: half a hyperbolic tangent of half the sum
        state = p["state"].copy()
        state[:, : 2 * k] *= 0.5
        s = {name: np.empty((n, a, k), dtype=np.float32) for name in ("prev", "n", "h")}
        s["zr"], s["g"] = np.empty((n, a, 2 * k), dtype=np.float32), np.empty((n, a, 3 * k), dtype=np.float32)
        keep = (~reset).astype(np.float32)
        for t in range(n):
            prev, zr, g, c, out = s["prev"][t], s["zr"][t], s["g"][t], s["n"][t], s["h"][t]
            np.multiply(h, keep[t][:, None], out=prev)
            np.matmul(prev, state, out=g)
            np.add(ax[t, :, : 2 * k], g[:, : 2 * k], out=zr)
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            np.multiply(zr[:, k:], g[:, 2 * k :], out=c)
            c += ax[t, :, 2 * k :]
            np.tanh(c, out=c)
            np.subtract(prev, c, out=out)
            out *= zr[:, :k]
            out += c
            h = out
        s["keep"], s["last"] = keep, h
        return s

    def _states(self, x: np.ndarray, reset: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The states alone, in arrays that are used again from step to step."""
        n, a = x.shape
        k, p = self.shape.hidden, self.p
        ax = p["input"][x]
        ax[:, :, : 2 * k] *= 0.5  # the gates are logistic: half a hyperbolic tangent of half the sum
        state = p["state"].copy()
        state[:, : 2 * k] *= 0.5
        out = np.empty((n, a, k), dtype=np.float32)
        g, zr = np.empty((a, 3 * k), dtype=np.float32), np.empty((a, 2 * k), dtype=np.float32)
        for t in range(n):
            if reset[t].any():
                h = np.where(reset[t][:, None], np.float32(0), h)
            np.matmul(h, state, out=g)
            np.add(ax[t, :, : 2 * k], g[:, : 2 * k], out=zr)
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            c = zr[:, k:] * g[:, 2 * k :]
            c += ax[t, :, 2 * k :]
            np.tanh(c, out=c)
            d = out[t]
            np.subtract(h, c, out=d)
            d *= zr[:, :k]
            d += c
            h = d
        return out

    def _output(self, h: np.ndarray, target: np.ndarray, grads: dict | None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log probability of each target code, and the gradient at the states of their negative sum."""
        shape, p = self.shape, self.p
        rows = np.arange(len(h))
        word = target < shape.common
        cls = np.where(word, target // shape.width, target - shape.common + shape.classes)
        # the states are within 1 and the weights small, so the exponentials need no shift
        logit = h @ p["to_class"] + p["class_bias"]
        chosen = logit[rows, cls]
        e = np.exp(logit, out=logit)
        total = e @ np.ones(e.shape[1], dtype=np.float32)
        out = chosen - np.log(total)
        dh = None
        if grads is not None:
            e /= total[:, None]
            e[rows, cls] -= 1
            grads["to_class"] += h.T @ e
            grads["class_bias"] += np.ones(len(e), dtype=np.float32) @ e
            dh = e @ p["to_class"].T
        at = np.flatnonzero(word)
        short = cls[at].astype(np.int16)  # such numbers are sorted by radix
        at = at[np.argsort(short, kind="stable")]
        edges = np.cumsum(np.bincount(short, minlength=shape.classes)[: shape.classes])
        edges = np.concatenate([[0], edges])
        hs, inner = h[at], target[at] % shape.width
        ones, many = np.ones(shape.width, dtype=np.float32), np.ones(len(at), dtype=np.float32)
        for c in range(shape.classes):
            a, b = edges[c], edges[c + 1]
            if a == b:
                continue
            own, w = hs[a:b], inner[a:b]
            logit = own @ p["to_word"][c] + p["word_bias"][c]
            r = np.arange(b - a)
            chosen = logit[r, w]
            e = np.exp(logit, out=logit)
            total = e @ ones
            out[at[a:b]] += chosen - np.log(total)
            if grads is not None:
                e /= total[:, None]
                e[r, w] -= 1
                grads["to_word"][c] += own.T @ e
                grads["word_bias"][c] += many[: b - a] @ e
                dh[at[a:b]] += e @ p["to_word"][c].T
        return out, dh

    def log_likelihoods(self, codes: list[np.ndarray]) -> np.ndarray:
        """Natural log probability of the codes of each whole text."""
        sums = np.zeros(len(codes))
        h = None
        for x, reset, target, text, real, active in self._windows(codes, WIDE):
            h = np.zeros((active, self.shape.hidden), dtype=np.float32) if h is None else h[:active]
            states = self._states(x, reset, h)
            h = states[-1]
            flat = real.ravel()
            out, _ = self._output(states.reshape(-1, self.shape.hidden)[flat], target.ravel()[flat], None)
            sums += np.bincount(text.ravel()[flat], weights=out, minlength=len(codes))
        return sums

    def train(self, codes: list[np.ndarray], rate: float = 0.01) -> int:
        """One pass over the texts; the number of tokens seen. Few texts take fewer lanes, for more steps."""
        seen, h, k = 0, None, self.shape.hidden
        most = max(64, min(LANES, sum(map(len, codes)) // (64 * STEPS)))
        for x, reset, target, _, real, active in self._windows(codes, most):
            h = np.zeros((active, k), dtype=np.float32) if h is None else h[:active]
            s = self._forward(x, reset, h)
            h = s["last"]
            flat = real.ravel()
            n = int(flat.sum())
            grad = np.zeros_like(self.flat)
            g = views(self.shape, grad)
            _, dh = self._output(s["h"].reshape(-1, k)[flat], target.ravel()[flat], g)
            into = np.zeros((len(flat), k), dtype=np.float32)
            into[flat] = dh
            self._backward(x, s, into.reshape(*x.shape, k), g)
            seen += n
            grad /= n
            size = float(np.sqrt((grad * grad).sum()))
            if size > 1:
                grad /= size
            self.step += 1
            self.first += 0.1 * (grad - self.first)
            self.second += 0.01 * (grad * grad - self.second)
            m, v = self.first / (1 - 0.9**self.step), self.second / (1 - 0.99**self.step)
            self.flat -= rate * min(1.0, n / 3000) * m / (np.sqrt(v) + 1e-6)
        return seen

    def _backward(self, x: np.ndarray, s: dict, into: np.ndarray, g: dict) -> None:
        """Gradients of the recurrent part, back through the window."""
        k, state = self.shape.hidden, self.p["state"]
        turned = np.ascontiguousarray(state.T)
        z, r, c = s["zr"][:, :, :k], s["zr"][:, :, k:], s["n"]
        # what each error is multiplied with, for the whole window at once
        to_c = (1 - z) * (1 - c * c)
        to_z = (s["prev"] - c) * z * (1 - z)
        to_r = s["g"][:, :, 2 * k :] * r * (1 - r)
        dax = np.empty((*x.shape, 3 * k), dtype=np.float32)
        dg = np.empty((*x.shape, 3 * k), dtype=np.float32)
        dh = np.zeros_like(into[0])
        back = np.empty_like(dh)
        for t in range(len(x) - 1, -1, -1):
            dh += into[t]
            d, e = dax[t], dg[t]
            dc = d[:, 2 * k :]
            np.multiply(dh, to_c[t], out=dc)
            np.multiply(dh, to_z[t], out=d[:, :k])
            np.multiply(dc, to_r[t], out=d[:, k : 2 * k])
            e[:, : 2 * k] = d[:, : 2 * k]
            np.multiply(dc, r[t], out=e[:, 2 * k :])
            np.matmul(e, turned, out=back)
            dh *= z[t]
            dh += back
            dh *= s["keep"][t][:, None]
        g["state"] += s["prev"].reshape(-1, k).T @ dg.reshape(-1, 3 * k)
        codes, rows = x.ravel().astype(np.int16 if self.shape.codes < 2**15 else np.int32), dax.reshape(-1, 3 * k)
        order = np.argsort(codes, kind="stable")
        own = codes[order]
        edges = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        g["input"][own[edges]] += np.add.reduceat(rows[order], edges, axis=0)

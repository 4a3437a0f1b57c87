"""Small networks on numpy: dense blocks with batch normalisation and dropout, a variational
autoencoder and a one-class encoder.  They train on the driver and score in Arrow batches."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

Params = dict[str, np.ndarray]


class Adam:
    """Adam with the gradient's norm clipped and, if asked, weight decay."""

    def __init__(self, params: Params, rate: float, decay: float = 0.0, clip: float | None = 1.0) -> None:
        self.p, self.rate, self.decay, self.clip, self.t = params, rate, decay, clip, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: Params) -> None:
        norm = math.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        scale = 1.0 if self.clip is None else min(1.0, self.clip / (norm + 1e-12))
        self.t += 1
        for k, g in grads.items():
            g = g * scale + self.decay * self.p[k]
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.999 * self.v[k] + 0.001 * g * g
            self.p[k] -= self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)


def act(z: np.ndarray) -> np.ndarray:
    return np.where(z > 0, z, 0.1 * z)


def slope(z: np.ndarray) -> np.ndarray:
    return np.where(z > 0, 1.0, 0.1)


def dense(rng: np.random.Generator, a: int, b: int) -> np.ndarray:
    return rng.normal(0, math.sqrt(2 / a), (a, b))


class Block:
    """A dense layer, batch normalisation, a leaky rectifier and dropout."""

    EPS, KEEP = 1e-5, 0.9

    def __init__(self, name: str, dropout: float) -> None:
        self.name, self.dropout = name, dropout

    def create(self, rng: np.random.Generator, a: int, b: int) -> tuple[Params, Params]:
        """Parameters, and the running moments that scoring normalises by."""
        n = self.name
        return {f"{n}w": dense(rng, a, b), f"{n}b": np.zeros(b), f"{n}g": np.ones(b), f"{n}o": np.zeros(b)}, {f"{n}m": np.zeros(b), f"{n}v": np.ones(b)}

    def forward(self, p: Params, state: Params, x: np.ndarray, rng: np.random.Generator | None):
        n = self.name
        z = x @ p[f"{n}w"] + p[f"{n}b"]
        if rng is None or len(z) < 2:
            mean, var = state[f"{n}m"], state[f"{n}v"]
        else:
            mean, var = z.mean(0), z.var(0)
            state[f"{n}m"] = self.KEEP * state[f"{n}m"] + (1 - self.KEEP) * mean
            state[f"{n}v"] = self.KEEP * state[f"{n}v"] + (1 - self.KEEP) * var * len(z) / (len(z) - 1)
        scale = 1 / np.sqrt(var + self.EPS)
        unit = (z - mean) * scale
        y = unit * p[f"{n}g"] + p[f"{n}o"]
        mask = 1.0 if rng is None or not self.dropout else (rng.random(y.shape) >= self.dropout) / (1 - self.dropout)
        return act(y) * mask, (x, unit, scale, y, mask, rng is not None and len(z) > 1)

    def backward(self, p: Params, cache, d: np.ndarray) -> tuple[Params, np.ndarray]:
        x, unit, scale, y, mask, trained = cache
        n = self.name
        d = d * mask * slope(y)
        grads = {f"{n}g": (d * unit).sum(0), f"{n}o": d.sum(0)}
        d = d * p[f"{n}g"]
        if trained:  # the batch's own moments moved with it
            d = d - d.mean(0) - unit * (d * unit).mean(0)
        d = d * scale
        return grads | {f"{n}w": x.T @ d, f"{n}b": d.sum(0)}, d @ p[f"{n}w"].T


@dataclass
class VariationalAutoencoder:
    """Blocks each way around a Gaussian latent; raw is the mean squared error of reconstruction at
    the latent's mean.  The weight of the divergence grows over the first epochs; training stops
    when the error on the validation rows (the train rows without any) no longer falls."""

    hidden: tuple[int, ...] = (128, 64)
    latent: int = 16
    beta: float = 1.0
    warm_up: int = 10
    epochs: int = 40
    batch: int = 256
    rate: float = 1e-3
    dropout: float = 0.2
    patience: int = 5
    seed: int = 42
    p: Params = field(default_factory=dict)
    state: Params = field(default_factory=dict)

    def _blocks(self) -> tuple[list[Block], list[Block]]:
        n = range(len(self.hidden))
        return [Block(f"e{i}", self.dropout) for i in n], [Block(f"d{i}", self.dropout) for i in n]

    def _create(self, rng: np.random.Generator, width: int) -> None:
        for blocks, sizes in zip(self._blocks(), ([width, *self.hidden], [self.latent, *reversed(self.hidden)])):
            for block, a, b in zip(blocks, sizes, sizes[1:]):
                params, state = block.create(rng, a, b)
                self.p |= params
                self.state |= state
        top, low = self.hidden[-1], self.hidden[0]
        self.p |= {"mu": dense(rng, top, self.latent), "mub": np.zeros(self.latent), "lv": dense(rng, top, self.latent) * 0.1, "lvb": np.zeros(self.latent), "out": dense(rng, low, width), "outb": np.zeros(width)}

    def _encode(self, x, rng=None):
        h, caches = x, []
        for block in self._blocks()[0]:
            h, c = block.forward(self.p, self.state, h, rng)
            caches.append(c)
        return h, h @ self.p["mu"] + self.p["mub"], np.clip(h @ self.p["lv"] + self.p["lvb"], -10, 10), caches

    def _decode(self, z, rng=None):
        h, caches = z, []
        for block in self._blocks()[1]:
            h, c = block.forward(self.p, self.state, h, rng)
            caches.append(c)
        return h @ self.p["out"] + self.p["outb"], h, caches

    def gradients(self, x: np.ndarray, eps: np.ndarray, beta: float, rng: np.random.Generator | None) -> tuple[float, Params]:
        """The loss of a batch (squared error a row plus beta times the divergence) and its gradients."""
        p, m = self.p, len(x)
        top, mu, lv, up = self._encode(x, rng)
        y, last, down = self._decode(mu + eps * np.exp(0.5 * lv), rng)
        loss = float(((y - x) ** 2).sum() / m + beta * 0.5 * (np.exp(lv) + mu * mu - 1 - lv).sum() / m)
        d = 2 * (y - x) / m
        g = {"out": last.T @ d, "outb": d.sum(0)}
        d = d @ p["out"].T
        encoder, decoder = self._blocks()
        for block, cache in zip(reversed(decoder), reversed(down)):
            more, d = block.backward(p, cache, d)
            g |= more
        dmu = d + beta * mu / m
        dlv = (d * eps * 0.5 * np.exp(0.5 * lv) + beta * 0.5 * (np.exp(lv) - 1) / m) * (np.abs(lv) < 10)
        g |= {"mu": top.T @ dmu, "mub": dmu.sum(0), "lv": top.T @ dlv, "lvb": dlv.sum(0)}
        d = dmu @ p["mu"].T + dlv @ p["lv"].T
        for block, cache in zip(reversed(encoder), reversed(up)):
            more, d = block.backward(p, cache, d)
            g |= more
        return loss, g

    def fit(self, x: np.ndarray, validation: np.ndarray | None = None) -> "VariationalAutoencoder":
        rng = np.random.default_rng(self.seed)
        self.p, self.state = {}, {}
        self._create(rng, x.shape[1])
        opt, best, kept, wait = Adam(self.p, self.rate), math.inf, None, 0
        check = x if validation is None else validation
        for epoch in range(1, self.epochs + 1):
            order = rng.permutation(len(x))
            for at in range(0, len(x), self.batch):
                b = x[order[at : at + self.batch]]
                if len(b) < self.batch <= len(x):  # the short last batch of several
                    break
                opt.step(self.gradients(b, rng.normal(size=(len(b), self.latent)), self.beta * min(1.0, epoch / self.warm_up), rng)[1])
            loss = float(self.raw(check).mean())
            if loss < best - 1e-6:
                best, wait = loss, 0
                kept = {k: v.copy() for k, v in self.p.items()}, dict(self.state)
            else:
                wait += 1
                if wait >= self.patience:
                    break
        if kept:
            self.p, self.state = kept
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        return ((self._decode(self._encode(x)[1])[0] - x) ** 2).mean(1) if len(x) else np.empty(0)

    def latents(self, x: np.ndarray) -> np.ndarray:
        return self._encode(x)[1]


@dataclass
class DeepSvdd:
    """An encoder without biases, pre-trained as an autoencoder, then drawn to a centre; raw is the
    squared distance to it."""

    hidden: int = 64
    latent: int = 32
    pretrain: int = 50
    epochs: int = 50
    batch: int = 256
    rate: float = 1e-3
    decay: float = 1e-6
    seed: int = 42
    p: Params = field(default_factory=dict)
    centre: np.ndarray = field(default_factory=lambda: np.empty(0))

    def _encode(self, x):
        a = x @ self.p["w0"]
        b = act(a) @ self.p["w1"]
        return act(b) @ self.p["w2"], a, b

    def _back(self, x, a, b, d):
        g = {"w2": act(b).T @ d}
        d = (d @ self.p["w2"].T) * slope(b)
        g["w1"] = act(a).T @ d
        g["w0"] = x.T @ ((d @ self.p["w1"].T) * slope(a))
        return g

    def fit(self, x: np.ndarray) -> "DeepSvdd":
        rng = np.random.default_rng(self.seed)
        self.p = {"w0": dense(rng, x.shape[1], self.hidden), "w1": dense(rng, self.hidden, self.hidden), "w2": dense(rng, self.hidden, self.latent), "o0": dense(rng, self.latent, self.hidden), "o1": dense(rng, self.hidden, x.shape[1])}
        opt = Adam(self.p, self.rate, self.decay, clip=None)
        for _ in range(self.pretrain):
            for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // self.batch)):
                b = x[at]
                z, a0, a1 = self._encode(b)
                h = z @ self.p["o0"]
                d = 2 * (act(h) @ self.p["o1"] - b) / b.size
                g = {"o1": act(h).T @ d}
                d = (d @ self.p["o1"].T) * slope(h)
                g["o0"] = z.T @ d
                opt.step(g | self._back(b, a0, a1, d @ self.p["o0"].T))
        c = self._encode(x)[0].mean(0)
        self.centre = np.where(np.abs(c) < 0.1, np.where(c < 0, -0.1, 0.1), c)
        self.p = {k: self.p[k] for k in ("w0", "w1", "w2")}
        opt = Adam(self.p, self.rate, self.decay, clip=None)
        for _ in range(self.epochs):
            for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // self.batch)):
                z, a0, a1 = self._encode(x[at])
                opt.step(self._back(x[at], a0, a1, 2 * (z - self.centre) / len(at)))
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        return ((self._encode(x)[0] - self.centre) ** 2).sum(1) if len(x) else np.empty(0)

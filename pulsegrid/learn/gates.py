"""Gates: from quality columns to expert weights. Networks, error regressors, classification gates, unsupervised quality."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from pulsegrid.learn.models import Boosted, Isotonic, Logistic, Mixture, Perceptron, Prepare, Ridge, principal

EPS = 1e-9


# Weight maps in numpy, the twins of the Column expressions


def softmax_weights(err: np.ndarray, scale: float | None = None) -> np.ndarray:
    s = (np.nanmedian(err) + EPS if scale is None else scale) + EPS
    z = -err / s
    z = np.where(np.isnan(z), -np.inf, z)
    top = z.max(axis=1, keepdims=True)
    w = np.exp(z - np.where(np.isfinite(top), top, 0))
    return w / (w.sum(axis=1, keepdims=True) + EPS)


def decay_weights(err: np.ndarray, e0: float, tau: float) -> np.ndarray:
    e = np.maximum(err, 0)
    w = np.where(np.isnan(err), 0, np.where(e <= e0, 1, np.exp(-(e - e0) / tau)))
    s = w.sum(axis=1, keepdims=True)
    return np.where(s > 0, w / np.where(s > 0, s, 1), 1 / err.shape[1])


def blended(w: np.ndarray, trust: np.ndarray) -> np.ndarray:
    t = np.clip(trust, 0, 1)
    b = t * w + (1 - t) / w.shape[1]
    return b / b.sum(axis=1, keepdims=True)


def quality_weights(q: np.ndarray, beta: float = 4.0, floor: float = 0.05) -> np.ndarray:
    e = np.exp(beta * (q - q.max(axis=1, keepdims=True)))
    return (1 - q.shape[1] * floor) * e / e.sum(axis=1, keepdims=True) + floor


def sentinel(err: np.ndarray, q: float = 0.95) -> np.ndarray:
    """The value of each column that stands for a missing error, from learning rows."""
    return np.array([np.quantile(c[np.isfinite(c)], q) if np.isfinite(c).any() else 1.0 for c in err.T])


# Error regressors


@dataclass
class Target:
    """standard: z; log: log1p only; quantile: 256-point empirical distribution to a normal; none."""

    kind: str | None = "standard"

    def fit(self, y: np.ndarray) -> Target:
        self.mean, self.std = y.mean(axis=0), np.where(y.std(axis=0) > 0, y.std(axis=0), 1)
        if self.kind == "quantile":
            from statistics import NormalDist

            self.p = np.linspace(0, 1, min(256, len(y)))
            self.z = np.array([NormalDist().inv_cdf(float(np.clip(v, 1e-7, 1 - 1e-7))) for v in self.p])
            self.q = np.quantile(y, self.p, axis=0)
        return self

    def to(self, y: np.ndarray) -> np.ndarray:
        if self.kind == "standard":
            return (y - self.mean) / self.std
        if self.kind == "log":
            return np.log1p(np.maximum(y, 0))
        if self.kind == "quantile":
            return np.stack([np.interp(y[:, j], self.q[:, j], self.z) for j in range(y.shape[1])], axis=1)
        return y

    def back(self, t: np.ndarray) -> np.ndarray:
        if self.kind == "standard":
            return t * self.std + self.mean
        if self.kind == "log":
            return np.expm1(t)
        if self.kind == "quantile":
            return np.stack([np.interp(t[:, j], self.z, self.q[:, j]) for j in range(t.shape[1])], axis=1)
        return t


@dataclass
class BoostedOutputs:
    """One boosted regressor for each output."""

    rounds: int = 80

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedOutputs:
        self.parts = [Boosted("squared", rounds=self.rounds).fit(x, y[:, j]) for j in range(y.shape[1])]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.stack([b.predict(x) for b in self.parts], axis=1)


@dataclass
class ErrorGate:
    """Predicts each expert's error from quality columns: mlp, gb, ridge, xgb or deep (two layers, dropout)."""

    kind: str = "mlp"
    target: str | None = "standard"
    hidden: tuple[int, ...] = (32,)
    alpha: float = 1.0
    seed: int = 0
    params: dict = field(default_factory=dict)

    def fit(self, x: np.ndarray, err: np.ndarray) -> ErrorGate:
        self.sentinel = sentinel(err)
        y = np.where(np.isfinite(err), err, self.sentinel)
        self.map = Target(self.target).fit(y)
        makers = {
            "mlp": lambda: Perceptron(self.hidden, seed=self.seed, **self.params),
            "deep": lambda: Perceptron(**({"hidden": (64, 32), "dropout": 0.1, "rate": 3e-3, "seed": self.seed} | self.params)),
            "gb": lambda: BoostedOutputs(**self.params),
            "xgb": lambda: BoostedOutputs(**({"rounds": 150} | self.params)),
            "ridge": lambda: Ridge(self.alpha),
        }
        if self.kind not in makers:
            raise ValueError(f"unknown gate {self.kind!r}")
        self.model = makers[self.kind]().fit(x, self.map.to(y))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.map.back(self.model.predict(x))


# Gating networks


@dataclass
class GatingNet:
    """tanh layer, softmax over temperature; full-batch descent. alpha shares the loss between routing (towards experts that are
    right) and the blend's log loss; beta penalises one-sided weights."""

    hidden: int = 8
    rate: float = 0.05
    epochs: int = 400
    temperature: float = 1.0
    decay: float = 1e-3
    alpha: float = 0.0
    beta: float = 0.0
    hard: bool = False
    seed: int = 0
    prepare: Prepare = field(default_factory=Prepare)

    def _weights(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hidden layer and weights, rows along the second axis: sums over a few experts then run over whole lines."""
        h = 1 - 2 / (np.exp(np.clip(2 * (self.w1.T @ z.T + self.b1[:, None]), -700, 700)) + 1)  # tanh
        s = (self.w2.T @ h + self.b2[:, None]) / self.temperature
        e = np.exp(s - s.max(axis=0))
        return h, e / e.sum(axis=0)

    def fit(self, x: np.ndarray, p: np.ndarray, y: np.ndarray) -> GatingNet:
        rng = np.random.default_rng(self.seed)
        z = self.prepare.fit(x)(x)
        d, k = z.shape[1], p.shape[1]
        self.w1, self.b1 = rng.normal(0, 1 / np.sqrt(d), (d, self.hidden)), np.zeros(self.hidden)
        self.w2, self.b2 = rng.normal(0, 0.01, (self.hidden, k)), np.zeros(k)
        for _ in range(self.epochs):
            self.move(np.concatenate([g.ravel() for g in self.gradient(z, p, y)]), len(z))
        return self

    def gradient(self, z: np.ndarray, p: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of w1, b1, w2 and b2: sums over rows, without decay."""
        p = np.ascontiguousarray(p.T)
        h, w = self._weights(z)
        f = np.clip((w * p).sum(axis=0), 1e-6, 1 - 1e-6)
        dw = (1 - self.alpha) * ((f - y) / (f * (1 - f))) * p
        if self.beta:
            dw = dw + self.beta * (np.log(w + EPS) + 1)
        ds = w * (dw - (dw * w).sum(axis=0))
        if self.alpha:
            right = 1 - np.abs(p - y)
            route = (right > 0.5).astype(float) if self.hard else right
            ds = ds + self.alpha * (w - route / np.maximum(route.sum(axis=0), EPS))
        ds = ds / self.temperature
        dh = (self.w2 @ ds) * (1 - h * h)
        return (dh @ z).T, dh.sum(axis=1), h @ ds.T, ds.sum(axis=1)

    def move(self, sums: np.ndarray, n: float) -> None:
        """One step by the gradient of ``n`` rows."""
        at = 0
        for name in ("w1", "b1", "w2", "b2"):
            v = getattr(self, name)
            g = sums[at : at + v.size].reshape(v.shape) / n
            setattr(self, name, v - self.rate * (g + self.decay * v if name in ("w1", "w2") else g))
            at += v.size

    def weights(self, x: np.ndarray) -> np.ndarray:
        return self._weights(self.prepare(x))[1].T

    def predict(self, x: np.ndarray, p: np.ndarray) -> np.ndarray:
        return (self.weights(x) * p).sum(axis=1)


def reliability_gate(**kw) -> GatingNet:
    """The gating network with a routing term: soft targets and no entropy penalty unless asked for."""
    return GatingNet(**({"alpha": 0.5, "beta": 0.0, "hard": False} | kw))


# Classification gate


@dataclass
class ClassGate:
    """Per expert: is the window good, i.e. valid with an error up to the learning median? Weights are those probabilities, at least
    0.001; an expert with fewer than 20 good windows weighs 1 before the row is divided by its sum."""

    clf: str = "lr"

    def fit(self, x: np.ndarray, err: np.ndarray) -> ClassGate:
        self.parts = []
        for e in err.T:
            ok = np.isfinite(e)
            good = np.zeros(len(e))
            good[ok] = e[ok] <= np.median(e[ok]) if ok.any() else 0
            enough = good.sum() >= 20 and good.sum() < len(good)
            self.parts.append((Logistic() if self.clf == "lr" else Boosted()).fit(x, good) if enough else None)
        return self

    def weights(self, x: np.ndarray) -> np.ndarray:
        w = np.stack([np.ones(len(x)) if m is None else np.maximum(m.predict(x), 1e-3) for m in self.parts], axis=1)
        return w / w.sum(axis=1, keepdims=True)


# Error prediction with nested calibration


@dataclass
class ErrorPrediction:
    """Calibrated experts, a network that predicts their absolute or squared error, and decaying weights."""

    squared: bool = False
    e0: float = 0.15
    tau: float = 0.25
    hidden: tuple[int, ...] = (128, 64)
    seed: int = 0

    def fit(self, x: np.ndarray, p: np.ndarray, y: np.ndarray) -> ErrorPrediction:
        self.maps = [Isotonic().fit(c, y.astype(float)) for c in p.T]
        q = self.calibrated(p)
        err = np.abs(q - y[:, None])
        self.net = Perceptron(self.hidden, rate=3e-3, epochs=80, seed=self.seed).fit(x, err**2 if self.squared else err)
        return self

    def calibrated(self, p: np.ndarray) -> np.ndarray:
        return np.stack([m.predict(c) for m, c in zip(self.maps, p.T, strict=True)], axis=1)

    def weights(self, x: np.ndarray) -> np.ndarray:
        return decay_weights(self.net.predict(x), self.e0, self.tau)

    def predict(self, x: np.ndarray, p: np.ndarray) -> np.ndarray:
        return (self.weights(x) * self.calibrated(p)).sum(axis=1)


# Unsupervised quality


def unit_scale(v: np.ndarray, ref: np.ndarray, low: float = 0.05, high: float = 0.95) -> np.ndarray:
    a, b = np.quantile(ref, [low, high])
    return np.clip((v - a) / (b - a), 0, 1) if b > a else np.full(len(v), 0.5)


@dataclass
class Quality:
    """One quality score from several columns without labels: first principal component, or the better of two Gaussians; turned so that it
    rises with the anchor column, scaled by its 5th and 95th percentile."""

    method: str = "pca"

    def fit(self, x: np.ndarray, anchor: np.ndarray) -> Quality:
        self.prepare = Prepare().fit(x)
        z = self.prepare(x)
        if self.method == "gmm":
            self.model = Mixture().fit(z)
        else:
            self.centre = z.mean(axis=0)
            self.direction = principal(z)[1]
        raw = self._raw(z)
        ok = np.isfinite(anchor)
        c = np.corrcoef(raw[ok], anchor[ok])[0, 1] if ok.sum() > 2 and raw[ok].std() > 0 and anchor[ok].std() > 0 else 1.0
        self.sign = -1.0 if c < 0 else 1.0
        self.ref = self.sign * raw
        return self

    def _raw(self, z: np.ndarray) -> np.ndarray:
        return self.model.posterior(z)[:, 1] if self.method == "gmm" else (z - self.centre) @ self.direction

    def predict(self, x: np.ndarray) -> np.ndarray:
        return unit_scale(self.sign * self._raw(self.prepare(x)), self.ref)


@dataclass
class UnsupervisedGate:
    """scope 'own': a quality learner for each expert; 'shared': one principal direction over all columns, of which each expert projects
    its own part."""

    groups: list[list[int]]
    anchors: list[int]
    scope: str = "own"
    method: str = "pca"
    beta: float = 4.0
    floor: float = 0.05

    def fit(self, x: np.ndarray) -> UnsupervisedGate:
        if self.scope == "own":
            self.parts = [Quality(self.method).fit(x[:, g], x[:, a]) for g, a in zip(self.groups, self.anchors, strict=True)]
            return self
        self.prepare = Prepare().fit(x)
        z = self.prepare(x)
        self.direction = principal(z)[1]
        self.refs, self.signs = [], []
        for g, a in zip(self.groups, self.anchors, strict=True):
            raw = z[:, g] @ self.direction[g]
            c = np.corrcoef(raw, z[:, a])[0, 1] if raw.std() > 0 and z[:, a].std() > 0 else 1.0
            self.signs.append(-1.0 if c < 0 else 1.0)
            self.refs.append(self.signs[-1] * raw)
        return self

    def quality(self, x: np.ndarray) -> np.ndarray:
        if self.scope == "own":
            return np.stack([p.predict(x[:, g]) for p, g in zip(self.parts, self.groups, strict=True)], axis=1)
        z = self.prepare(x)
        return np.stack([unit_scale(s * (z[:, g] @ self.direction[g]), r) for g, s, r in zip(self.groups, self.signs, self.refs, strict=True)], axis=1)

    def weights(self, x: np.ndarray) -> np.ndarray:
        return quality_weights(self.quality(x), self.beta, self.floor)

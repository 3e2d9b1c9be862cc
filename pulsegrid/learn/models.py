"""Small numpy learners for one fold's rows. All take a matrix with NaN for missing values and are deterministic by seed."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


@dataclass
class Prepare:
    """Infinite to missing, missing to the learning median (0 for an empty column), then scale by the population deviation."""

    scale: bool = True
    median: np.ndarray | None = None
    mean: np.ndarray | None = None
    std: np.ndarray | None = None

    def fit(self, x: np.ndarray) -> Prepare:
        x = np.where(np.isfinite(x), x, np.nan)
        with np.errstate(all="ignore"):
            import warnings

            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                self.median = np.nan_to_num(np.nanmedian(x, axis=0))
        x = np.where(np.isnan(x), self.median, x)
        self.mean, self.std = x.mean(axis=0), x.std(axis=0)
        self.std[self.std == 0] = 1
        return self

    def __call__(self, x: np.ndarray) -> np.ndarray:
        x = np.where(np.isfinite(x), x, self.median)
        return (x - self.mean) / self.std if self.scale else x


def balanced(y: np.ndarray) -> np.ndarray:
    """n / (2 n_class) for each row."""
    n1 = y.sum()
    n0 = len(y) - n1
    return np.where(y > 0, len(y) / (2 * max(n1, 1)), len(y) / (2 * max(n0, 1)))


#: Rows beyond which a logistic fit begins near its end, and rows of a block of its sums.
LARGE, BLOCK = 65_536, 8192


def newton(z: np.ndarray, y: np.ndarray, s: np.ndarray, reg: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, bool]:
    """Weights after steps from ``w``, and whether the last was small."""
    w = w.copy()
    for _ in range(50):
        g, h = reg * w, np.diag(reg)
        for i in range(0, len(z), BLOCK):
            u, t = z[i : i + BLOCK], s[i : i + BLOCK]
            p = logistic(u @ w)
            g = g + u.T @ (t * (p - y[i : i + BLOCK]))
            h = h + (u * (t * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ u
        step = np.linalg.solve(h, g)
        w = w - step
        if np.abs(step).max() < 1e-8:
            return w, True
    return w, False


@dataclass
class Logistic:
    """L2 logistic regression by Newton steps: 1/2 |w|^2 + C * weighted log loss; the intercept is free."""

    c: float = 1.0
    balance: bool = True
    prepare: Prepare = field(default_factory=Prepare)
    w: np.ndarray | None = None

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Logistic:
        z = np.column_stack([self.prepare.fit(x)(x), np.ones(len(x))])
        s = (balanced(y) if self.balance else np.ones(len(y))) * (1 if weight is None else weight)
        reg = np.append(np.full(z.shape[1] - 1, 1 / self.c), 1e-9)
        begin, near = np.zeros(z.shape[1]), False
        if len(z) > LARGE:  # the fit of every 32nd row is where the steps over all rows begin
            w, near = newton(z[::32], y[::32], 32 * s[::32], reg, begin)
        if near:
            w, near = newton(z, y, s, reg, w)
        self.w = w if near else newton(z, y, s, reg, begin)[0]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return logistic(self.prepare(x) @ self.w[:-1] + self.w[-1])


@dataclass
class KernelMachine:
    """A radial-basis classifier: random Fourier features under an L2 logistic layer (it stands in for the kernel machine, which has no
    distributed form)."""

    c: float = 1.0
    features: int = 256
    gamma: float | None = None
    seed: int = 0
    prepare: Prepare = field(default_factory=Prepare)

    def _map(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(2 / self.features) * np.cos(self.prepare(x) @ self.freq + self.phase)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> KernelMachine:
        rng = np.random.default_rng(self.seed)
        self.prepare.fit(x)
        gamma = self.gamma or 1 / max(1, x.shape[1])
        self.freq = rng.normal(0, np.sqrt(2 * gamma), (x.shape[1], self.features))
        self.phase = rng.uniform(0, 2 * np.pi, self.features)
        self.top = Logistic(self.c).fit(self._map(x), y, weight)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.top.predict(self._map(x))


@dataclass
class Boosted:
    """Gradient boosting of small trees on quantile bins. Missing values are a bin of their own and go to the better side."""

    loss: str = "log"  # or "squared"
    rounds: int = 100
    rate: float = 0.1
    depth: int = 3
    bins: int = 32
    l2: float = 1.0
    least: int = 10
    balance: bool = True

    def _code(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(x.shape, np.int64)
        for j, e in enumerate(self.edges):
            out[:, j] = np.where(np.isfinite(x[:, j]), 1 + np.searchsorted(e, x[:, j]), 0)
        return out

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Boosted:
        self.edges = []
        for j in range(x.shape[1]):
            v = x[np.isfinite(x[:, j]), j]
            self.edges.append(np.unique(np.quantile(v, np.linspace(0, 1, self.bins)[1:-1])) if len(v) else np.zeros(0))
        code = self._code(x)
        s = np.ones(len(y)) if weight is None else weight.astype(float)
        if self.loss == "log" and self.balance:
            s = s * balanced(y)
        m = np.average(y, weights=s)
        self.base = float(np.log(max(m, 1e-6) / max(1 - m, 1e-6))) if self.loss == "log" else float(m)
        f = np.full(len(y), self.base)
        self.trees, self.gain = [], np.zeros(x.shape[1])  # gain: of each column's splits
        for _ in range(self.rounds):
            p = logistic(f) if self.loss == "log" else f
            g, h = s * (p - y), s * (p * (1 - p) if self.loss == "log" else np.ones(len(y)))
            tree = self._grow(code, g, h, np.arange(len(y)), self.depth)
            self.trees.append(tree)
            f += self.rate * self._apply(tree, code)
        return self

    def _grow(self, code: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int):
        gs, hs = g[rows].sum(), h[rows].sum()
        leaf = -gs / (hs + self.l2)
        if depth == 0 or len(rows) < 2 * self.least:
            return leaf
        base, best = gs * gs / (hs + self.l2), (1e-9, None)
        for j in range(code.shape[1]):
            c = code[rows, j]
            size = len(self.edges[j]) + 2
            gb, hb, nb = (np.bincount(c, weights=v, minlength=size) for v in (g[rows], h[rows], np.ones(len(rows))))
            for missing_left in (True, False):
                gl, hl, nl = (np.cumsum(v[1:])[:-1] + (v[0] if missing_left else 0) for v in (gb, hb, nb))
                ok = (nl >= self.least) & (len(rows) - nl >= self.least)
                if not ok.any():
                    continue
                gain = np.where(ok, gl**2 / (hl + self.l2) + (gs - gl) ** 2 / (hs - hl + self.l2) - base, -np.inf)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], (j, k + 1, missing_left))
        if best[1] is None:
            return leaf
        j, k, missing_left = best[1]
        self.gain[j] += best[0]
        c = code[rows, j]
        left = np.where(c == 0, missing_left, c <= k)
        return j, k, missing_left, self._grow(code, g, h, rows[left], depth - 1), self._grow(code, g, h, rows[~left], depth - 1)

    def _apply(self, tree, code: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(code), tree)
        j, k, missing_left, a, b = tree
        c = code[:, j]
        left = np.where(c == 0, missing_left, c <= k).astype(bool)
        out = np.empty(len(code))
        out[left], out[~left] = self._apply(a, code[left]), self._apply(b, code[~left])
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        code = self._code(x)
        f = self.base + self.rate * sum(self._apply(t, code) for t in self.trees)
        return logistic(f) if self.loss == "log" else f


@dataclass
class Forest:
    """Bagged trees of gradient-boosting's splitter on half of the features; the mean of their leaves."""

    trees: int = 50
    depth: int = 6
    seed: int = 0

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Forest:
        rng = np.random.default_rng(self.seed)
        s = balanced(y)
        self.parts, self.importance = [], np.zeros(x.shape[1])
        for _ in range(self.trees):
            rows = rng.integers(0, len(y), len(y))
            cols = np.sort(rng.choice(x.shape[1], max(1, int(np.ceil(np.sqrt(x.shape[1])))), replace=False))
            b = Boosted("squared", rounds=1, rate=1.0, depth=self.depth, least=3, l2=1e-9).fit(x[rows][:, cols], y[rows].astype(float), s[rows])
            self.parts.append((cols, b))
            if b.gain.sum() > 0:
                self.importance[cols] += b.gain / b.gain.sum()
        total = self.importance.sum()
        self.importance = self.importance / total if total > 0 else self.importance
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.mean([b.predict(x[:, c]) for c, b in self.parts], axis=0), 0, 1)


def select_features(x: np.ndarray, y: np.ndarray, least: float = 0.008, trees: int = 200, seed: int = 0) -> np.ndarray:
    """Columns whose forest importance reaches ``least``; all of them if none does."""
    keep = np.flatnonzero(Forest(trees, 4, seed).fit(x, y).importance >= least)
    return keep if len(keep) else np.arange(x.shape[1])


@dataclass
class Selected:
    """A classifier behind feature selection by a forest."""

    inner: object
    least: float = 0.008
    trees: int = 50

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Selected:
        self.columns = select_features(x, y, self.least, self.trees)
        self.inner.fit(x[:, self.columns], y, weight)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.inner.predict(x[:, self.columns])


@dataclass
class Isotonic:
    """Pool adjacent violators; linear between the knots, clipped outside."""

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Isotonic:
        order = np.argsort(x, kind="stable")
        xs, first = np.unique(x[order], return_index=True)
        w = np.ones(len(x)) if weight is None else weight[order]
        ws = np.add.reduceat(w, first)
        total, mass, begin, before = np.add.reduceat(w * y[order], first), ws, np.arange(len(xs)), np.inf
        while len(total) < 0.9 * before:  # whole runs that don't rise are pooled at once
            before = len(total)
            v = total / mass
            at = np.flatnonzero(np.append(True, v[:-1] < v[1:]))
            total, mass, begin = np.add.reduceat(total, at), np.add.reduceat(mass, at), begin[at]
        blocks: list[tuple[float, float, int]] = []
        for block in zip(total.tolist(), mass.tolist(), begin.tolist(), strict=True):
            while blocks and blocks[-1][0] / blocks[-1][1] >= block[0] / block[1]:
                t, m, i = blocks.pop()
                block = (t + block[0], m + block[1], i)
            blocks.append(block)
        begin = np.array([i for _, _, i in blocks])
        ends = np.append(begin[1:], len(xs)) - 1
        knots = np.unique(np.concatenate([begin, ends]))  # a pooled run is flat between its ends
        value = np.array([t / m for t, m, _ in blocks])
        self.x, self.y = xs[knots], value[np.searchsorted(begin, knots, "right") - 1]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.interp(x, self.x, self.y)


@dataclass
class Ridge:
    alpha: float = 1.0
    prepare: Prepare = field(default_factory=Prepare)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Ridge:
        z = self.prepare.fit(x)(x)
        self.mean = y.mean(axis=0)
        self.w = np.linalg.solve(z.T @ z + self.alpha * np.eye(z.shape[1]), z.T @ (y - self.mean))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.prepare(x) @ self.w + self.mean


@dataclass
class Perceptron:
    """ReLU layers for several outputs: Huber loss, Adam with decay, dropout, early stop on a part kept aside, best state restored."""

    hidden: tuple[int, ...] = (32,)
    rate: float = 1e-2
    decay: float = 1e-4
    batch: int = 64
    epochs: int = 200
    patience: int = 15
    dropout: float = 0.0
    aside: float = 0.15
    seed: int = 0
    prepare: Prepare = field(default_factory=Prepare)

    def _run(self, z: np.ndarray, rng: np.random.Generator | None = None):
        acts, masks = [z], []
        for i, (w, b) in enumerate(self.layers):
            z = z @ w + b
            if i < len(self.layers) - 1:
                z = np.maximum(z, 0)
                m = (rng.random(z.shape) >= self.dropout) / (1 - self.dropout) if rng is not None and self.dropout else np.ones(z.shape)
                z = z * m
                masks.append(m)
            acts.append(z)
        return acts, masks

    def fit(self, x: np.ndarray, y: np.ndarray) -> Perceptron:
        rng = np.random.default_rng(self.seed)
        z, y = self.prepare.fit(x)(x), np.asarray(y, float).reshape(len(x), -1)
        sizes = [z.shape[1], *self.hidden, y.shape[1]]
        self.layers = [(rng.normal(0, np.sqrt(2 / a), (a, b)), np.zeros(b)) for a, b in zip(sizes, sizes[1:], strict=False)]
        order = rng.permutation(len(z))
        n = int(self.aside * len(z))
        va, tr = order[:n], order[n:]
        state = [[np.zeros_like(p), np.zeros_like(p)] for layer in self.layers for p in layer]
        best, keep, bad, t = np.inf, self.layers, 0, 0
        for _ in range(self.epochs):
            rng.shuffle(tr)
            for i in range(0, len(tr), self.batch):
                rows = tr[i : i + self.batch]
                acts, masks = self._run(z[rows], rng)
                d = np.clip(acts[-1] - y[rows], -1, 1) / len(rows)
                grads = []
                for k in range(len(self.layers) - 1, -1, -1):
                    w, _ = self.layers[k]
                    grads = [acts[k].T @ d + self.decay * w, d.sum(axis=0), *grads]
                    if k:
                        d = (d @ w.T) * (acts[k] > 0) * masks[k - 1]
                t += 1
                flat = [p for layer in self.layers for p in layer]
                for (m, v), p, g in zip(state, flat, grads, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= self.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            rows = va if len(va) else tr
            r = np.abs(self._run(z[rows])[0][-1] - y[rows])
            loss = np.mean(np.where(r < 1, 0.5 * r * r, r - 0.5))
            if loss < best - 1e-6:
                best, keep, bad = loss, [(w.copy(), b.copy()) for w, b in self.layers], 0
            else:
                bad += 1
                if bad > self.patience:
                    break
        self.layers = keep
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self._run(self.prepare(x))[0][-1]


@dataclass
class Mixture:
    """Two Gaussians with diagonal covariance by EM, started from the halves of the first principal component."""

    rounds: int = 60

    def fit(self, z: np.ndarray) -> Mixture:
        s = principal(z)[0]
        r = np.column_stack([s <= np.median(s), s > np.median(s)]).astype(float)
        for _ in range(self.rounds):
            n = r.sum(axis=0) + 1e-9
            self.share = n / n.sum()
            self.mean = r.T @ z / n[:, None]
            self.var = np.stack([(r[:, k, None] * (z - self.mean[k]) ** 2).sum(axis=0) / n[k] for k in (0, 1)]) + 1e-6
            r = self.posterior(z)
        return self

    def posterior(self, z: np.ndarray) -> np.ndarray:
        ll = np.stack([np.log(self.share[k]) - 0.5 * (np.log(self.var[k]) + (z - self.mean[k]) ** 2 / self.var[k]).sum(axis=1) for k in (0, 1)], axis=1)
        ll = np.exp(ll - ll.max(axis=1, keepdims=True))
        return ll / ll.sum(axis=1, keepdims=True)


def principal(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(scores, direction) of the first principal component; its largest loading is positive."""
    _, _, v = np.linalg.svd(z - z.mean(axis=0), full_matrices=False)
    d = v[0] * np.sign(v[0][np.abs(v[0]).argmax()])
    return (z - z.mean(axis=0)) @ d, d


def rank_auc(p: np.ndarray, y: np.ndarray) -> float:
    """Ties count half; NaN with one class."""
    n1 = int((y == 1).sum())
    n0 = len(y) - n1
    if not n1 or not n0:
        return float("nan")
    _, inverse, count = np.unique(p, return_inverse=True, return_counts=True)
    mid = np.cumsum(count) - (count - 1) / 2
    return float((mid[inverse][y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0))


CLASSIFIERS = {
    "LR": lambda **k: Logistic(**k),
    "SVM": lambda **k: KernelMachine(**k),
    "RF": lambda **k: Forest(**k),
    "GB": lambda **k: Boosted(**k),
    "XGB": lambda **k: Boosted(**({"depth": 4, "rounds": 150} | k)),
}


def make_classifier(spec, select: bool = False):
    """By name, by (name, parameters), or with '+cal' for isotonic calibration on three inner folds (not for SVM)."""
    name, params = spec if isinstance(spec, tuple) else (spec, {})
    cal = name.endswith("+cal")
    base = name.removesuffix("+cal")
    if base not in CLASSIFIERS:
        raise ValueError(f"unknown classifier {name!r}")
    make = lambda: Selected(CLASSIFIERS[base](**params)) if select else CLASSIFIERS[base](**params)
    return Calibrated(make) if cal and base != "SVM" else make()


@dataclass
class Calibrated:
    """Isotonic map learnt on out-of-fold scores of three folds; the classifier itself is fitted on all rows."""

    make: object
    folds: int = 3

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Calibrated:
        fold = np.zeros(len(y), int)
        for c in (0, 1):  # each class is dealt out evenly
            at = np.flatnonzero(y == c)
            fold[at] = np.arange(len(at)) % self.folds
        oof = np.full(len(y), np.nan)
        for k in range(self.folds):
            tr = fold != k
            if 0 < y[tr].sum() < tr.sum():
                oof[~tr] = self.make().fit(x[tr], y[tr]).predict(x[~tr])
        self.model = self.make().fit(x, y, weight)
        ok = np.isfinite(oof)
        self.map = Isotonic().fit(oof[ok], y[ok].astype(float)) if ok.any() else None
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        p = self.model.predict(x)
        return self.map.predict(p) if self.map else p

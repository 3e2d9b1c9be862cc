"""What a fold costs: isotonic maps, logistic fits and dealing of groups are the plain ones, without a step of Python for each row."""

from __future__ import annotations

import numpy as np
import pytest

from pulsegrid.learn import folds as L
from pulsegrid.learn import models as M


def pooled(x, y, w):
    """Pool adjacent violators, one value at a time: the value of each row, in the order of x."""
    xs, first = np.unique(x[np.argsort(x, kind="stable")], return_index=True)
    order = np.argsort(x, kind="stable")
    blocks = []
    for s, n in zip(np.add.reduceat((w * y)[order], first), np.add.reduceat(w[order], first), strict=True):
        blocks.append([s, n, 1])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s2, n2, k2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s2, blocks[-1][1] + n2, blocks[-1][2] + k2]
    return xs, np.repeat([s / n for s, n, _ in blocks], [k for _, _, k in blocks])


@pytest.mark.parametrize("shape", ["rising", "flat", "falling", "cascade", "ties", "weights"])
def test_isotonic_map_is_pooled_and_keeps_only_its_bends(shape):
    rng = np.random.default_rng(0)
    n = 5000
    x, w = rng.random(n), np.ones(n)
    y = (rng.random(n) < {"rising": x, "flat": 0.5, "falling": 1 - x}.get(shape, x)).astype(float)
    if shape == "cascade":  # the last value drags all others down, one after another
        y = np.append(np.arange(n - 1.0), -1e9)[np.argsort(np.argsort(x))]
    if shape == "ties":
        x = np.floor(x * 40) / 40
    if shape == "weights":
        w = rng.random(n) + 0.1
    m = M.Isotonic().fit(x, y, w if shape == "weights" else None)
    xs, want = pooled(x, y, w)
    assert np.allclose(m.predict(xs), want, atol=1e-9 * max(1, np.abs(want).max()))
    between = (xs[1:] + xs[:-1]) / 2
    assert np.allclose(m.predict(between), np.interp(between, xs, want), atol=1e-9 * max(1, np.abs(want).max()))
    assert len(m.x) <= 2 * len(np.unique(want)) and len(m.x) < n / 4


def test_a_large_logistic_fit_begins_near_its_end(monkeypatch):
    rng = np.random.default_rng(1)
    n = 80_000
    y = (rng.random(n) < 0.3).astype(float)
    x = rng.normal(size=(n, 3)) + y[:, None]
    x[::7, 1] = np.nan
    seen, plain = [], M.newton
    monkeypatch.setattr(M, "newton", lambda z, *a: seen.append(len(z)) or plain(z, *a))
    got = M.Logistic().fit(x, y).w
    assert seen == [n // 32, n]
    monkeypatch.setattr(M, "LARGE", n)
    assert np.allclose(got, M.Logistic().fit(x, y).w, atol=1e-12)


def test_a_bad_beginning_is_left_for_zero(monkeypatch):
    """Every 32nd row is of one class."""
    monkeypatch.setattr(M, "LARGE", 100)
    y = np.where(np.arange(3200) % 32, np.arange(3200) % 2, 0).astype(float)
    x = np.random.default_rng(2).normal(size=(3200, 2)) + y[:, None]
    got = M.Logistic().fit(x, y).w
    monkeypatch.setattr(M, "LARGE", 10**6)
    assert np.allclose(got, M.Logistic().fit(x, y).w, atol=1e-9)


@pytest.mark.parametrize("k", [2, 3, 5])
def test_groups_are_dealt_as_by_deviations(k):
    rng = np.random.default_rng(k)
    for high in (2, 80):
        count = rng.integers(0, high, (150, 2)).astype(float)
        tie = np.random.default_rng(42).permutation(150)
        total, want, scale = np.zeros((k, 2)), np.zeros(150, int), np.maximum(count.sum(axis=0), 1)
        for g in sorted(range(150), key=lambda g: (-count[g].sum(), tie[g])):
            cost = [(((total + (np.arange(k) == f)[:, None] * count[g]) / scale).std(axis=0).sum(), total[f].sum(), f) for f in range(k)]
            want[g] = min(cost)[2]
            total[want[g]] += count[g]
        assert (L.dealt(count, k) == want).all()

"""Classification gates of every left-out group, from one expansion of all rows' gradient.

A gate's labels (an error up to the median of the other rows' errors) follow the fold, but only rows between the least and the largest of the folds' medians
change theirs: these few are known to every fold. A fold's fit is solved from the derivatives at the fit of all rows, less its own rows' exact share and with the
changed labels' (see ``learn.sums``). Folds whose bound exceeds TOLERANCE are fitted by passes over all rows, some at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.learn import nearby as N
from pulsegrid.learn.models import logistic
from pulsegrid.learn.nets import over_blocks
from pulsegrid.learn.sums import ROUNDS, TOLERANCE, expansion, folded_out


def turned(rest: np.ndarray, a: np.ndarray) -> np.ndarray:
    """From weights of a fold's standardised columns and the intercept to those of the basis; ``rest`` has the basis' products over the fold's learning rows."""
    mean, std, _ = N.scales(rest, a)
    b = np.zeros((len(a), a.shape[1] + 1))
    b[:, :-1] = a / std
    b[-1, :-1] -= mean / std
    b[-1, -1] = 1
    return b


def shares(n1: float, n: float) -> tuple[float, float]:
    """Weights of a row of class 0 and of class 1."""
    return n / (2 * (n - n1)), n / (2 * n1)


def good(e: np.ndarray, median: float) -> np.ndarray:
    return (e <= median).astype(float)  # a missing error is not good


def fits(t: N.Rows, m: int) -> tuple[DataFrame, np.ndarray] | None:
    """(the folds with _theta: experts x basis weights of ``ClassGate``, and _delta, how far a logit moves; the weights of all rows). The blocks' last ``m`` columns are
    the errors. None if too few windows of an expert are good in some fold, or too many rows change their label."""
    known, d, of, width = t.basis, len(t.basis.top), N.products(t), t.width
    err = [width - m + j for j in range(m)]
    gaps = [f"_c{i}" for i in known.flags]
    names = [f"_p{m + j}" for j in range(m)]
    f = N.with_quantiles(t, N.with_quantiles(t, t.folds.where("_i IS NOT NULL"), gaps, 0.5, "_median"), names, 0.5, "_level").localCheckpoint()
    ends = f.agg(*[g(F.col("_level")[j]) for j in range(m) for g in (F.min, F.max)]).first()
    if any(v is None for v in ends):
        return None
    low, high = np.array(ends[0::2]), np.array(ends[1::2])
    level = (low + high) / 2
    between = over_blocks(t.blocks, width, lambda v: np.array([float(((v[:, c] > a) & (v[:, c] <= b)).sum()) for c, a, b in zip(err, low, high, strict=True)]))
    if between.max() > N.LIMIT:
        return None

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in batches:
            for x in r["b"]:
                v = np.frombuffer(x.as_buffer()).reshape(-1, width)
                at = np.zeros(len(v), bool)
                for c, a, b in zip(err, low, high, strict=True):
                    at |= (v[:, c] > a) & (v[:, c] <= b)
                if at.any():
                    yield pa.RecordBatch.from_arrays([pa.array([v[at].tobytes()])], ["s"])

    got = [np.frombuffer(r[0]).reshape(-1, width) for r in t.blocks.mapInArrow(take, "s binary").collect()]  # few rows, see above
    change = np.concatenate(got) if got else np.zeros((0, width))

    total = N.square(t.total)[:d, :d]
    n = total[-1, -1]
    n1 = over_blocks(t.blocks, width, lambda v: np.array([good(v[:, c], k).sum() for c, k in zip(err, level, strict=True)]))
    if n1.min() < 1 or n1.max() >= n:
        return None
    b0 = turned(total, known.fill([v or 0.0 for v in N.roughly(t, gaps, 0.5)]))
    reg = np.append(np.ones(b0.shape[1] - 1), 1e-9)
    w = np.zeros((m, b0.shape[1]))
    for _ in range(ROUNDS):

        def step(v: np.ndarray, w: np.ndarray = w) -> np.ndarray:
            u, out = v[:, 2 : 2 + d], []
            for j, c in enumerate(err):
                y, q = good(v[:, c], level[j]), logistic(u @ (b0 @ w[j]))
                s = np.where(y > 0, *shares(n1[j], n)[::-1])
                out.append(np.column_stack([u.T @ (s * (q - y)), (u * (s * np.maximum(q * (1 - q), 1e-9))[:, None]).T @ u]))
            return np.stack(out)

        sums = over_blocks(t.blocks, width, step)
        move = np.stack([np.linalg.solve(b0.T @ k[:, 1:] @ b0 + np.diag(reg), b0.T @ k[:, 0] + reg * x) for k, x in zip(sums, w, strict=True)])
        w = w - move
        if np.abs(move).max() < 1e-6:  # any near point serves as the centre
            break
    centre = w @ b0.T
    flat = over_blocks(t.blocks, width, lambda v: np.stack([expansion(v[:, 2 : 2 + d], good(v[:, c], k), x) for c, k, x in zip(err, level, centre, strict=True)]))
    parts = [folded_out(x, d) for x in flat]
    top = known.top

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in batches:
            for x in r["b"]:
                v = np.frombuffer(x.as_buffer()).reshape(-1, width)
                v = v[np.argsort(v[:, 0], kind="stable")]
                at, first = np.unique(v[:, 0], return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array([z.tobytes() for z in np.split(v, first[1:])], pa.binary())], ["_k", "_part"])

    mine = t.blocks.mapInArrow(single, "_k long, _part binary").groupBy("_k").agg(F.collect_list("_part").alias("_mine"))
    x = f.join(mine, F.col("_i") == F.col("_k"), "left").drop("_k")

    def solved(j: int, own: np.ndarray, cut: float, b: np.ndarray, rows: float, i: int) -> tuple[np.ndarray | None, bool]:
        """Weights (None: too few are good or none isn't) and whether they are proved."""
        others = change[change[:, 0] != i]
        was, now = good(others[:, err[j]], level[j]), good(others[:, err[j]], cut)
        moved = others[was != now]
        labels = np.concatenate([good(own[:, err[j]], level[j]), was[was != now], now[was != now]])
        u = np.concatenate([own[:, 2 : 2 + d], moved[:, 2 : 2 + d], moved[:, 2 : 2 + d]])
        sign = np.concatenate([-np.ones(len(own) + len(moved)), np.ones(len(moved))])
        k1 = n1[j] + (sign * labels).sum()
        if k1 < 20 or k1 >= rows:
            return None, True
        a = shares(k1, rows)
        s, z, fine = sign * np.where(labels > 0, a[1], a[0]), w[j].copy(), False
        for _ in range(ROUNDS):
            theta = b @ z
            e = theta - centre[j]
            g, h = np.zeros(d), np.zeros((d, d))
            for (d1, d2, d3, d4, _), k in zip(parts[j], a, strict=True):
                e3, e4 = d3 @ e, d4 @ e @ e
                g += k * (d1 + d2 @ e + e3 @ e / 2 + e4 @ e / 6)
                h += k * (d2 + e3 + e4 / 2)
            q = logistic(u @ theta)
            g += u.T @ (s * (q - labels))
            h += (u * (s * q * (1 - q))[:, None]).T @ u
            try:
                inverse = np.linalg.inv(b.T @ h @ b + np.diag(reg))
            except np.linalg.LinAlgError:
                return z, False
            move = inverse @ (b.T @ g + reg * z)
            z = z - move
            fine = bool(np.abs(move).max() < TOLERANCE)
            if fine or not np.isfinite(z).all():
                break
        # the fourth derivative of the logistic function stays under 0.14
        e = b @ z - centre[j]
        fourth = sum(k * float(p[4] @ e @ e @ e @ e) for p, k in zip(parts[j], a, strict=True))
        bound = np.abs(inverse) @ np.abs(b.T) @ top * fourth * 0.14 / 24
        return z, bool(fine and np.isfinite(z).all() and bound.max() <= TOLERANCE)

    def run(r: dict) -> dict:
        rest, held = of(r)
        own = np.frombuffer(b"".join(r["_mine"] or [])).reshape(-1, width)
        b = turned(rest[:d, :d], known.fill([v or 0.0 for v in r["_median"]]))
        made = [solved(j, own, r["_level"][j], b, rest[d - 1, d - 1], r["_i"]) for j in range(m)]
        none = any(z is None for z, _ in made)
        theta = [] if none else np.concatenate([b @ z for z, _ in made])
        return {"_theta": list(theta), "_ok": None if none else all(ok for _, ok in made), "_turn": b.ravel().tolist()} | N.classes(rest, held, d)

    out = N.per_fold(x, run, "_theta array<double>, _n0 double, _n1 double, _own0 double, _own1 double, _ok boolean, _turn array<double>").drop("_s", "_median", "_mine").localCheckpoint()
    if out.where("_ok IS NULL").take(1):
        return None
    left, exact = out.where("NOT _ok").select("_i", "_theta", "_turn", "_level").collect(), []
    for at in range(0, len(left), N.CHUNK):
        part = left[at : at + N.CHUNK]
        exact += list(zip([r["_i"] for r in part], passes(t, m, d, err, part, reg).tolist(), strict=True))
    out = N.replaced(out.drop("_turn", "_level", "_ok"), exact, "_theta", "array<double>")
    base = centre.ravel()
    away = lambda r: {"_delta": float((np.abs(np.array(r["_theta"]) - base).reshape(m, d) @ top).max())}
    return N.per_fold(out, away, "_delta double"), base


def passes(t: N.Rows, m: int, d: int, err: list[int], part: list, reg: np.ndarray) -> np.ndarray:
    """(folds, experts x basis): the exact fits of some folds, each step one pass over all rows."""
    turns = [np.array(r["_turn"]).reshape(d, -1) for r in part]
    count = over_blocks(t.blocks, t.width, lambda v: np.array([[o.sum() for o in [np.ones(int((v[:, 0] != r["_i"]).sum())), *[good(v[v[:, 0] != r["_i"], c], k) for c, k in zip(err, r["_level"], strict=True)]]] for r in part], float))
    w = np.zeros((len(part), m, len(reg)))
    for _ in range(ROUNDS):

        def step(v: np.ndarray, w: np.ndarray = w) -> np.ndarray:
            out = np.zeros((len(part), m, d, d + 1))
            for i, r in enumerate(part):
                x = v[v[:, 0] != r["_i"]]
                u = x[:, 2 : 2 + d]
                for j, c in enumerate(err):
                    y, q = good(x[:, c], r["_level"][j]), logistic(u @ (turns[i] @ w[i, j]))
                    s = np.where(y > 0, *shares(count[i, 1 + j], count[i, 0])[::-1])
                    out[i, j] = np.column_stack([u.T @ (s * (q - y)), (u * (s * np.maximum(q * (1 - q), 1e-9))[:, None]).T @ u])
            return out

        sums = over_blocks(t.blocks, t.width, step)
        move = np.zeros_like(w)
        for i, b in enumerate(turns):
            for j in range(m):
                move[i, j] = np.linalg.solve(b.T @ sums[i, j, :, 1:] @ b + np.diag(reg), b.T @ sums[i, j, :, 0] + reg * w[i, j])
        w = w - move
        if np.abs(move).max() < TOLERANCE:
            break
    return np.stack([(w[i] @ b.T).ravel() for i, b in enumerate(turns)])

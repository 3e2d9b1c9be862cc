"""Gates and components of every left-out group, by what little a group moves.

A fold's sums are those of all rows less its own, so its ridge or its first component is a small system solved where its sums lie. Order statistics of its fitted
scores (a median, a percentile, a threshold) have no such form, and scoring all rows for each fold would take rows x folds. But leaving one group out moves no score
by more than a bound that follows from the fitted weights and the range of the columns. Scores are therefore ranked once, by the fit of all rows; those within the
bounds of the wanted rank are a narrow band, which each fold scores exactly, and all others are only counted. Folds whose statistic is not proved to lie
inside the band are found by passes that count.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pulsegrid.learn import gates as G
from pulsegrid.learn.models import logistic
from pulsegrid.learn.nets import over_blocks, packed
from pulsegrid.learn.sums import finite
from pulsegrid.operators import tables

#: Most scores of a band (a smaller table is one band); parts and passes of a search by counts; folds that share such a pass.
LIMIT, PARTS, PASSES, CHUNK = 32_768, 1024, 5, 64

Score = Callable[[np.ndarray, np.ndarray], np.ndarray]


@dataclass
class Basis:
    """Columns less ``mean`` by ``std`` (0 if missing), flags of what is missing in the columns ``flags``, and 1; ``top`` is the largest magnitude of each."""

    mean: np.ndarray
    std: np.ndarray
    flags: list[int]
    top: np.ndarray

    def of(self, columns: Sequence[Column]) -> list[Column]:
        z = [F.coalesce((c - F.lit(float(m))) / F.lit(float(s)), F.lit(0.0)) for c, m, s in zip(columns, self.mean, self.std, strict=True)]
        return [*z, *[columns[i].isNull().cast("double") for i in self.flags], F.lit(1.0)]

    def fill(self, median: np.ndarray) -> np.ndarray:
        """From the basis to standardised columns whose missing values are ``median``."""
        d = len(self.mean)
        a = np.zeros((d + len(self.flags) + 1, d))
        a[np.arange(d), np.arange(d)] = 1
        for k, j in enumerate(self.flags):
            a[d + k, j] = (median[k] - self.mean[j]) / self.std[j]
        return a


@dataclass
class Rows:
    """Learning rows as blocks (fold number, label, basis, scores) and the folds: _i (number, -1 is none), _f (own id), _s (sums of products)."""

    x: DataFrame
    ids: DataFrame
    blocks: DataFrame
    width: int
    folds: DataFrame
    total: np.ndarray
    basis: Basis

    def release(self) -> None:
        for t in (self.blocks, self.folds, self.ids):
            t.unpersist()


def square(flat: np.ndarray) -> np.ndarray:
    k = int((np.sqrt(8 * len(flat) + 1) - 1) / 2)
    out = np.zeros((k, k))
    out[np.triu_indices(k)] = flat
    return out + np.triu(out, 1).T


def rows_of(df: DataFrame, columns: Sequence[str], label: str, fold: str, scores: Sequence[str] = (), errors: Sequence[str] = ()) -> Rows:
    """``df`` with its labelled rows packed; products of basis, errors (0 if missing) and flags of missing errors are summed for each fold."""
    c, p, e = ([f"_{k}{i}" for i in range(len(cs))] for k, cs in (("c", columns), ("p", scores), ("e", errors)))
    y = F.when(F.col(label).isNotNull(), (F.col(label) == 1).cast("double"))
    x = df.select(F.col(fold).alias("_f"), y.alias("_y"), *[finite(a).alias(b) for a, b in zip([*columns, *scores, *errors], [*c, *p, *e], strict=True)])
    learn = x.where("_y IS NOT NULL")
    r = learn.agg(F.lit(0), *[f for n in c for f in (F.avg(n), F.stddev_pop(n), F.count_if(F.col(n).isNull()))]).first()[1:]
    mean = np.array([v or 0.0 for v in r[0::3]])
    std = np.array([v if v and v > 1e-12 * max(1, abs(m)) else 1.0 for v, m in zip(r[1::3], mean, strict=True)])
    known = Basis(mean, std, [i for i, n in enumerate(r[2::3]) if n], np.zeros(0))
    flags = known.flags
    u = [f"_u{i}" for i in range(len(c) + len(flags) + 1)]
    ids = x.select("_f").where("_f IS NOT NULL").distinct().withColumn("_i", F.monotonically_increasing_id()).persist()
    wide = learn.select("_f", "_y", *[b.alias(n) for b, n in zip(known.of([F.col(n) for n in c]), u, strict=True)], *p, *e)
    parts = [*[F.col(n) for n in u], *[F.coalesce(n, F.lit(0.0)) for n in e], *[F.col(n).isNull().cast("double") for n in e], F.col("_y")]
    sums = [F.sum(parts[i] * parts[j]) for i in range(len(parts)) for j in range(i, len(parts))]
    folds = ids.join(wide.groupBy(F.col("_f").alias("_g")).agg(F.array(*sums).alias("_s")), F.col("_f") == F.col("_g"), "full").drop("_g").persist()
    total = np.array([v or 0.0 for v in folds.agg(*[F.sum(F.col("_s")[k]) for k in range(len(sums))]).first()])
    known.top = np.array([v or 0.0 for v in wide.agg(*[F.max(F.abs(n)) for n in u]).first()])
    ids_ = ids.withColumnRenamed("_f", "_g")
    blocks = packed(wide.join(ids_, F.col("_f") == F.col("_g"), "left").withColumn("_i", F.coalesce("_i", F.lit(-1)).cast("double")), ["_i", "_y", *u, *p]).persist()
    return Rows(x, ids, blocks, 2 + len(u) + len(p), folds, total, known)


def per_fold(folds: DataFrame, run: Callable[[dict], dict], added: str) -> DataFrame:
    """``folds`` with the columns ``added``, of one fold at a time."""
    kind = T.StructType([*folds.schema.fields, *T.StructType.fromDDL(added).fields])
    target = to_arrow_schema(kind)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                made = [run(r) for r in part.to_pylist()]
                names = [f.name for f in target][part.num_columns :]
                yield pa.RecordBatch.from_arrays([*[part.column(i).cast(target.field(i).type) for i in range(part.num_columns)], *[pa.array([m[n] for m in made], target.field(n).type) for n in names]], schema=target)

    return folds.mapInArrow(task, kind)


# Order statistics


def narrowed(count: Callable[[np.ndarray], np.ndarray], ranks: np.ndarray, low: float, high: float, passes: int) -> tuple[np.ndarray, np.ndarray]:
    """For each rank (from 0) an interval that holds its value: ``count(cuts)`` tells how many lie at or under each cut (ranks, PARTS)."""
    lo, hi = np.full(len(ranks), low), np.full(len(ranks), high)
    for _ in range(passes):
        cut = lo[:, None] + (hi - lo)[:, None] * (np.arange(1, PARTS + 1) / PARTS)
        i = np.minimum((count(cut) <= ranks[:, None]).sum(axis=1), PARTS - 1)
        lo, hi = np.where(i > 0, cut[np.arange(len(ranks)), np.maximum(i - 1, 0)], lo), cut[np.arange(len(ranks)), i]
    return lo, hi


def counts(v: np.ndarray, cut: np.ndarray) -> np.ndarray:
    return np.cumsum(np.bincount(np.searchsorted(cut, v), minlength=len(cut) + 1))[: len(cut)].astype(float)


def span(blocks: DataFrame, width: int, score: Score, base: np.ndarray, label: int | None) -> tuple[float, float, float]:
    def run(v: np.ndarray) -> np.ndarray:
        s = score(picked(v, label), base)
        return np.array([s.size, -s.min(initial=np.inf), s.max(initial=-np.inf)])

    n, low, high = over_blocks(blocks, width, run, lambda a, b: np.array([a[0] + b[0], max(a[1], b[1]), max(a[2], b[2])]))
    return n, -low, high


def picked(v: np.ndarray, label: int | None) -> np.ndarray:
    return v if label is None else v[v[:, 1] == label]


@dataclass
class Band:
    """The scores (row, place) between ``low`` and ``high`` by the fit of all rows, and how many lie under it."""

    rows: np.ndarray
    place: np.ndarray
    low: float
    high: float
    delta: float
    under: float


def band(t: Rows, score: Score, base: np.ndarray, label: int | None, a: float, b: float, deltas: Sequence[float]) -> tuple[Band, DataFrame] | None:
    """The band around [a, b] for the largest of ``deltas`` that keeps it small, and (_k, _under) how many scores of each fold lie under it; None if none does."""
    if np.isfinite(a) or np.isfinite(b):

        def sizes(v: np.ndarray) -> np.ndarray:
            s = score(picked(v, label), base)
            return np.array([float(((s >= a - 2 * d) & (s <= b + 2 * d)).sum()) for d in deltas])

        fits = [d for d, n in zip(deltas, over_blocks(t.blocks, t.width, sizes), strict=True) if n <= LIMIT]
        if not fits:
            return None
        delta = max(fits)
        low, high = a - 2 * delta, b + 2 * delta
    else:
        delta, low, high = np.inf, -np.inf, np.inf

    width = t.width

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in batches:
            for x in r["b"]:
                v = picked(np.frombuffer(x.as_buffer()).reshape(-1, width), label)
                s = score(v, base)
                i, j = np.nonzero((s >= low) & (s <= high))
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array([np.column_stack([v[i], j]).tobytes()])], ["s"])

    def under(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in batches:
            for x in r["b"]:
                v = picked(np.frombuffer(x.as_buffer()).reshape(-1, width), label)
                i, n = np.unique(np.repeat(v[:, 0], (score(v, base) < low).sum(axis=1)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int64)), pa.array(n.astype(np.int64))], ["_k", "_n"])

    got = [np.frombuffer(r[0]).reshape(-1, t.width + 1) for r in t.blocks.mapInArrow(take, "s binary").collect()]
    rows = np.concatenate(got) if got else np.zeros((0, t.width + 1))
    own = t.blocks.mapInArrow(under, "_k long, _n long").groupBy("_k").agg(F.sum("_n").alias("_under")).localCheckpoint()
    every = float(own.agg(F.coalesce(F.sum("_under"), F.lit(0))).first()[0])
    return Band(rows[:, :-1], rows[:, -1].astype(int), low, high, delta, every), own


#: Shares of folds whose bounds a band may be cut for; the others are found by passes.
SHARES = (1.0, 0.9999, 0.999, 0.99, 0.9, 0.5)


def ranked(t: Rows, folds: DataFrame, score: Score, base: np.ndarray, label: int | None, name: str) -> DataFrame:
    """``folds`` (_i, _theta, _delta, _ranks, _own) with ``name``: the values at _ranks (from 0) of the scores of all rows of other folds by _theta. No score by
    _theta is further than _delta from the one by ``base``; _own is the number of the fold's own scores."""
    n, least, most = span(t.blocks, t.width, score, base, label)
    deltas, a, b, k = [np.inf], -np.inf, np.inf, None
    if n > LIMIT:
        r = folds.where(F.col("_own") <= n / 64).agg(F.min(F.array_min("_ranks")), F.max(F.array_max("_ranks") + F.col("_own")), F.percentile_approx("_delta", list(SHARES), 100_000)).first()
        if r[0] is not None and least < most:
            at = np.array([r[0], min(r[1], n - 1)], float)
            count = lambda cut: over_blocks(t.blocks, t.width, lambda v: np.stack([counts(score(picked(v, label), base).ravel(), c) for c in cut]))
            lo, hi = narrowed(count, at, least - 1e-9 * (most - least), most, 3)
            deltas, a, b = [float(d) * (1 + 1e-9) + 1e-12 for d in r[2]], lo[0], hi[1]
            k = band(t, score, base, label, a, b, deltas)
    else:
        k = band(t, score, base, label, a, b, deltas)
    if k is None:
        return passed_over(t, folds, score, label, name, False)
    k, own = k
    x = folds.join(own, F.col("_i") == F.col("_k"), "left").drop("_k").withColumn("_under", F.coalesce("_under", F.lit(0)))

    def run(r: dict) -> dict:
        fail = {name: None, "_near": False}
        if r["_delta"] is None or not r["_delta"] <= k.delta or r["_ranks"] is None:
            return fail
        s = scored(k, score, r["_theta"], r["_i"])
        at = np.array(r["_ranks"]) - int(k.under - r["_under"])
        if at.min() < 0 or at.max() >= len(s):
            return fail
        v = np.partition(s, at)[at]
        return {name: v.tolist(), "_near": True} if v.min() >= k.low + r["_delta"] and v.max() <= k.high - r["_delta"] or k.delta == np.inf else fail

    return passed_over(t, per_fold(x, run, f"{name} array<double>, _near boolean").drop("_under"), score, label, name)


def scored(k: Band, score: Score, theta: Sequence[float], i: int) -> np.ndarray:
    """Scores of the band's rows of other folds."""
    keep = k.rows[:, 0] != i
    v, j = k.rows[keep], k.place[keep]
    return score(v, np.array(theta))[np.arange(len(v)), j]


def passed_over(t: Rows, got: DataFrame, score: Score, label: int | None, name: str, tried: bool = True) -> DataFrame:
    """``got`` with the folds that no band tells found by passes that count, some at a time."""
    if not tried:
        got = got.withColumns({name: F.lit(None).cast("array<double>"), "_near": F.lit(False)})
    got = got.localCheckpoint()
    left = got.where(F.col(name).isNull() & F.col("_ranks").isNotNull() & F.col("_theta").isNotNull()).select("_i", "_theta", "_ranks").collect()
    made = []
    for at in range(0, len(left), CHUNK):
        part = [(r[0], np.array(r[1]), np.array(r[2], float)) for r in left[at : at + CHUNK]]

        def mine(v: np.ndarray, part: list = part) -> list[np.ndarray]:
            v = picked(v, label)
            return [score(v[v[:, 0] != i], w).ravel() for i, w, _ in part]

        value = at_ranks(t.blocks, t.width, mine, np.stack([r for _, _, r in part]))
        made += [(r[0], v.tolist()) for r, v in zip(part, value, strict=True)]
    return replaced(got, made, name, "array<double>")


def at_ranks(blocks: DataFrame, width: int, mine: Callable[[np.ndarray], list[np.ndarray]], ranks: np.ndarray) -> np.ndarray:
    """For each of the lists of values that ``mine`` takes of a block the values at its ``ranks`` (lists, ranks from 0) over all blocks, by passes that count."""
    q = ranks.shape[1]
    got = over_blocks(blocks, width, lambda v: np.array([[-s.min(initial=np.inf), s.max(initial=-np.inf)] for s in mine(v)]), np.maximum)
    low, high = -got[:, 0], got[:, 1]
    wide = np.maximum(high - low, 1e-300)
    lo, hi, rank = np.repeat(low - 1e-9 * wide, q), np.repeat(high, q), ranks.ravel().astype(float)
    for _ in range(PASSES):
        cut = lo[:, None] + (hi - lo)[:, None] * (np.arange(1, PARTS + 1) / PARTS)
        n = over_blocks(blocks, width, lambda v, cut=cut: np.stack([counts(s, cut[f * q + g]) for f, s in enumerate(mine(v)) for g in range(q)]))
        i = np.minimum((n <= rank[:, None]).sum(axis=1), PARTS - 1)
        lo, hi = np.where(i > 0, cut[np.arange(len(rank)), np.maximum(i - 1, 0)], lo), cut[np.arange(len(rank)), i]
    value = over_blocks(blocks, width, lambda v, hi=hi: np.array([s[s <= hi[f * q + g]].max(initial=-np.inf) for f, s in enumerate(mine(v)) for g in range(q)]), np.maximum)
    return value.reshape(ranks.shape)


def replaced(got: DataFrame, made: list[tuple], name: str, kind: str) -> DataFrame:
    if not made:
        return got
    extra = got.sparkSession.createDataFrame(made, f"_k long, _new {kind}")
    return got.join(extra, F.col("_i") == F.col("_k"), "left").withColumn(name, F.coalesce("_new", name)).drop("_k", "_new")


def allowed(m: int, min_spec: float) -> int:
    """The most false calls among ``m`` negatives that keep the specificity; -1 if none does."""
    return next((k for k in range(min(m, int((1 - min_spec) * m) + 2), -1, -1) if 1 - k / max(m, 1) >= min_spec), -1)


def thresholds(t: Rows, folds: DataFrame, score: Score, base: np.ndarray, min_spec: float) -> DataFrame:
    """``folds`` (_i, _theta, _delta, _n0, _n1, _own0, _own1) with _cut: what ``folds.threshold`` takes of the scores of all rows of other folds; infinite if there
    is none."""
    rank = F.udf(lambda m: [int(m) - 1 - allowed(int(m), min_spec)], "array<long>")
    f = ranked(t, folds.withColumns({"_ranks": rank("_n0"), "_own": F.col("_own0")}), score, base, 0, "_bar").withColumn("_bar", F.col("_bar")[0]).persist()
    n, least, most = span(t.blocks, t.width, score, base, 1)
    k = None
    r = f.where("_near").agg(F.min("_bar"), F.max("_bar"), F.percentile_approx("_delta", list(SHARES), 100_000), F.max("_own1")).first()
    if n <= LIMIT:
        k = band(t, score, base, 1, -np.inf, np.inf, [np.inf])[0]
    elif r[0] is not None:
        deltas = [float(d) * (1 + 1e-9) + 1e-12 for d in r[2]]
        beneath = over_blocks(t.blocks, t.width, lambda v: np.array([float((score(picked(v, 1), base) <= r[1] + d).sum()) for d in deltas]))
        for d, m in zip(deltas, beneath, strict=True):  # the largest first
            at, b = m + r[3] + 64, np.inf
            if at < n:
                count = lambda cut: over_blocks(t.blocks, t.width, lambda v: np.stack([counts(score(picked(v, 1), base).ravel(), c) for c in cut]))
                b = narrowed(count, np.array([at]), least - 1e-9 * (most - least), most, 3)[1][0]
            if (got := band(t, score, base, 1, float(r[0]), b, [d])) is not None:
                k = got[0]
                break

    def run(x: dict) -> dict:
        if k is None or x["_bar"] is None or (k.delta < np.inf and not (x["_near"] and x["_delta"] <= k.delta and x["_bar"] >= k.low + x["_delta"])):
            return {"_cut": None}
        s = scored(k, score, x["_theta"], x["_i"])
        v = float(s[s > x["_bar"]].min(initial=np.inf))
        return {"_cut": v if k.high == np.inf or v <= k.high - x["_delta"] else None}

    got = per_fold(f, run, "_cut double").localCheckpoint()
    f.unpersist()
    left, made = got.where("_cut IS NULL AND _bar IS NOT NULL").select("_i", "_theta", "_bar").collect(), []
    for at in range(0, len(left), CHUNK):
        part = [(x[0], np.array(x[1]), x[2]) for x in left[at : at + CHUNK]]

        def smallest(v: np.ndarray, part: list = part) -> np.ndarray:
            v = picked(v, 1)
            own = [score(v[v[:, 0] != i], w).ravel() for i, w, _ in part]
            return np.array([s[s > b].min(initial=np.inf) for s, (_, _, b) in zip(own, part, strict=True)])

        made += [(x[0], float(v)) for x, v in zip(part, over_blocks(t.blocks, t.width, smallest, np.minimum), strict=True)]
    return replaced(got, made, "_cut", "double")


# Fits


def with_quantiles(t: Rows, folds: DataFrame, columns: Sequence[str], q: float, name: str) -> DataFrame:
    """``folds`` with ``name``: the q-quantile of each column over the other folds' learning rows."""
    for c in columns:
        v = tables.others_quantile(t.x.where("_y IS NOT NULL"), c, "_f", q).select(F.col("_f").alias("_g"), F.col("value").alias(f"_q{c}"))
        folds = folds.join(v, F.col("_f") == F.col("_g"), "left").drop("_g")
    return folds.withColumn(name, F.array(*[F.col(f"_q{c}") for c in columns]).cast("array<double>")).drop(*[f"_q{c}" for c in columns])


def roughly(t: Rows, columns: Sequence[str], q: float) -> list:
    return list(t.x.where("_y IS NOT NULL").agg(F.lit(0), *[F.percentile_approx(c, q) for c in columns]).first()[1:])


def scales(g: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, deviations and covariances of filled columns from products of the basis, whose last column is 1."""
    n = max(g[-1, -1], 1)
    mean = a.T @ g[:, -1] / n
    cov = a.T @ g @ a / n - np.outer(mean, mean)
    std = np.sqrt(np.maximum(np.diag(cov), 0))
    std[std <= 1e-12 * np.maximum(1, np.abs(mean))] = 1
    return mean, std, cov


def ridge(g: np.ndarray, a: np.ndarray, sentinel: Sequence[float | None], m: int, alpha: float) -> np.ndarray:
    """(errors, basis): the weights of ``ErrorGate('ridge')`` from sums of products of basis, errors and flags of missing errors."""
    d = len(a)
    s = np.array([1.0 if v is None else v for v in sentinel])
    n = max(g[d - 1, d - 1], 1)
    mean, std, cov = scales(g[:d, :d], a)
    e = g[:d, d : d + m] + g[:d, d + m : d + 2 * m] * s
    level = e[-1] / n
    z = (a.T @ e - np.outer(mean, e[-1])) / std[:, None]
    w = np.linalg.solve(cov * n / np.outer(std, std) + alpha * np.eye(len(mean)), z) / std[:, None]
    out = (a @ w).T
    out[:, -1] += level - mean @ w
    return out


def linear(v: np.ndarray, theta: np.ndarray, m: int, d: int) -> np.ndarray:
    """(rows, m) of basis columns; ``theta`` begins with m x d weights, one for all rows or one for each."""
    u = v[:, 2 : 2 + d]
    return u @ theta[: m * d].reshape(m, d).T if theta.ndim == 1 else np.einsum("nd,nmd->nm", u, theta[:, : m * d].reshape(-1, m, d))


def products(t: Rows) -> Callable[[dict], tuple[np.ndarray, np.ndarray]]:
    """Of a fold: the products of all other rows, and of its own."""
    total = t.total

    def run(r: dict) -> tuple[np.ndarray, np.ndarray]:
        own = np.array([v or 0.0 for v in r["_s"]]) if r["_s"] else np.zeros(len(total))
        return square(total - own), square(own)

    return run


KNOWN = "_theta array<double>, _delta double, _n0 double, _n1 double, _own0 double, _own1 double"


def classes(rest: np.ndarray, own: np.ndarray, d: int) -> dict:
    """Rows of each class among the others and of the fold; the basis' last column is 1, the last product the label's."""
    n1, own1 = round(rest[-1, -1]), round(own[-1, -1])
    return {"_n0": float(round(rest[d - 1, d - 1]) - n1), "_n1": float(n1), "_own0": float(round(own[d - 1, d - 1]) - own1), "_own1": float(own1)}


def ridges(t: Rows, m: int, alpha: float) -> tuple[DataFrame, np.ndarray]:
    """(the folds with _theta, errors x basis weights of ``ErrorGate('ridge')``, and _delta, how far an error moves; the weights of all rows)"""
    known, d, of = t.basis, len(t.basis.top), products(t)
    gaps = [f"_c{i}" for i in known.flags]
    missing = [f"_e{j}" for j in range(m) if square(t.total)[d + m + j, d - 1] > 0]
    base = ridge(square(t.total), known.fill(roughly(t, gaps, 0.5)), spread(roughly(t, missing, 0.95), missing, m), m, alpha)
    f = with_quantiles(t, with_quantiles(t, t.folds.where("_i IS NOT NULL"), gaps, 0.5, "_median"), missing, 0.95, "_sentinel")

    def run(r: dict) -> dict:
        rest, own = of(r)
        w = ridge(rest, known.fill([v or 0.0 for v in r["_median"]]), spread(r["_sentinel"], missing, m), m, alpha)
        return {"_theta": w.ravel().tolist(), "_delta": float((np.abs(w - base) @ known.top).max())} | classes(rest, own, d)

    return per_fold(f, run, KNOWN).drop("_s", "_median", "_sentinel"), base


def spread(values: Sequence[float | None], names: Sequence[str], m: int) -> list[float | None]:
    at = dict(zip(names, values, strict=True))
    return [at.get(f"_e{j}") for j in range(m)]


def directions(rest: np.ndarray, a: np.ndarray, groups: Sequence[Sequence[int]], anchors: Sequence[int], shared: bool) -> np.ndarray:
    """(groups, basis): each group's first component (or, shared, its part of the one over all columns), turned to rise with its anchor."""
    mean, std, cov = scales(rest, a)
    whole, out = cov / np.outer(std, std), []
    for g, k in zip(groups, anchors, strict=True):
        at = np.arange(len(whole)) if shared else np.asarray(g)
        v = np.linalg.eigh(whole[np.ix_(at, at)])[1][:, -1]
        w = np.zeros(len(whole))
        w[at] = v * np.sign(v[np.abs(v).argmax()])
        w = np.where(np.isin(np.arange(len(whole)), g), w, 0)
        w = w * (-1.0 if w @ whole[:, k] < 0 else 1.0) / std
        out.append(a @ w)
        out[-1][-1] -= mean @ w
    return np.stack(out)


def components(t: Rows, groups: Sequence[Sequence[int]], anchors: Sequence[int], shared: bool = False, low: float = 0.05, high: float = 0.95) -> tuple[DataFrame, np.ndarray]:
    """(the folds with _theta: groups x basis weights, then each group's percentiles ``low`` and ``high``; _delta, how far a raw score moves; the weights of all rows)"""
    known, d, m, of = t.basis, len(t.basis.top), len(groups), products(t)
    gaps = [f"_c{i}" for i in known.flags]
    base = directions(square(t.total)[:d, :d], known.fill([v or 0.0 for v in roughly(t, gaps, 0.5)]), groups, anchors, shared)

    def run(r: dict) -> dict:
        rest, own = of(r)
        w = directions(rest[:d, :d], known.fill([v or 0.0 for v in r["_median"]]), groups, anchors, shared)
        return {"_all": w.ravel().tolist(), "_moved": (np.abs(w - base) @ known.top).tolist()} | {k: v for k, v in classes(rest, own, d).items()}

    f = per_fold(with_quantiles(t, t.folds.where("_i IS NOT NULL"), gaps, 0.5, "_median"), run, "_all array<double>, _moved array<double>, " + KNOWN.split(", ", 2)[2]).drop("_s", "_median").localCheckpoint()
    n, score = F.col("_n0") + F.col("_n1"), lambda v, w: v[:, 2 : 2 + d] @ w[:, None]
    ends = []
    for k in range(m):
        for i, q in enumerate((low, high)):
            at = q * F.greatest(n - 1, F.lit(0.0))
            asked = f.select("_i", F.slice("_all", k * d + 1, d).alias("_theta"), F.col("_moved")[k].alias("_delta"), F.when(n > 0, F.array(F.floor(at), F.ceil(at))).alias("_ranks"), (F.col("_own0") + F.col("_own1")).alias("_own"), (at - F.floor(at)).alias("_part"))
            v = ranked(t, asked, score, base[k], None, "_v")
            ends.append(f"_end{2 * k + i}")
            f = f.join(v.select("_i", (F.col("_v")[0] + (F.col("_v")[1] - F.col("_v")[0]) * F.col("_part")).alias(ends[-1])), "_i", "left")
    f = f.withColumns({"_theta": F.concat("_all", F.array(*ends)), "_delta": F.array_max("_moved")}).drop("_all", "_moved", *ends)
    return f, base


# Gates


def gate_kind(kind: str, options: Mapping) -> bool:
    """Whether the gate's weights come from sums: ridge gates on plain or standardised errors, equal weights, components of each expert's own columns, logistic
    classification gates."""
    if kind == "ridge":
        return not options.get("trust") and set(options) <= {"map", "e0", "tau", "freeze", "alpha", "target", "trust", "seed"} and options.get("target", "standard") in ("standard", None)
    return kind in ("equal", "class_lr") or (kind == "unsup_pca" and options.get("scope", "own") == "own")


#: Moves of a logit under which the expansion of mean weights is exact to 1e-9.
STILL = 4e-3


def slopes(v: np.ndarray, weights: np.ndarray, m: int, d: int) -> np.ndarray:
    """Sums over rows of softmax weights and their first three derivatives by the logits' basis weights, flat."""
    u = v[:, 2 : 2 + d]
    same = np.eye(m)
    one = weights[:, :, None] * (same - weights[:, None, :])
    two = np.einsum("nik,nij->nijk", one, same - weights[:, None, :]) - np.einsum("ni,njk->nijk", weights, one)
    third = np.einsum("nikl,nij->nijkl", two, same - weights[:, None, :]) - np.einsum("nik,njl->nijkl", one, one) - np.einsum("nil,njk->nijkl", one, one) - np.einsum("ni,njkl->nijkl", weights, two)
    n = len(v)
    pairs = np.einsum("na,nb->nab", u, u).reshape(n, d**2)
    triples = np.einsum("nx,na->nxa", pairs, u).reshape(n, d**3)
    return np.concatenate([weights.sum(axis=0), (one.reshape(n, m**2).T @ u).ravel(), (two.reshape(n, m**3).T @ pairs).ravel(), (third.reshape(n, m**4).T @ triples).ravel()])


def expanded(flat: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The sums of ``slopes`` where the logits' weights are moved by ``t`` (m, d)."""
    m, d = t.shape
    at = np.cumsum([m, m**2 * d, m**3 * d**2, m**4 * d**3])
    a, b, c, e = np.split(flat, at[:-1])
    first = np.einsum("ija,ja->i", b.reshape(m, m, d), t)
    second = np.einsum("ijkab,ja,kb->i", c.reshape(m, m, m, d, d), t, t)
    third = np.einsum("ijklabc,ja,kb,lc->i", e.reshape(m, m, m, m, d, d, d), t, t, t, optimize=True)
    return a + first + second / 2 + third / 6


def evaluate(table: DataFrame, experts: Sequence[str], columns: Sequence[str], kind: str, options: dict, fold: str, min_spec: float, schema: str, cuts: bool = True) -> DataFrame | None:
    """As ``folds.evaluate_moe`` for the gates of ``gate_kind`` (``cuts`` False: without thresholds); None for tables that need the frames: a fold whose others are
    of one class, a missing score or anchor."""
    p, e, m = [f"p_{k}" for k in experts], [f"e_{k}" for k in experts], len(experts)
    bare = table.agg(F.min(F.least(*p)), F.max(F.greatest(*p)), *[F.count_if(finite(c).isNull()) for c in p]).first()
    if min_spec <= 0 or any(bare[2:]) or bare[0] is None:
        return None
    t = rows_of(table, columns, "y", fold, [*p, *e] if kind == "class_lr" else p, e if kind == "ridge" else ())
    try:
        if kind == "unsup_pca" and set(options["anchors"]) & set(t.basis.flags):
            return None
        made = fitted(t, m, kind, options, float(bare[1] - bare[0]), max(abs(bare[0]), abs(bare[1])))
        if made is None:
            return None
        f, base, weigh = made
        d, score = len(t.basis.top), fused(weigh, len(t.basis.top), m)
        if cuts:
            f = thresholds(t, f, score, base, min_spec)
        else:
            f = f.withColumn("_cut", F.lit(None).cast("double"))
        f = f.select("_f", "_theta", "_cut").localCheckpoint()
    finally:
        t.release()
    names = [f"_u{i}" for i in range(d)]
    x = table.where(F.col(fold).isNotNull()).select("patient", "win_idx", "y", F.col(fold).alias("_g"), *[b.alias(n) for b, n in zip(t.basis.of([finite(c) for c in columns]), names, strict=True)], *[finite(c).alias(c) for c in p])
    x = x.join(f, F.col("_g") == F.col("_f")).drop("_g", "_f")
    target = to_arrow_schema(T.StructType.fromDDL(schema))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in batches:
            if not r.num_rows:
                continue
            v = np.column_stack([np.zeros((r.num_rows, 2)), *[r[c].to_numpy(zero_copy_only=False) for c in [*names, *p]]])
            theta = r["_theta"].flatten().to_numpy().reshape(r.num_rows, -1)
            w, cut = weigh(v, theta), r["_cut"].to_numpy(zero_copy_only=False).astype(float)
            q = (w * v[:, 2 + d :]).sum(axis=1)
            calls = pa.array(q >= cut) if cuts else pa.nulls(len(q), pa.bool_())
            ends = [pa.array(q, from_pandas=True), calls, pa.array(np.where(np.isfinite(cut), cut, np.nan), from_pandas=True)]
            yield pa.RecordBatch.from_arrays([*[r[c].cast(target.field(c).type) for c in ("patient", "win_idx", "y")], *ends, *[pa.array(w[:, i]) for i in range(m)]], schema=target)

    return x.mapInArrow(task, schema)


def fused(weigh: Score, d: int, m: int) -> Score:
    return lambda v, theta: (weigh(v, theta) * v[:, 2 + d : 2 + d + m]).sum(axis=1)[:, None]


def shifted(a: float, wide: float, most: float) -> float:
    """How far a blend of scores moves whose weights move by factors within exp(+-a)."""
    return float(np.expm1(2 * a) * (wide + 1e-6 * most) + 1e-13 * most) if a < 1 else np.inf


def fitted(t: Rows, m: int, kind: str, options: dict, wide: float, most: float) -> tuple[DataFrame, np.ndarray, Score] | None:
    """(the folds with _theta and the bound _delta on a fused score, _theta of all rows, the weights of rows by _theta); None if a fold's others are of one class"""
    d = len(t.basis.top)
    if kind == "equal":
        of, same = products(t), 1 / m
        f = per_fold(t.folds.where("_i IS NOT NULL"), lambda r: {"_theta": [0.0], "_delta": 0.0} | classes(*of(r), d), KNOWN).drop("_s")
        weigh = lambda v, theta: np.full((len(v), m), same)
        base = np.zeros(1)
    elif kind == "ridge":
        f, w = ridges(t, m, float(options.get("alpha", 1.0)))
        base = w.ravel()
    elif kind == "class_lr":
        from pulsegrid.learn import classgate

        if (got := classgate.fits(t, m)) is None:
            return None
        f, base = got
    else:
        f, w = components(t, options["groups"], options["anchors"])
        base = w.ravel()
    f = f.localCheckpoint()
    if f.where("_n0 = 0 OR _n1 = 0").take(1):
        return None
    if kind == "equal":
        return f, base, weigh
    if kind == "class_lr":

        def weigh(v: np.ndarray, theta: np.ndarray) -> np.ndarray:
            w = np.maximum(logistic(linear(v, theta, m, d)), 1e-3)
            return w / w.sum(axis=1, keepdims=True)

        f = per_fold(f, lambda r: {"_bound": shifted(r["_delta"], wide, most)}, "_bound double").drop("_delta").withColumnRenamed("_bound", "_delta")
        return f.localCheckpoint(), base, weigh
    if kind == "unsup_pca":
        beta, floor = options.get("beta", 4.0), options.get("floor", 0.05)
        ends = f.agg(*[F.avg(F.col("_theta")[m * d + i]) for i in range(2 * m)]).first()
        base = np.concatenate([base, [float(v or 0.0) for v in ends]])

        def weigh(v: np.ndarray, theta: np.ndarray) -> np.ndarray:
            raw, end = linear(v, theta, m, d), theta[..., m * d :].reshape(*theta.shape[:-1], m, 2)
            low, high = end[..., 0], end[..., 1]
            q = np.where(high > low, np.clip((raw - low) / np.where(high > low, high - low, 1), 0, 1), 0.5)
            return G.quality_weights(q, beta, floor)

        top = t.basis.top

        def bound(r: dict) -> dict:
            x = np.array(r["_theta"])
            moved = np.abs((x - base)[: m * d].reshape(m, d)) @ top
            a, b = x[m * d :].reshape(m, 2), base[m * d :].reshape(m, 2)
            least = np.minimum(a[:, 1] - a[:, 0], b[:, 1] - b[:, 0])
            if (least <= 0).any():
                return {"_bound": np.inf}
            return {"_bound": shifted(beta * float(((moved + np.abs(a - b).max(axis=1)) / least).max()), wide, most)}

        return per_fold(f, bound, "_bound double").drop("_delta").withColumnRenamed("_bound", "_delta").localCheckpoint(), base, weigh
    if options.get("map") == "decay":
        e0, tau = options.get("e0", 0.15), options.get("tau", 0.25)
        far = (float(np.abs(base.reshape(m, d)) @ t.basis.top @ np.ones(m)) - e0) / tau  # weights that vanish have no bound
        weigh = lambda v, theta: G.decay_weights(linear(v, theta, m, d), e0, tau)
        f = per_fold(f, lambda r: {"_bound": np.inf if far > 600 else shifted(r["_delta"] / tau, wide, most)}, "_bound double").drop("_delta").withColumnRenamed("_bound", "_delta")
        if options.get("freeze"):
            return frozen(t, f, base, weigh, None, m, most)
        return f.localCheckpoint(), base, weigh
    n = (F.col("_n0") + F.col("_n1")) * m
    asked = f.withColumns({"_ranks": F.array(F.floor((n - 1) / 2), F.ceil((n - 1) / 2)), "_own": (F.col("_own0") + F.col("_own1")) * m})
    f = ranked(t, asked, lambda v, w: linear(v, w, m, d), base, None, "_scale").withColumn("_scale", (F.col("_scale")[0] + F.col("_scale")[1]) / 2).drop("_ranks", "_own", "_near").localCheckpoint()
    middle = float(f.agg(F.avg("_scale")).first()[0] or 0.0)
    weights = base.reshape(m, d)
    base = np.append(base, middle)
    top = t.basis.top

    def weigh(v: np.ndarray, theta: np.ndarray) -> np.ndarray:
        return G.softmax_weights(linear(v, theta, m, d), theta[..., m * d : m * d + 1])

    def moved(r: dict) -> dict:
        s, s0 = r["_scale"] + G.EPS, middle + G.EPS
        logits = np.abs(np.array(r["_theta"]).reshape(m, d) / s - weights / s0) @ top if s > 0 and s0 > 0 else np.array([np.inf])
        return {"_bound": shifted(float(logits.max()), wide, most), "_logit": float(logits.max())}

    f = per_fold(f, moved, "_bound double, _logit double").drop("_delta").withColumnRenamed("_bound", "_delta")
    f = f.withColumn("_theta", F.concat("_theta", F.array("_scale"))).drop("_scale").localCheckpoint()
    return frozen(t, f, base, weigh, middle, m, most) if options.get("freeze") else (f, base, weigh)


def frozen(t: Rows, f: DataFrame, base: np.ndarray, weigh: Score, scale: float | None, m: int, most: float) -> tuple[DataFrame, np.ndarray, Score]:
    """``f`` with each fold's mean weights over all other rows as _theta: those of all rows by the fold's fit, expanded around ``base`` (softmax weights of small
    moves) or summed by passes, less its own."""
    d = len(t.basis.top)
    flat = over_blocks(t.blocks, t.width, lambda v: slopes(v, weigh(v, base), m, d)) if scale is not None else None

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in batches:
            if not r.num_rows:
                continue
            v = np.frombuffer(b"".join(r["_row"].to_pylist())).reshape(-1, width)
            w = weigh(v, r["_theta"].flatten().to_numpy().reshape(r.num_rows, -1))
            yield pa.RecordBatch.from_arrays([r["_i"], *[pa.array(w[:, i]) for i in range(m)]], ["_k", *[f"_w{i}" for i in range(m)]])

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in batches:
            for x in r["b"]:
                v = np.frombuffer(x.as_buffer()).reshape(-1, width)
                yield pa.RecordBatch.from_arrays([pa.array(v[:, 0].astype(np.int64)), pa.array([z.tobytes() for z in v])], ["_k", "_row"])

    width = t.width
    rows = t.blocks.mapInArrow(single, "_k long, _row binary").join(f.select("_i", "_theta"), F.col("_k") == F.col("_i")).select("_i", "_theta", "_row")
    mine = rows.mapInArrow(own, "_k long, " + ", ".join(f"_w{i} double" for i in range(m))).groupBy("_k").agg(F.array(*[F.sum(f"_w{i}") for i in range(m)]).alias("_mine"))
    f = f.join(mine, F.col("_i") == F.col("_k"), "left").drop("_k").localCheckpoint()
    near = (F.col("_logit") <= STILL) if scale is not None else F.lit(False)
    left, sums = f.where(~F.coalesce(near, F.lit(False))).select("_i", "_theta").collect(), []
    for at in range(0, len(left), CHUNK):
        part = [np.array(r[1]) for r in left[at : at + CHUNK]]
        got = over_blocks(t.blocks, t.width, lambda v, part=part: np.stack([weigh(v, w).sum(axis=0) for w in part]))
        sums += [(r[0], s.tolist()) for r, s in zip(left[at : at + CHUNK], got, strict=True)]
    f = replaced(f.withColumn("_sum", F.lit(None).cast("array<double>")), sums, "_sum", "array<double>")
    before = base[: m * d].reshape(m, d) / (scale + G.EPS) if scale is not None else None

    def mean(r: dict) -> dict:
        if r["_sum"] is not None:
            every = np.array(r["_sum"])
        else:
            x = np.array(r["_theta"])
            every = expanded(flat, before - x[: m * d].reshape(m, d) / (x[-1] + G.EPS))
        w = (every - np.array(r["_mine"] or np.zeros(m))) / (r["_n0"] + r["_n1"])
        return {"_mean": w.tolist()}

    f = per_fold(f, mean, "_mean array<double>").drop("_theta", "_delta", "_mine", "_sum").withColumnRenamed("_mean", "_theta").localCheckpoint()
    level = np.array([float(v) for v in f.agg(*[F.avg(F.col("_theta")[i]) for i in range(m)]).first()])
    away = F.aggregate(F.array(*[F.abs(F.col("_theta")[i] - float(level[i])) for i in range(m)]), F.lit(0.0), lambda a, b: a + b)
    return f.withColumn("_delta", away * most), level, lambda v, theta: np.broadcast_to(theta, (len(v), m))

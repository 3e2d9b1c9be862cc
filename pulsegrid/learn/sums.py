"""Leave-one-group-out fits from sums: no row is shipped to a fold, and no fold is a frame.

A fold's learning rows are all rows but its own, so its medians, means and deviations are those of the table less its own share. With few folds each Newton
step of all folds and all models is one pass over the rows where they lie: a task turns its rows into the gradient and the curvature of every fold (a row
adds to all folds but its own), these are summed, and the driver solves folds x models small systems.

That work is rows x folds. With many folds each fit lies close to the fit of the whole table, around which the gradient of all rows is expanded: one pass
gives its derivatives, and a fold then takes its steps alone, from the expansion less its own rows' exact share. What the expansion leaves out is bounded, as
the derivatives of the logistic function are; folds whose bound exceeds TOLERANCE are fitted by the passes above.
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

from pulsegrid.learn.models import logistic
from pulsegrid.operators import tables

#: Newton steps at most; a step under TOLERANCE in every fold ends the fit before.
ROUNDS, TOLERANCE = 30, 1e-9

#: Up to FEW folds, and beyond WIDE columns of a model (a gap counts as a column), all fits are made by passes over rows x folds.
FEW, WIDE = 32, 10


@dataclass
class Folds:
    """Per fold (in ``values``, the table's own ids) what its other rows say of a model's columns."""

    values: list
    median: np.ndarray  # (folds, columns)
    mean: np.ndarray
    std: np.ndarray
    positives: np.ndarray  # (folds,) labelled rows of class 1, and of class 0
    negatives: np.ndarray


def finite(c: str) -> Column:
    v = F.col(c).cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def numbered(df: DataFrame, columns: Sequence[str], label: str, fold: str, only: list | None = None) -> tuple[DataFrame, list]:
    """_fold (a dense number; -1 for a null fold), _y (null without a label) and the columns (missing and infinite: null), and the folds' own ids.

    The ids are numbered and joined by Spark, so no id passes through another type. Folds that are not among ``only`` count as null."""
    values = tables.fold_values(df, fold) if only is None else only
    kind = df.schema[fold].dataType
    named = df.sparkSession.createDataFrame(list(enumerate(values)), T.StructType([T.StructField("_fold", T.IntegerType()), T.StructField("_id", kind)]))
    x = df.join(named, F.col(fold) == F.col("_id"), "left").withColumn("_fold", F.coalesce("_fold", F.lit(-1)))
    y = F.when(F.col(label).isNotNull(), (F.col(label) == 1).cast("double"))
    return x.select("_fold", y.alias("_y"), *[finite(c).alias(c) for c in columns]), values


def statistics(x: DataFrame, columns: Sequence[str], values: list) -> Folds:
    """Medians, means and deviations of each fold's labelled other rows, missing values taken as the median (0 for a column without any)."""
    n, d = len(values), len(columns)
    learn = x.where("_y IS NOT NULL")
    sums = [f.alias(f"{k}{i}") for i, c in enumerate(columns) for k, f in (("n", F.count(c)), ("s", F.sum(c)), ("q", F.sum(F.col(c) * F.col(c))))]
    own = np.zeros((n + 1, 3 * d + 2))  # the last row: no fold
    for r in learn.groupBy("_fold").agg(F.sum("_y"), F.sum(1 - F.col("_y")), *sums).collect():
        own[r[0]] = [v or 0.0 for v in r[1:]]
    rest = own.sum(axis=0) - own[:n]
    rows = rest[:, 0] + rest[:, 1]
    known, total, squares = (rest[:, 2 + k :: 3] for k in range(3))
    missing = rows[:, None] - known
    median = np.zeros((n, d))
    gaps = x.agg(F.lit(0), *[F.count_if(F.col(c).isNull()) for c in columns]).first()[1:]
    for i, c in enumerate(columns):
        if gaps[i]:
            for r in tables.others_quantile(learn, c, "_fold", 0.5).collect():
                if r["_fold"] >= 0 and r["value"] is not None:
                    median[r["_fold"], i] = r["value"]
    at_least_one = np.maximum(rows, 1)[:, None]
    mean = (total + missing * median) / at_least_one
    std = np.sqrt(np.maximum((squares + missing * median**2) / at_least_one - mean**2, 0))
    std[std <= 1e-12 * np.maximum(1, np.abs(mean))] = 1
    return Folds(values, median, mean, std, rest[:, 0], rest[:, 1])


def passed(x: DataFrame, columns: Sequence[str], shape: int, per_fold: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of ``per_fold(values, labels, folds of the rows)``, an array of ``shape`` rows: added up in the tasks, then by Spark."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            v = np.column_stack([b[c].to_numpy(zero_copy_only=False).astype(float) for c in columns]) if columns else np.zeros((b.num_rows, 0))
            s = per_fold(v, b["_y"].to_numpy(zero_copy_only=False).astype(float), b["_fold"].to_numpy(zero_copy_only=False))
            total = s if total is None else total + s
        if total is not None:
            at, i = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(i.astype(np.int32)), pa.array(total[at, i])], ["f", "i", "v"])

    width = per_fold(np.zeros((0, len(columns))), np.zeros(0), np.zeros(0, int)).shape[1]
    out = np.zeros((shape, width))
    for f, i, v in x.mapInArrow(task, "f int, i int, v double").groupBy("f", "i").agg(F.sum("v")).collect():
        out[f, i] = v
    return out


def logistic_sums(models: Sequence[tuple[list[int], Folds, np.ndarray]], balance: bool) -> Callable:
    """Gradient and lower curvature triangle of each fold, for each (column places, statistics, weights (folds, columns + 1)) beside one another."""

    def run(v: np.ndarray, y: np.ndarray, of: np.ndarray) -> np.ndarray:
        out = []
        for at, s, w in models:
            p = len(at) + 1
            low = np.tril_indices(p)
            part = np.zeros((len(s.values), p + len(low[0])))
            x = v[:, at]
            gap = np.isnan(x)
            for f in range(len(s.values)):
                z = np.column_stack([(np.where(gap, s.median[f], x) - s.mean[f]) / s.std[f], np.ones(len(x))])
                q = logistic(z @ w[f])
                n = s.positives[f] + s.negatives[f]
                scale = np.where(y > 0, n / (2 * max(s.positives[f], 1)), n / (2 * max(s.negatives[f], 1))) if balance else np.ones(len(y))
                scale = np.where(of == f, 0, scale)
                part[f, :p] = z.T @ (scale * (q - y))
                part[f, p:] = ((z * (scale * np.maximum(q * (1 - q), 1e-9))[:, None]).T @ z)[low]
            out.append(part)
        return np.concatenate(out, axis=1)

    return run


FIELDS = "median array<double>, mean array<double>, std array<double>, w array<double>, share double"


def fitted_type(df: DataFrame, models: Mapping[str, Sequence[str]], fold: str) -> T.StructType:
    return T.StructType([T.StructField(fold, df.schema[fold].dataType), *[T.StructField(f"p_{m}_w", T.StructType.fromDDL(FIELDS)) for m in models]])


def lopo_logistic(df: DataFrame, models: Mapping[str, Sequence[str]], label: str, fold: str = "patient", c: float = 1.0, balance: bool = True) -> DataFrame:
    """(fold, and for each model p_<name>_w, a struct of arrays: median, mean, std, w with the intercept last, and share): for each fold the L2 logistic regression
    (half the squared weights of standardised columns plus c times the class-balanced log loss) of all other labelled rows.

    Rows without a label learn nothing; rows without a fold learn in all. With one class among the others ``share`` is its rate (0.5 without any), else null.
    """
    if len(df.select(fold).where(F.col(fold).isNotNull()).distinct().limit(FEW + 1).collect()) <= FEW:
        return by_passes(df, models, label, fold, c, balance)
    columns = list(dict.fromkeys(x for cs in models.values() for x in cs))
    gaps = [k for k, n in zip(columns, df.agg(F.lit(0), *[F.count_if(finite(k).isNull()) for k in columns]).first()[1:], strict=True) if n]
    if any(len(cs) + len(set(cs) & set(gaps)) > WIDE for cs in models.values()):
        return by_passes(df, models, label, fold, c, balance)
    got = by_expansion(df, models, label, fold, c, balance, columns, gaps).localCheckpoint()
    left = got.where("NOT ok").select(fold)
    if not left.take(1):
        return got.drop("ok")
    return got.where("ok").drop("ok").unionByName(by_passes(df, models, label, fold, c, balance, sorted(r[0] for r in left.collect())))


def summed(x: DataFrame, columns: Sequence[str], run: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of ``run(values, labels)``, a flat array; tasks send one row each."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            s = run(np.column_stack([b[c].to_numpy(zero_copy_only=False).astype(float) for c in columns]), b["_y"].to_numpy(zero_copy_only=False).astype(float))
            total = s if total is None else total + s
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["s"])

    parts = [np.frombuffer(r[0]) for r in x.mapInArrow(task, "s binary").collect()]
    return np.sum(parts, axis=0) if parts else run(np.zeros((0, len(columns))), np.zeros(0))


def expansion(u: np.ndarray, y: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """Of each class the log loss's first four derivatives at ``theta``, and the fourth moments, flat."""
    out = []
    q = logistic(u @ theta)
    for k in (0, 1):
        v, p = u[y == k], q[y == k]
        s = p * (1 - p)
        pairs = (v[:, :, None] * v[:, None, :]).reshape(len(v), v.shape[1] ** 2)
        out += [v.T @ (p - k), (v * s[:, None]).T @ v, (pairs * (s * (1 - 2 * p))[:, None]).T @ v, (pairs * (s * (1 - 6 * s))[:, None]).T @ pairs, pairs.T @ pairs]
    return np.concatenate([a.ravel() for a in out])


def folded_out(flat: np.ndarray, d: int) -> list[list[np.ndarray]]:
    """The arrays that ``expansion`` made flat, for each class."""
    shapes, out, at = [(d,), (d, d), (d, d, d), (d,) * 4, (d,) * 4], [], 0
    for _ in (0, 1):
        out.append([])
        for shape in shapes:
            n = int(np.prod(shape))
            out[-1].append(flat[at : at + n].reshape(shape))
            at += n
    return out


def by_expansion(df: DataFrame, models: Mapping[str, Sequence[str]], label: str, fold: str, c: float, balance: bool, columns: list[str], gaps: list[str]) -> DataFrame:
    """As ``lopo_logistic``, with ok: whether what the expansion leaves out moves no weight by TOLERANCE. The driver holds a few sums; a fold's rows meet once."""
    d = len(columns)
    y = F.when(F.col(label).isNotNull(), (F.col(label) == 1).cast("double"))
    x = df.select(F.col(fold).alias("_f"), y.alias("_y"), *[finite(k).alias(k) for k in columns])
    learn = x.where("_y IS NOT NULL").persist()
    try:
        first = learn.agg(F.sum("_y"), F.sum(1 - F.col("_y")), *[f for k in columns for f in (F.count(k), F.avg(k))]).first()
        shift = np.array([v or 0.0 for v in first[3::2]])  # sums of squares are taken around the mean
        median = np.array([(learn.agg(F.median(k)).first()[0] or 0.0) if k in gaps else 0.0 for k in columns])
        own = lambda v, z: np.concatenate([[(z == 1).sum(), (z == 0).sum()], np.isfinite(v).sum(axis=0), np.nansum(v - shift, axis=0), np.nansum((v - shift) ** 2, axis=0)]).astype(float)
        total = summed(learn, columns, own)

        def scales(t: np.ndarray, med: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
            rows = max(t[0] + t[1], 1)
            miss, known, squares = t[0] + t[1] - t[2 : 2 + d], t[2 + d : 2 + 2 * d], t[2 + 2 * d : 2 + 3 * d]
            m = (known + miss * (med - shift)) / rows
            std = np.sqrt(np.maximum((squares + miss * (med - shift) ** 2) / rows - m**2, 0))
            mean = m + shift
            std[std <= 1e-12 * np.maximum(1, np.abs(mean))] = 1
            return mean, std, t[0], t[1]

        mean, std, n1, n0 = scales(total, median)
        weigh = lambda a, b: ((a + b) / (2 * max(b, 1)), (a + b) / (2 * max(a, 1))) if balance else (1.0, 1.0)
        places = {m: ([columns.index(k) for k in cs], [columns.index(k) for k in cs if k in gaps]) for m, cs in models.items()}

        def basis(v: np.ndarray, at: list[int], flags: list[int]) -> np.ndarray:
            z = (v[:, at] - mean[at]) / std[at]
            return np.column_stack([np.where(np.isnan(z), 0, z), np.isnan(v[:, flags]), np.ones(len(v))])

        def turn(at: list[int], flags: list[int], med: np.ndarray, m: np.ndarray, s: np.ndarray) -> np.ndarray:
            """From weights of a fold's standardised columns to those of the basis."""
            b = np.zeros((len(at) + len(flags) + 1, len(at) + 1))
            for j, k in enumerate(at):
                b[j, j] = std[k] / s[k]
                b[-1, j] = (mean[k] - m[k]) / s[k]
                if k in flags:
                    b[len(at) + flags.index(k), j] = (med[k] - mean[k]) / s[k]
            b[-1, -1] = 1
            return b

        centre, parts = {}, {}
        turns = {m: turn(*places[m], median, mean, std) for m in models}
        regs = {m: np.append(np.full(len(places[m][0]), 1 / c), 1e-9) for m in models}
        ws = {m: np.zeros(len(places[m][0]) + 1) for m in models}
        for _ in range(ROUNDS if n1 and n0 else 0):

            def step_sums(v: np.ndarray, z: np.ndarray) -> np.ndarray:
                out, (s0, s1) = [], weigh(n1, n0)
                for m in models:
                    u = basis(v, *places[m])
                    q, s = logistic(u @ turns[m] @ ws[m]), np.where(z > 0, s1, s0)
                    out += [u.T @ (s * (q - z)), ((u * (s * np.maximum(q * (1 - q), 1e-9))[:, None]).T @ u).ravel()]
                return np.concatenate(out)

            sums, begin, largest = summed(learn, columns, step_sums), 0, 0.0
            for m in models:
                b = turns[m]
                g, h = sums[begin : begin + len(b)], sums[begin + len(b) : begin + len(b) + len(b) ** 2].reshape(len(b), len(b))
                step = np.linalg.solve(b.T @ h @ b + np.diag(regs[m]), b.T @ g + regs[m] * ws[m])
                ws[m] = ws[m] - step
                largest, begin = max(largest, float(np.abs(step).max())), begin + len(b) + len(b) ** 2
            if largest < 1e-6:  # any near point serves as the centre
                break
        for m in models:
            centre[m] = turns[m] @ ws[m]
        flat = summed(learn, columns, lambda v, z: np.concatenate([*[expansion(basis(v, *places[m]), z, centre[m]) for m in models], np.zeros(0)]))
        begin = 0
        for m in models:
            size = len(centre[m])
            n = 2 * (size + size**2 + size**3 + 2 * size**4)
            parts[m], begin = folded_out(flat[begin : begin + n], size), begin + n
        top = learn.agg(*[F.max(F.abs((F.col(k) - float(mean[i])) / float(std[i]))) for i, k in enumerate(columns)]).first()
        top = np.array([v or 0.0 for v in top])
    finally:
        learn.unpersist()
    for k in gaps:
        value = tables.others_quantile(x.where("_y IS NOT NULL"), k, "_f", 0.5).select(F.col("_f").alias("_g"), F.col("value").alias(f"_m{columns.index(k)}"))
        x = x.join(value, F.col("_f") == F.col("_g"), "left").drop("_g")
    kind = fitted_type(df, models, fold)
    target = to_arrow_schema(kind.add("ok", "boolean"))
    inner = [target.field(f"p_{m}_w").type for m in models]

    def solved(m: str, v: np.ndarray, z: np.ndarray, b: np.ndarray, a: tuple[float, float]) -> tuple[np.ndarray, bool]:
        reg, w, at0 = regs[m], ws[m].copy(), centre[m]
        u = basis(v, *places[m])
        s = np.where(z > 0, a[1], a[0])
        moved = False
        for _ in range(ROUNDS):
            theta = b @ w
            t = theta - at0
            g, h = np.zeros(len(t)), np.zeros((len(t), len(t)))
            for (d1, d2, d3, d4, _), k in zip(parts[m], a, strict=True):
                e3, e4 = d3 @ t, d4 @ t @ t
                g += k * (d1 + d2 @ t + e3 @ t / 2 + e4 @ t / 6)
                h += k * (d2 + e3 + e4 / 2)
            q = logistic(u @ theta)
            g -= u.T @ (s * (q - z))
            h -= (u * (s * q * (1 - q))[:, None]).T @ u
            try:
                inverse = np.linalg.inv(b.T @ h @ b + np.diag(reg))
            except np.linalg.LinAlgError:
                return w, False
            step = inverse @ (b.T @ g + reg * w)
            w = w - step
            moved = np.abs(step).max() < TOLERANCE
            if moved or not np.isfinite(w).all():
                break
        # the fourth derivative of the logistic function stays under 0.14
        t = b @ w - at0
        fourth = sum(k * float(p[4] @ t @ t @ t @ t) for p, k in zip(parts[m], a, strict=True))
        largest = np.concatenate([top[places[m][0]], np.ones(len(t) - len(places[m][0]))])
        bound = np.abs(inverse) @ np.abs(b.T) @ largest * fourth * 0.14 / 24
        return w, bool(moved and np.isfinite(w).all() and bound.max() <= TOLERANCE)

    def task(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        z = table["_y"].to_numpy().astype(float)
        v = np.column_stack([table[k].to_numpy().astype(float) for k in columns]) if columns else np.zeros((len(z), 0))
        med = np.array([(table[f"_m{i}"][0].as_py() or 0.0) if k in gaps else 0.0 for i, k in enumerate(columns)])
        v, z = v[np.isfinite(z)], z[np.isfinite(z)]
        t = total - own(v, z)
        mu, s, k1, k0 = scales(t, med)
        ok, row = True, []
        for m, (at, flags) in places.items():
            share, w = None, np.zeros(len(at) + 1)
            if k1 > 0 and k0 > 0:
                w, fine = solved(m, v, z, turn(at, flags, med, mu, s), weigh(k1, k0))
                ok = ok and fine
            else:
                share = k1 / (k1 + k0) if k1 + k0 else 0.5
            row.append({"median": med[at].tolist(), "mean": mu[at].tolist(), "std": s[at].tolist(), "w": w.tolist(), "share": share})
        return pa.Table.from_arrays([pa.array([key[0].as_py()], target.field(0).type), *[pa.array([r], f) for r, f in zip(row, inner, strict=True)], pa.array([ok])], schema=target)

    return x.where("_f IS NOT NULL").groupBy("_f").applyInArrow(task, kind)


def by_passes(df: DataFrame, models: Mapping[str, Sequence[str]], label: str, fold: str, c: float, balance: bool, only: list | None = None) -> DataFrame:
    """As ``lopo_logistic``, each step of all folds (or of ``only`` these) by one pass over the rows."""
    columns = list(dict.fromkeys(x for cs in models.values() for x in cs))
    x, values = numbered(df, columns, label, fold, only)
    learn = x.where("_y IS NOT NULL").persist()
    try:
        every = statistics(x, columns, values)
        parts = []
        for cs in models.values():
            at = [columns.index(k) for k in cs]
            s = Folds(values, every.median[:, at], every.mean[:, at], every.std[:, at], every.positives, every.negatives)
            parts.append((at, s, np.zeros((len(values), len(at) + 1))))
        both = (every.positives > 0) & (every.negatives > 0)
        for _ in range(ROUNDS if both.any() else 0):
            sums, begin, largest, moved = passed(learn, columns, len(values), logistic_sums(parts, balance)), 0, 0.0, []
            for at, s, w in parts:
                p = len(at) + 1
                low = np.tril_indices(p)
                reg = np.append(np.full(p - 1, 1 / c), 1e-9)
                h = np.zeros((len(values), p, p))
                h[:, low[0], low[1]] = h[:, low[1], low[0]] = sums[:, begin + p : begin + p + len(low[0])]
                step = np.zeros_like(w)
                step[both] = np.linalg.solve(h[both] + np.diag(reg), (sums[:, begin : begin + p] + reg * w)[both][:, :, None])[:, :, 0]
                moved.append((at, s, w - step))
                largest = max(largest, float(np.abs(step).max(initial=0)))
                begin += p + len(low[0])
            parts = moved
            if largest < TOLERANCE:
                break
    finally:
        learn.unpersist()
    n = every.positives + every.negatives
    share = [None if b else (float(k / m) if m else 0.5) for b, k, m in zip(both, every.positives, n, strict=True)]
    rows = [(v, *[(s.median[i].tolist(), s.mean[i].tolist(), s.std[i].tolist(), w[i].tolist(), share[i]) for _, s, w in parts]) for i, v in enumerate(values)]
    return df.sparkSession.createDataFrame(rows, fitted_type(df, models, fold))


def linear(w: Column, columns: Sequence[str]) -> Column:
    """The score of a row by the struct ``w`` of ``lopo_logistic``."""
    z = F.element_at(w["w"], -1)
    for i, c in enumerate(columns):
        z = z + w["w"][i] * (F.coalesce(finite(c), w["median"][i]) - w["mean"][i]) / w["std"][i]
    z = F.least(F.greatest(z, F.lit(-35.0)), F.lit(35.0))
    return F.coalesce(w["share"], 1 / (1 + F.exp(-z)))


def lopo_scores(df: DataFrame, models: Mapping[str, Sequence[str]], label: str, fold: str = "patient", c: float = 1.0) -> DataFrame:
    """``df`` with p_<model>: the score of each row, labelled or not, by the fit of its fold's other rows. Rows without a fold have none."""
    w = lopo_logistic(df, models, label, fold, c)
    out = df.join(w, fold)
    return out.select(*df.columns, *[linear(F.col(f"p_{m}_w"), cs).alias(f"p_{m}") for m, cs in models.items()])

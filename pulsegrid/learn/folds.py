"""Fold machinery: leave-one-group-out and grouped k-fold; mixtures of experts and their evaluation.

Logistic experts are fitted from sums (``learn.sums``), gating networks of a few folds by passes (``learn.nets``), ridge and component gates by sums and bands
(``learn.nearby``). For all other learners a task reads all rows, as the window tables that experts learn from fit one machine, and fits the folds dealt to it. Statistics that need no model take the
closed form of ``operators.tables.loo_means`` instead, and single large fits go through ``learn.pipelines``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pulsegrid.learn import gates as G
from pulsegrid.learn import nearby, nets, sums
from pulsegrid.learn import trials as searches
from pulsegrid.learn.models import Boosted, Isotonic, Logistic, make_classifier, rank_auc
from pulsegrid.operators.tables import fold_values
from pulsegrid.sources import cache


def spread(total: list[list[float]], scale: list[float], f: int, more: list[float]) -> float:
    """The deviations of the folds' class shares with a group's rows in fold ``f``, in plain numbers: there is one call for each group and fold."""
    out, k = 0.0, len(total)
    for c in (0, 1):
        v = [t[c] / scale[c] for t in total]
        v[f] = (total[f][c] + more[c]) / scale[c]
        mean = 0.0
        for x in v:
            mean += x
        mean /= k
        square = 0.0
        for x in v:
            square += (x - mean) * (x - mean)
        out += math.sqrt(square / k)
    return out


def dealt(count: np.ndarray, k: int, seed: int = 42) -> np.ndarray:
    """Fold of each group of ``count`` rows of the two classes, groups in the order of their names: see ``group_folds``."""
    tie = np.random.default_rng(seed).permutation(len(count))
    order = np.lexsort([tie, -count.sum(axis=1)]).tolist()
    total, fold_of = [[0.0, 0.0] for _ in range(k)], np.zeros(len(count), int)
    scale, count = np.maximum(count.sum(axis=0), 1).tolist(), count.astype(float).tolist()
    for g in order:
        f = min((spread(total, scale, f, count[g]), total[f][0] + total[f][1], f) for f in range(k))[2]
        fold_of[g] = f
        total[f] = [total[f][0] + count[g][0], total[f][1] + count[g][1]]
    return fold_of


def group_folds(groups: np.ndarray, y: np.ndarray, k: int = 5, seed: int = 42) -> np.ndarray:
    """Fold of each row: whole groups, heaviest first (equal ones in seeded order), each to the fold that then has the most even class counts."""
    inverse, names = pd.factorize(groups, sort=True)
    if (inverse < 0).any():  # rows of a null group are one more group
        inverse, names = np.where(inverse < 0, len(names), inverse), [*names, None]
    count = np.stack([np.bincount(inverse, weights=(y == c)) for c in (0, 1)], axis=1)
    fold_of = dealt(count, k, seed)
    return fold_of[inverse]


def dealt_out(table: DataFrame, label: str, k: int) -> DataFrame:
    """``table`` with _fold, of the patients as ``group_folds`` deals them; only their counts come to the driver."""
    y = F.col(label)
    groups = table.groupBy("patient").agg(F.count_if(y == 0).alias("n0"), F.count_if(y == 1).alias("n1")).orderBy(F.col("patient").asc_nulls_last()).collect()
    part = dealt(np.array([[r["n0"], r["n1"]] for r in groups], float).reshape(-1, 2), k)
    kind = table.schema["patient"].dataType.simpleString()
    folds = table.sparkSession.createDataFrame([(r["patient"], int(f)) for r, f in zip(groups, part, strict=True)], f"_group {kind}, _fold int")
    return table.join(folds, F.col("patient").eqNullSafe(F.col("_group"))).drop("_group")


#: Most tasks that folds are dealt to. Each task holds the table once, however many folds it fits.
WORKERS = 256


def frame(table: pa.Table) -> pd.DataFrame:
    """The table in pandas; whole numbers with nulls stay whole numbers, whatever their size."""
    out = table.to_pandas()
    for f in table.schema:
        if pa.types.is_integer(f.type) and table[f.name].null_count and f.name in ("patient", "win_idx"):
            out[f.name] = table[f.name].to_pandas(types_mapper={f.type: pd.Int64Dtype()}.get)
    return out


def apart(spark, n: int) -> list[int]:
    """Whole numbers that ``repartition(n)`` sends to different partitions, so that none of ``n`` workers waits for another one's share."""
    at = spark.range(64 * n + 64).select(F.col("id").cast("int").alias("k")).select("k", F.pmod(F.hash("k"), F.lit(n)).alias("p"))
    return [r["k"] for r in at.groupBy("p").agg(F.min("k").alias("k")).orderBy("p").collect()]  # n rows


def by_fold(df: DataFrame, fold: str, run: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, label: str | None = None) -> DataFrame:
    """run(train, test) for each value of ``fold``; rows without a fold learn in all and are tested in none, rows without a ``label`` learn in none and are tested.

    Folds are numbered in Spark and dealt to as many tasks as run at a time. Every row goes to each task once, not to each fold, so leaving one of a thousand
    groups out moves no more rows than leaving one of ten out. Meant for tables that fit a task; what comes back doesn't depend on the dealing."""
    values = fold_values(df, fold)
    named = df.sparkSession.createDataFrame(list(enumerate(values)), T.StructType([T.StructField("_fold", T.IntegerType()), T.StructField("_id", df.schema[fold].dataType)]))
    df = df.join(named, F.col(fold) == F.col("_id"), "left").withColumn("_fold", F.coalesce("_fold", F.lit(-1))).drop("_id")
    n = max(1, min(len(values), df.sparkSession.sparkContext.defaultParallelism, WORKERS))
    names = apart(df.sparkSession, n)
    x = df.withColumn("_worker", F.explode(F.array(*[F.lit(k) for k in names]))).repartition(n, "_worker")
    target = to_arrow_schema(T.StructType.fromDDL(schema))

    def task(table: pa.Table) -> pa.Table:
        own = range(len(values))[names.index(table["_worker"][0].as_py()) :: n]
        pdf = frame(table.drop_columns("_worker")).sort_values([c for c in ("patient", "win_idx") if c in table.column_names]).reset_index(drop=True)
        at, learns = pdf.pop("_fold").to_numpy(), pdf[label].notna().to_numpy() if label else np.ones(len(pdf), bool)
        out = [run(pdf[(at != f) & learns], pdf[at == f].assign(**({fold: values[f]} if fold not in ("patient", "win_idx") else {}))) for f in own]
        got = pd.concat(out, ignore_index=True) if out else run(pdf.iloc[:0], pdf.iloc[:0])
        return pa.Table.from_arrays([pa.array(got[f.name], type=f.type, from_pandas=True) for f in target], schema=target)

    return x.groupBy("_worker").applyInArrow(task, schema)


def fit_predict(spec, columns: Sequence[str], label: str) -> Callable[[pd.DataFrame, pd.DataFrame], np.ndarray]:
    """Scores of the test rows; one class in training gives its share."""

    def run(tr: pd.DataFrame, te: pd.DataFrame) -> np.ndarray:
        y = tr[label].to_numpy(float)
        if len(np.unique(y)) < 2:
            return np.full(len(te), y.mean() if len(y) else 0.5)
        cols = list(columns)
        return make_classifier(spec).fit(tr[cols].to_numpy(float), y).predict(te[cols].to_numpy(float))

    return run


def logistic_strength(spec) -> float | None:
    """C of a plain logistic learner, None for any other."""
    name, params = spec if isinstance(spec, tuple) else (spec, {})
    return float(params.get("c", 1.0)) if name == "LR" and not set(params) - {"c"} else None


def lopo_predictions(df: DataFrame, columns: Sequence[str], label: str, spec="LR", fold: str = "patient") -> DataFrame:
    """(patient, win_idx, y, p): out-of-fold scores, each window once. Unlabelled rows learn nothing and are scored."""
    if (c := logistic_strength(spec)) is not None:
        need = list(dict.fromkeys(["patient", "win_idx", label, fold, *columns]))
        return sums.lopo_scores(df.select(*need), {"": columns}, label, fold, c).select("patient", "win_idx", F.col(label).alias("y"), F.col("p_").alias("p"))
    score = fit_predict(spec, columns, label)

    def run(tr: pd.DataFrame, te: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"patient": te["patient"], "win_idx": te["win_idx"], "y": te[label], "p": score(tr, te)})

    kinds = dict(df.dtypes)
    need = dict.fromkeys(["patient", "win_idx", label, fold, *columns])
    return by_fold(df.select(*need), fold, run, f"patient {kinds['patient']}, win_idx {kinds['win_idx']}, y {kinds[label]}, p double", label)


def expert_oof(df: DataFrame, experts: dict[str, Sequence[str]], label: str, spec="LR", fold: str = "patient") -> DataFrame:
    """(patient, win_idx, y, p_<expert>): out-of-fold scores of each expert on its own columns. Unlabelled rows learn nothing and are scored."""
    if (c := logistic_strength(spec)) is not None:
        need = list(dict.fromkeys(["patient", "win_idx", label, fold, *[x for cs in experts.values() for x in cs]]))
        return sums.lopo_scores(df.select(*need), experts, label, fold, c).select("patient", "win_idx", F.col(label).alias("y"), *[f"p_{m}" for m in experts])

    def run(tr: pd.DataFrame, te: pd.DataFrame) -> pd.DataFrame:
        own = {f"p_{m}": fit_predict(spec, c, label)(tr, te) for m, c in experts.items()}
        return pd.DataFrame({"patient": te["patient"], "win_idx": te["win_idx"], "y": te[label]} | own)

    kinds = dict(df.dtypes)
    need = dict.fromkeys(["patient", "win_idx", label, fold, *[c for cs in experts.values() for c in cs]])
    return by_fold(df.select(*need), fold, run, f"patient {kinds['patient']}, win_idx {kinds['win_idx']}, y {kinds[label]}, " + ", ".join(f"p_{m} double" for m in experts), label)


def precompute_folds(df: DataFrame, experts: dict[str, Sequence[str]], label: str, spec="LR", fold: str = "patient", inner: int = 5, seed: int = 42) -> DataFrame:
    """(fold, patient, win_idx, split, y, p_<expert>): per outer fold the test rows' scores by experts fitted on all training
    rows, and the training rows' own out-of-fold scores. To be written once and shared by all gate variants."""

    def run(tr: pd.DataFrame, te: pd.DataFrame) -> pd.DataFrame:
        parts = group_folds(tr["patient"].to_numpy(), tr[label].to_numpy(), min(inner, tr["patient"].nunique()), seed)
        ptr = {m: np.full(len(tr), np.nan) for m in experts}
        for k in np.unique(parts):
            a, b = tr[parts != k], tr[parts == k]
            for m, c in experts.items():
                ptr[m][parts == k] = fit_predict(spec, c, label)(a, b) if len(a) else 0.5
        out = [pd.DataFrame({"split": "train", "patient": tr["patient"], "win_idx": tr["win_idx"], "y": tr[label]} | {f"p_{m}": v for m, v in ptr.items()})]
        out.append(pd.DataFrame({"split": "test", "patient": te["patient"], "win_idx": te["win_idx"], "y": te[label]} | {f"p_{m}": fit_predict(spec, c, label)(tr, te) for m, c in experts.items()}))
        return pd.concat(out).assign(fold=te[fold].iloc[0])

    kinds = dict(df.dtypes)
    need = dict.fromkeys(["patient", "win_idx", label, fold, *[c for cs in experts.values() for c in cs]])
    schema = f"fold {kinds[fold]}, patient {kinds['patient']}, win_idx {kinds['win_idx']}, split string, y {kinds[label]}, " + ", ".join(f"p_{m} double" for m in experts)
    return by_fold(df.select(*need), fold, lambda a, b: run(a, b)[[c.split()[0] for c in schema.split(", ")]], schema, label)


def cached_folds(df: DataFrame, experts: dict[str, Sequence[str]], label: str, folder: str, spec="LR", fold: str = "patient", inner: int = 5, seed: int = 42, force: bool = False) -> DataFrame:
    """``precompute_folds`` written under a signature of the table's content and of everything that shapes the scores; made only if it isn't
    there. What is read back must hold the table's own windows, each tested once: a cache of other data is an error."""
    need = list(dict.fromkeys(["patient", "win_idx", label, fold, *[c for cs in experts.values() for c in cs]]))
    content = cache.table_signature(df, need)
    settings = {"table": content, "experts": {m: list(c) for m, c in experts.items()}, "label": label, "spec": repr(spec), "fold": fold, "inner": inner, "seed": seed}
    made = cache.load_or_make(df.sparkSession, folder, "folds", settings, lambda: precompute_folds(df, experts, label, spec, fold, inner, seed), force, partition_by="fold")
    tested = made.where("split = 'test'").select("patient", "win_idx", F.col("y").alias(label))
    keys = ["patient", "win_idx", label]
    cache.verify(cache.table_signature(df.where(F.col(fold).isNotNull()).select(*keys), keys), cache.table_signature(tested, keys))
    return made


def run_moe(df: DataFrame, experts: dict[str, Sequence[str]], columns: Sequence[str], label: str, kind: str, folder: str, options: dict | None = None, spec="LR", fold: str = "patient", min_spec: float = 0.8) -> DataFrame:
    """From the feature table to fused out-of-fold decisions in one call: experts' scores from the fold cache, then the gate on each fold's
    training scores (see ``evaluate_moe``)."""
    scores = cached_folds(df, experts, label, folder, spec, fold)
    return evaluate_moe(df.withColumn("y", F.col(label)), tuple(experts), columns, kind, options, fold, min_spec, cache=scores)


# Gates over precomputed scores. Columns: patient, win_idx, y, p_<expert>, e_<expert>, and the gate's own.


def threshold(p: np.ndarray, y: np.ndarray, min_spec: float = 0.8) -> float:
    """The first ROC point from above with the largest sensitivity at enough specificity; +inf if that is none."""
    order = np.argsort(-p, kind="stable")
    ps, ys = p[order], y[order]
    last = np.append(ps[1:] != ps[:-1], True)
    tpr, spec = np.cumsum(ys)[last] / max(ys.sum(), 1), 1 - np.cumsum(1 - ys)[last] / max((1 - ys).sum(), 1)
    ok = (spec >= min_spec) & (tpr > 0)
    return float(ps[last][ok][tpr[ok].argmax()]) if ok.any() else float("inf")


def gate_weights(tr: pd.DataFrame, te: pd.DataFrame, experts: Sequence[str], columns: Sequence[str], kind: str, options: dict) -> tuple[np.ndarray, np.ndarray]:
    """(training weights, test weights) of a gate. Scales, sentinels and medians come from training rows only."""
    cols, p, e = list(columns), [f"p_{m}" for m in experts], [f"e_{m}" for m in experts]
    xa, xb = (t[cols].to_numpy(float) for t in (tr, te))
    pa, ya = tr[p].to_numpy(float), tr["y"].to_numpy(float)
    if kind == "equal":
        return tuple(np.full((len(t), len(p)), 1 / len(p)) for t in (tr, te))
    if kind in ("net", "reliability"):
        g = (G.GatingNet if kind == "net" else G.reliability_gate)(**options).fit(xa, pa, ya)
        return g.weights(xa), g.weights(xb)
    if kind in ("class_lr", "class_gb"):
        g = G.ClassGate(kind.removeprefix("class_")).fit(xa, tr[e].to_numpy(float))
        return g.weights(xa), g.weights(xb)
    if kind in ("unsup_pca", "unsup_gmm"):
        g = G.UnsupervisedGate(options["groups"], options["anchors"], options.get("scope", "own"), kind.removeprefix("unsup_")).fit(xa)
        return g.weights(xa), g.weights(xb)
    g = G.ErrorGate(kind, **{k: v for k, v in options.items() if k not in ("map", "trust", "freeze", "e0", "tau")}).fit(xa, tr[e].to_numpy(float))
    ea, eb = g.predict(xa), g.predict(xb)
    if options.get("map") == "decay":
        e0, tau = options.get("e0", 0.15), options.get("tau", 0.25)
        wa, wb = G.decay_weights(ea, e0, tau), G.decay_weights(eb, e0, tau)
    else:
        scale = float(np.nanmedian(ea))
        wa, wb = G.softmax_weights(ea, scale), G.softmax_weights(eb, scale)
    if options.get("trust"):
        t = trust_of(tr, experts, cols, kind)
        wa, wb = G.blended(wa, t), G.blended(wb, t)
    if options.get("freeze"):
        mean = wa.mean(axis=0)
        wa, wb = np.tile(mean, (len(wa), 1)), np.tile(mean, (len(wb), 1))
    return wa, wb


def trust_of(tr: pd.DataFrame, experts: Sequence[str], columns: Sequence[str], kind: str, k: int = 3) -> np.ndarray:
    """Per expert the clipped out-of-fold R2 of its error prediction on training rows; ones without two folds."""
    n = min(k, tr["patient"].nunique())
    if n < 2:
        return np.ones(len(experts))
    part = group_folds(tr["patient"].to_numpy(), tr["y"].to_numpy(), n)
    err = tr[[f"e_{m}" for m in experts]].to_numpy(float)
    x = tr[list(columns)].to_numpy(float)
    oof, base = np.full(err.shape, np.nan), np.full(err.shape, np.nan)
    for f in range(n):
        a = part != f
        oof[~a] = G.ErrorGate(kind).fit(x[a], err[a]).predict(x[~a])
        base[~a] = np.nanmean(err[a], axis=0)
    ok = np.isfinite(err)
    out = []
    for j in range(err.shape[1]):
        r = ok[:, j]
        total = ((err[r, j] - base[r, j]) ** 2).sum()
        out.append(np.clip(1 - ((err[r, j] - oof[r, j]) ** 2).sum() / total, 0, 1) if total > 0 else 0.0)
    return np.array(out)


def stacker(tr: pd.DataFrame, te: pd.DataFrame, experts: Sequence[str], columns: Sequence[str], kind: str, discordance: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A meta-classifier (lr or gb) over calibrated scores, their statistics, and optional gate columns."""
    p = [f"p_{m}" for m in experts]
    y = tr["y"].to_numpy(float)
    maps = [Isotonic().fit(tr[c].to_numpy(float), y) for c in p]

    def meta(t: pd.DataFrame) -> np.ndarray:
        q = np.stack([m.predict(t[c].to_numpy(float)) for m, c in zip(maps, p, strict=True)], axis=1)
        pairs = [np.abs(q[:, i] - q[:, j]) for i in range(q.shape[1]) for j in range(i + 1, q.shape[1])]
        parts = [q, q.mean(axis=1), q.std(axis=1), q.max(axis=1), q.min(axis=1), *pairs, t[list(columns)].to_numpy(float)]
        if discordance:
            parts += [np.abs(q[:, i] - middle(np.delete(q, i, axis=1))) for i in range(q.shape[1])]
        return np.column_stack(parts)

    x = meta(tr)
    m = (Logistic() if kind == "lr" else Boosted()).fit(x, y)
    return m.predict(x), m.predict(meta(te))


def middle(q: np.ndarray) -> np.ndarray:
    """Median of each row; of two columns their mean, without a sort of each row."""
    return q.mean(axis=1) if q.shape[1] == 2 else np.median(q, axis=1)


def evaluate_moe(table: DataFrame, experts: Sequence[str], columns: Sequence[str], kind: str, options: dict | None = None, fold: str = "patient", min_spec: float = 0.8, cache: DataFrame | None = None, cuts: bool = True) -> DataFrame:
    """(patient, win_idx, y, p, call, threshold, w_<expert>): leave-one-group-out fusion.

    ``table`` has scores p_*, errors e_* and gate columns; with a ``cache`` from ``precompute_folds`` each fold takes its own training scores
    from it. Kinds: equal, mlp, deep, gb, xgb, ridge, net, reliability, class_lr, class_gb, unsup_pca, unsup_gmm, stack_lr, stack_gb, errpred. The
    threshold comes from the fused training scores; without ``cuts`` it may be left out."""
    options = options or {}
    p = [f"p_{m}" for m in experts]

    def run(tr: pd.DataFrame, te: pd.DataFrame) -> pd.DataFrame:
        y = tr["y"].to_numpy(float)
        w = np.full((len(te), len(p)), np.nan)
        if len(np.unique(y)) < 2:
            fa, fb = np.full(len(tr), y.mean()), np.full(len(te), y.mean())
        elif kind.startswith("stack_"):
            fa, fb = stacker(tr, te, experts, columns, kind.removeprefix("stack_"), options.get("discordance", False))
        elif kind == "errpred":
            x = list(columns)
            g = G.ErrorPrediction(**options).fit(tr[x].to_numpy(float), tr[p].to_numpy(float), y)
            fa, fb = (g.predict(t[x].to_numpy(float), t[p].to_numpy(float)) for t in (tr, te))
            w = g.weights(te[x].to_numpy(float))
        else:
            wa, w = gate_weights(tr, te, experts, columns, kind, options)
            fa, fb = (wa * tr[p].to_numpy(float)).sum(axis=1), (w * te[p].to_numpy(float)).sum(axis=1)
        cut = threshold(fa, y, min_spec)
        out = {"patient": te["patient"], "win_idx": te["win_idx"], "y": te["y"], "p": fb, "call": fb >= cut, "threshold": cut if np.isfinite(cut) else None}
        return pd.DataFrame(out | {f"w_{m}": w[:, i] for i, m in enumerate(experts)})

    kinds = dict(table.dtypes)
    schema = f"patient {kinds['patient']}, win_idx {kinds['win_idx']}, y {kinds['y']}, p double, call boolean, threshold double, " + ", ".join(f"w_{m} double" for m in experts)
    if cache is None and kind in ("net", "reliability") and len(table.select(fold).where(F.col(fold).isNotNull()).distinct().limit(sums.FEW + 1).collect()) <= sums.FEW:
        made = nets.evaluate_nets(table, experts, columns, (G.GatingNet if kind == "net" else G.reliability_gate)(**options), fold, min_spec, schema)
        if made is not None:
            return made
    if cache is None and nearby.gate_kind(kind, options):
        made = nearby.evaluate(table, experts, columns, kind, options, fold, min_spec, schema, cuts)
        if made is not None:
            return made
    if cache is None:
        return by_fold(table.select(*dict.fromkeys(["patient", "win_idx", "y", fold, *p, *[f"e_{m}" for m in experts], *columns])), fold, run, schema, "y")
    rest = table.select("patient", "win_idx", *dict.fromkeys([*[f"e_{m}" for m in experts], *columns]))
    joined = cache.join(rest, ["patient", "win_idx"], "left")

    def task(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["patient", "win_idx"]).reset_index(drop=True)
        return run(pdf[pdf["split"] == "train"], pdf[pdf["split"] == "test"])

    return joined.groupBy("fold").applyInPandas(task, schema)


def compare(table: DataFrame, experts: Sequence[str], columns: Sequence[str], variants: dict[str, tuple[str, dict]], fold: str = "patient") -> DataFrame:
    """(variant, auc, n_pos, n_neg, threshold, tn, fp, fn, tp, rates) of several gates over one table; threshold is the mean of the patients' own."""
    from pulsegrid.operators.metrics import auc, confusion

    out = None
    for name, (kind, options) in variants.items():
        got = evaluate_moe(table, experts, columns, kind, options, fold).select("patient", "y", "p", "call", "threshold").localCheckpoint()  # fitted once for all figures
        cut = got.groupBy("patient").agg(F.min("threshold").alias("threshold")).agg(F.avg("threshold").alias("threshold"))
        counts = confusion(got, F.col("call"), "y")
        one = auc(got, "p", "y").select(F.lit(name).alias("variant"), "auc", "n_pos", "n_neg").crossJoin(F.broadcast(cut)).crossJoin(F.broadcast(counts))  # one row each
        out = one if out is None else out.unionByName(one)
    return out


def nested_rows(df: DataFrame, columns: Sequence[str], label: str, modes: Sequence[str], spec="LR", min_spec: float = 0.8, inner: int = 3, weight: str | None = None, min_weight: float = 0.0, fold: str = "patient") -> DataFrame:
    """(patient, win_idx, y, p, threshold, whole): what all ``modes`` of ``nested_evaluation`` need, each fold fitted once for all of them. Windows (whole false) and
    patients (whole true, win_idx -1) come with their threshold from inner folds, null if that is infinite or no mode asks for it."""
    cols = list(columns)
    score = fit_predict(spec, cols, label)
    windows, patients = any(m.startswith("window") for m in modes), any(m.startswith("patient") for m in modes)

    def mean_of(t: pd.DataFrame, p: np.ndarray) -> pd.DataFrame:
        w = np.ones(len(t)) if weight is None else np.where(t[weight].to_numpy(float) >= min_weight, np.nan_to_num(t[weight].to_numpy(float)), 0)
        g = pd.DataFrame({"patient": t["patient"].to_numpy(), "y": t[label].to_numpy(), "p": p, "w": w, "wp": w * p}).groupby("patient").agg(y=("y", "max"), p=("p", "mean"), w=("w", "sum"), wp=("wp", "sum"))
        return g.assign(p=np.where(g["w"] > 0, g["wp"] / g["w"].where(g["w"] > 0, 1), g["p"]))

    def run(tr: pd.DataFrame, te: pd.DataFrame) -> pd.DataFrame:
        p, cut = score(tr, te), {}
        if any(m.endswith("nested") for m in modes):
            part = group_folds(tr["patient"].to_numpy(), tr[label].to_numpy(), max(2, min(inner, tr["patient"].nunique())))
            oof = np.full(len(tr), np.nan)
            for k in np.unique(part):
                oof[part == k] = score(tr[part != k], tr[part == k])
            if "patient_nested" in modes:
                g = mean_of(tr, oof)
                cut[True] = threshold(g["p"].to_numpy(), g["y"].to_numpy(float), min_spec)
            if "window_nested" in modes:
                cut[False] = threshold(oof, tr[label].to_numpy(float), min_spec)
        out = []
        if windows:
            out.append(pd.DataFrame({"patient": te["patient"], "win_idx": te["win_idx"], "y": te[label], "p": p, "whole": False}))
        if patients:
            g = mean_of(te, p)
            out.append(pd.DataFrame({"patient": g.index, "win_idx": -1, "y": g["y"].to_numpy(), "p": g["p"].to_numpy(), "whole": True}))
        return pd.concat([t.assign(threshold=cut.get(w, np.inf)).replace({"threshold": {np.inf: np.nan}}) for t, w in zip(out, [*[False] * windows, *[True] * patients], strict=True)])

    kinds = dict(df.dtypes)
    need = dict.fromkeys(["patient", "win_idx", label, fold, *cols, *([weight] if weight else [])])
    return by_fold(df.select(*need), fold, run, f"patient {kinds['patient']}, win_idx long, y {kinds[label]}, p double, threshold double, whole boolean", label)


def called(rows: DataFrame, mode: str, min_spec: float = 0.8) -> DataFrame:
    """One mode of ``nested_rows``: (patient, win_idx, y, p, threshold, call)."""
    out = rows.where(F.col("whole") == mode.startswith("patient")).drop("whole")
    if mode == "window":
        out = out.withColumn("threshold", F.lit(0.5))
    if mode == "patient_pooled":
        from pulsegrid.operators.metrics import choose_threshold

        cut = choose_threshold(out, "p", "y", min_spec).select(F.col("threshold").alias("_cut"))
        out = out.crossJoin(F.broadcast(cut)).withColumn("threshold", F.col("_cut")).drop("_cut")  # one row
    return out.withColumn("call", F.coalesce(F.col("p") >= F.col("threshold"), F.lit(False)))


def nested_evaluation(df: DataFrame, columns: Sequence[str], label: str, spec="LR", mode: str = "window", min_spec: float = 0.8, inner: int = 3, weight: str | None = None, min_weight: float = 0.0, fold: str = "patient") -> DataFrame:
    """(patient, win_idx, y, p, threshold, call).

    mode window: fixed 0.5; window_nested: threshold from inner grouped folds of the training windows; patient_pooled and
    patient_nested: one row for each patient (win_idx -1), its (weighted) mean score, the threshold from all patients' out-of-fold means or
    from inner folds of the training patients."""
    return called(nested_rows(df, columns, label, [mode], spec, min_spec, inner, weight, min_weight, fold), mode, min_spec)


def logistic_search(df: DataFrame, columns: Sequence[str], label: str, specs: Sequence, k: int) -> DataFrame:
    """As ``tune`` for plain logistic learners: folds are few, so a step of all trials and folds is one pass, and no task holds the table."""
    x = dealt_out(df.select(*dict.fromkeys(["patient", label, *columns])).where(F.col(label).isNotNull()), label, k)
    areas = searches.logistic_areas(x, columns, label, [logistic_strength(s) for s in specs])
    return df.sparkSession.createDataFrame([(t, a, repr(s)) for t, (a, s) in enumerate(zip(areas, specs, strict=True))], "trial int, auc double, spec string")


def tune(df: DataFrame, columns: Sequence[str], label: str, space: Callable[[np.random.Generator], tuple], trials: int = 12, k: int = 5, seed: int = 0) -> DataFrame:
    """(trial, auc, spec): seeded random search on pooled out-of-fold AUC over grouped folds. Plain logistic learners of all trials are fitted by the same passes
    over the rows, and rows without a label take no part; for other learners a task holds the table for one trial."""
    rng = np.random.default_rng(seed)
    specs = [space(rng) for _ in range(trials)]
    cols = list(columns)
    if all(logistic_strength(s) is not None for s in specs):
        return logistic_search(df, cols, label, specs, k)
    x = df.select(*dict.fromkeys(["patient", "win_idx", label, *cols])).withColumn("_trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["_trial"].iloc[0])
        pdf = pdf.sort_values(["patient", "win_idx"])
        part = group_folds(pdf["patient"].to_numpy(), pdf[label].to_numpy(), k)
        p = np.full(len(pdf), np.nan)
        for f in range(k):
            if (part == f).any() and (part != f).any():
                p[part == f] = fit_predict(specs[t], cols, label)(pdf[part != f], pdf[part == f])
        ok = np.isfinite(p)
        return pd.DataFrame({"trial": [t], "auc": [rank_auc(p[ok], pdf[label].to_numpy()[ok])], "spec": [repr(specs[t])]})

    return x.groupBy("_trial").applyInPandas(run, "trial int, auc double, spec string")

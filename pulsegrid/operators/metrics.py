"""Rank metrics, thresholds, confusion counts, resampling and selective-prediction reports.

Global ranks never sort in one partition: values fall into bins between approximate quantiles, so that no bin is much larger than
another whatever the values are, the few bin totals are summed up once, and rows are ordered inside their bin.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 256


def zero_null(x: Column) -> Column:
    return F.nullif(x, F.lit(0.0))


def joined(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner", equal: Sequence[str] = ()) -> DataFrame:
    """``a`` with ``b``'s other columns, joined on ``keys``, of which null is a value like any other, and on the columns ``equal``, of which it isn't."""
    on, renamed = F.lit(True), {k: f"_b_{k}" for k in (*keys, *equal)}
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(renamed[k]))
    for k in equal:
        on = on & (F.col(k) == F.col(renamed[k]))
    return a.join(b.withColumnsRenamed(renamed), on, how).drop(*renamed.values())


def with_bins(df: DataFrame, keys: Sequence[str], order: str, bins: int = BINS) -> DataFrame:
    """``df`` with _bin: how many of ``bins`` - 1 approximate quantiles of ``order`` (of each key) lie under the row's value. Only the balance of
    the bins depends on how good these are. A row looks at the coarse ones first."""
    step = max(2, round(bins**0.5))
    cut = df.groupBy(*keys).agg(F.percentile_approx(order, [i / bins for i in range(1, bins)], 1000).alias("_cuts"))
    cut = cut.withColumn("_coarse", F.filter("_cuts", lambda _, i: i % step == step - 1))
    x = joined(df, cut, keys) if keys else df.crossJoin(F.broadcast(cut))  # one row
    x = x.withColumn("_at", F.size(F.filter("_coarse", lambda c: c < F.col(order))) * step)
    fine = F.size(F.filter(F.slice("_cuts", F.col("_at") + 1, F.lit(step)), lambda c: c < F.col(order)))
    return x.withColumn("_bin", F.col("_at") + fine).drop("_cuts", "_coarse", "_at")


def running(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str], descending: bool = False, bins: int = BINS) -> DataFrame:
    """``df`` (one row for each key and value of ``order``) with <c>_before: the sum of c over the rows before, inside the key.

    Bin totals are summed over at most ``bins`` rows of a key; a window then covers one bin of one key."""
    direct = (lambda c: F.col(c).desc()) if descending else F.col
    x = with_bins(df, keys, order, bins)
    per = x.groupBy(*keys, "_bin").agg(*[F.sum(c).alias(c) for c in columns])
    before = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    before = before.orderBy(direct("_bin")).rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*keys, "_bin", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{c}") for c in columns])
    inside = Window.partitionBy(*keys, "_bin").orderBy(direct(order)).rowsBetween(Window.unboundedPreceding, -1)
    x = joined(x, per, keys, equal=["_bin"])
    return x.withColumns({f"{c}_before": F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"_{c}") for c in columns}).drop("_bin", *[f"_{c}" for c in columns])


def by_score(df: DataFrame, score: str, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, score, pos, neg): one row for each distinct score, combined before the shuffle. Missing scores and labels are left out."""
    x = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    return x.groupBy(*keys, F.col(score).alias("score")).agg(F.sum((F.col(label) == 1).cast("long")).alias("pos"), F.sum((F.col(label) != 1).cast("long")).alias("neg"))


def auc(df: DataFrame, score: str, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, auc, n_pos, n_neg): rank AUC with ties counted half; null with one class."""
    r = running(by_score(df, score, label, keys), keys, "score", ["neg"])
    a = r.groupBy(*keys).agg(F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2)).alias("u"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return a.select(*keys, (F.col("u") / zero_null(F.col("n_pos").cast("double") * F.col("n_neg"))).alias("auc"), "n_pos", "n_neg")


def roc(df: DataFrame, score: str, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, threshold, tp, fp, n_pos, n_neg): one point for each distinct score, calling positive from the threshold up."""
    r = running(by_score(df, score, label, keys), keys, "score", ["pos", "neg"], descending=True)
    total = r.groupBy(*keys).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    r = r.select(*keys, F.col("score").alias("threshold"), (F.col("pos_before") + F.col("pos")).alias("tp"), (F.col("neg_before") + F.col("neg")).alias("fp"))
    return joined(r, total, keys) if keys else r.crossJoin(F.broadcast(total))  # total is one row


def choose_threshold(df: DataFrame, score: str, label: str, min_spec: float = 0.8, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, threshold, tpr, spec): of the points with enough specificity the first with the largest sensitivity.

    "First" goes down from the highest threshold, before which lies the point that predicts none; if that point wins the
    threshold is null and tpr 0."""
    p = roc(df, score, label, keys)
    tpr, spec = F.col("tp") / zero_null(F.col("n_pos").cast("double")), 1 - F.col("fp") / zero_null(F.col("n_neg").cast("double"))
    p = p.select(*keys, "threshold", tpr.alias("tpr"), spec.alias("spec"))
    ok = (F.col("spec") >= min_spec) & (F.col("tpr") > 0)
    best = F.max_by(F.when(ok, F.struct("threshold", "tpr", "spec")), F.when(ok, F.struct("tpr", "threshold")))
    a = p.groupBy(*keys).agg(best.alias("b"))
    return a.select(*keys, F.col("b.threshold").alias("threshold"), F.coalesce("b.tpr", F.lit(0.0)).alias("tpr"), F.coalesce("b.spec", F.lit(1.0)).alias("spec"))


def confusion(df: DataFrame, call: Column, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """tn fp fn tp and the rates of both conventions: acc, sens, spec (0 where empty), ppv, npv, f1 (null where empty)."""
    y = F.col(label) == 1
    a = df.where(F.col(label).isNotNull()).groupBy(*keys).agg(F.count_if(~y & ~call).alias("tn"), F.count_if(~y & call).alias("fp"), F.count_if(y & ~call).alias("fn"), F.count_if(y & call).alias("tp"))
    d = {k: F.col(k).cast("double") for k in ("tn", "fp", "fn", "tp")}
    return a.withColumns(
        {
            "acc": (d["tp"] + d["tn"]) / zero_null(d["tp"] + d["tn"] + d["fp"] + d["fn"]),
            "sens": F.coalesce(d["tp"] / zero_null(d["tp"] + d["fn"]), F.lit(0.0)),
            "spec": F.coalesce(d["tn"] / zero_null(d["tn"] + d["fp"]), F.lit(0.0)),
            "ppv": d["tp"] / zero_null(d["tp"] + d["fp"]),
            "npv": d["tn"] / zero_null(d["tn"] + d["fn"]),
            "f1": 2 * d["tp"] / zero_null(2 * d["tp"] + d["fp"] + d["fn"]),
        }
    )


def patient_scores(df: DataFrame, score: str, label: str, weight: str | None = None, min_weight: float = 0.0, key: str = "patient") -> DataFrame:
    """(key, y, p): weighted mean of a patient's scores; weights under the minimum count 0; without weight left the plain mean."""
    mean = F.avg(score)
    if weight:
        w = F.when(F.col(weight) >= min_weight, F.col(weight)).otherwise(F.lit(0.0))
        mean = F.coalesce(F.sum(w * F.col(score)) / zero_null(F.sum(w)), F.avg(score))
    return df.groupBy(key).agg(F.max(label).alias("y"), mean.alias("p"))


def quantiles(df: DataFrame, column: str, qs: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, q, value): exact linear quantiles of a whole table, or of each key, without one large sort: distinct values get their range of
    ranks by ``running``; each quantile reads the one or two values at its ranks."""
    d = df.where(F.col(column).isNotNull()).groupBy(*keys, F.col(column).alias("v")).agg(F.count("*").alias("n"))
    total = d.groupBy(*keys).agg(F.sum("n").alias("total"))
    r = running(d, keys, "v", ["n"])
    r = joined(r, total, keys) if keys else r.crossJoin(F.broadcast(total))  # one row
    at = r.select(*keys, "v", "n_before", "n", "total", F.explode(F.array(*[F.lit(float(q)) for q in qs])).alias("q")).withColumn("at", F.col("q") * (F.col("total") - 1))
    lo, hi = F.floor("at"), F.ceil("at")
    inside = lambda k: (k >= F.col("n_before")) & (k < F.col("n_before") + F.col("n"))
    picked = at.where(inside(lo) | inside(hi)).groupBy(*keys, "q").agg(F.max(F.when(inside(lo), F.col("v"))).alias("a"), F.max(F.when(inside(hi), F.col("v"))).alias("b"), F.first(F.col("at") - lo).alias("w"))
    return picked.select(*keys, "q", (F.col("a") + (F.col("b") - F.col("a")) * F.col("w")).alias("value"))


def cuts(df: DataFrame, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """One row with a column for each name: the exact quantile of (column, q). To be joined to rows as a broadcast."""
    out = None
    for name, (column, q) in wanted.items():
        one = quantiles(df, column, [q]).select(F.col("value").alias(name))
        out = one if out is None else out.crossJoin(F.broadcast(one))
    return out


def midranks(df: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """``df`` with rk_<c>: midranks inside the keys, null for a missing value. Distinct values are ranked by ``running`` and joined back, so one key may hold the whole table."""
    for c in columns:
        d = df.where(F.col(c).isNotNull()).groupBy(*keys, c).agg(F.count("*").alias("_n"))
        r = running(d, keys, c, ["_n"]).select(*keys, c, (F.col("_n_before") + (F.col("_n") + 1) / 2.0).alias(f"rk_{c}"))
        df = joined(df, r, keys, "left", [c])
    return df


def spearman(df: DataFrame, x: str, y: str, keys: Sequence[str], least: int = 2) -> DataFrame:
    """(keys, n, rho) over rows that have both values; 0 without spread, left out under ``least`` rows."""
    from pulsegrid.functions.native import safe_corr

    r = midranks(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()), [x, y], keys)
    return r.groupBy(*keys).agg(F.count("*").alias("n"), safe_corr(f"rk_{x}", f"rk_{y}").alias("rho")).where(F.col("n") >= least)


def risk_coverage(df: DataFrame, keep: str, score: str, label: str, coverages: Sequence[float], bad: Column) -> DataFrame:
    """(coverage, cut, n, bad_kept, auc): rows whose ``keep`` reaches the (1 - coverage) quantile. The cut list is short and broadcast."""
    cuts = quantiles(df, keep, [1 - c for c in coverages]).select((1 - F.col("q")).alias("coverage"), F.col("value").alias("cut"))
    x = df.withColumn("_bad", bad).join(F.broadcast(cuts), F.col(keep) >= F.col("cut"))
    n = x.groupBy("coverage", "cut").agg(F.count("*").alias("n"), F.count_if("_bad").alias("bad_kept"))
    return n.join(auc(x, score, label, ["coverage"]).select("coverage", "auc"), "coverage")


def numbered(units: DataFrame, key: str, seed: int = 0, bins: int = BINS) -> DataFrame:
    """``units`` with _u, numbers from 0 without a gap in the order of a hash: places inside a hash bin, after the totals of the bins before."""
    x = units.withColumn("_h", F.xxhash64(key, F.lit(seed))).withColumn("_bin", F.pmod("_h", F.lit(bins)))
    per = x.groupBy("_bin").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)  # over ``bins`` rows
    per = per.select("_bin", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_skip"))
    place = F.row_number().over(Window.partitionBy("_bin").orderBy("_h", key)) - 1
    return x.withColumn("_r", place).join(per, "_bin").withColumn("_u", F.col("_r") + F.col("_skip")).drop("_h", "_bin", "_r", "_skip")


#: Picks of a block of draws (128 at most) that a task holds at once, and rows that meet them at a time.
PICKED, ROWS = 1 << 24, 1024


def xxhash(columns: Sequence[np.ndarray | int], seed: int) -> np.ndarray:
    """Spark's ``xxhash64`` of long columns and then the int ``seed``."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

    def turned(x: np.ndarray, by: int) -> np.ndarray:
        return (x << np.uint64(by)) | (x >> np.uint64(64 - by))

    def mixed(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(33))) * p2
        x = (x ^ (x >> np.uint64(29))) * p3
        return x ^ (x >> np.uint64(32))

    with np.errstate(over="ignore"):
        h = np.full(1, 42, np.uint64)
        for c in columns:
            h = mixed(turned((h + p5 + np.uint64(8)) ^ (turned(np.atleast_1d(c).astype(np.uint64) * p2, 31) * p1), 27) * p1 + p4)
        return mixed(turned((h + p5 + np.uint64(4)) ^ (np.array([seed & 0xFFFFFFFF], np.uint64) * p1), 23) * p2 + p3)


def picked(draw: int, n: int, seed: int) -> np.ndarray:
    """How often each of ``n`` units is picked in a draw: n uniform picks, from hashes of (draw, pick)."""
    at = np.concatenate([xxhash([draw, np.arange(i, min(i + (1 << 16), n))], seed).view(np.int64) % n for i in range(0, n, 1 << 16)])
    return np.bincount(at, minlength=n)


def drawn_pairs(counts: DataFrame, draws: int, n: int, seed: int, once: bool) -> DataFrame:
    """(_bin, draw, u, pos, neg): of the rows ``counts`` (score, _u, pos, neg) of a bin of scores, weighed as each draw picks their units, the pairs of a positive above a
    negative (ties half) and the totals.

    A task reads its bin in the order of scores and adds it to a block of draws at a time, whose picks it counts off the hashes itself: a row is sent once, and rows x
    draws are sums of small numbers in place."""

    def task(table: pa.Table) -> pa.Table:
        order = np.argsort(table["score"].to_numpy(), kind="stable")
        at, units, pos, neg = (table[c].to_numpy()[order] for c in ("score", "_u", "pos", "neg"))
        ends = np.append(np.flatnonzero(at[1:] != at[:-1]) + 1, len(at))
        blocks, i = [], 0  # of whole runs of equal scores: their first and last row; a long run is cut, its pieces know of the run
        while i < len(at):
            j = int(ends[np.searchsorted(ends, i, "right")])
            k = int(ends[max(np.searchsorted(ends, i + ROWS, "right") - 1, 0)])
            blocks.append((i, max(j, k)))
            i = max(j, k)
        out = np.zeros((draws, 3))
        wide = min(128, max(1, PICKED // max(n, 1)))
        for first in range(0, draws, wide):
            own = slice(first, min(first + wide, draws))
            times = np.stack([picked(d, n, seed) for d in range(draws)[own]], axis=1).astype(np.int32)
            times = np.minimum(times, 1) if once else times
            u, p_all, below = np.zeros(times.shape[1]), np.zeros(times.shape[1]), np.zeros(times.shape[1])
            for i, j in blocks:
                if j - i > ROWS:  # one score
                    p, q = (sum((times[units[a : a + ROWS]] * c[a : a + ROWS, None])[: j - a].sum(axis=0) for a in range(i, j, ROWS)).astype(float) for c in (pos, neg))
                    u += p * (below + q / 2)
                    p_all += p
                    below += q
                    continue
                w = times[units[i:j]].astype(float)
                c = np.zeros((j - i + 1, len(u)))  # negatives before each row
                np.cumsum(w * neg[i:j, None], axis=0, out=c[1:])
                has = np.flatnonzero(pos[i:j])
                tops = ends[np.searchsorted(ends, has + i, "right")] - i
                heads = np.append(0, ends)[np.searchsorted(ends, has + i, "right")] - i
                p = w[has] * pos[i:j][has, None]
                total = p.sum(axis=0)
                u += np.einsum("ij,ij->j", p, c[heads] + c[tops]) / 2 + total * below
                p_all += total
                below += c[-1]
            out[own] = np.stack([u, p_all, below], axis=1)
        bin_ = np.full(draws, table["_bin"][0].as_py())
        return pa.table({"_bin": pa.array(bin_, pa.int32()), "draw": pa.array(np.arange(draws)), "u": out[:, 0], "pos": out[:, 1], "neg": out[:, 2]})

    # As many bins as tasks run at a time, or of a million rows.
    bins = max(2, counts.sparkSession.sparkContext.defaultParallelism, -(-counts.count() // 1_000_000))
    x = with_bins(counts, [], "score", bins)
    return x.withColumn("_bin", F.col("_bin").cast("int")).groupBy("_bin").applyInArrow(task, "_bin int, draw long, u double, pos double, neg double")


def bootstrap(df: DataFrame, score: str, label: str, cluster: str | None, draws: int = 2000, seed: int = 0, alpha: float = 0.05, legacy_subset: bool = False) -> DataFrame:
    """(auc, low, high, draws_used): percentile interval of the AUC.

    With a cluster, clusters are drawn with multiplicity, as often as there are; a draw's weight of a cluster is how many of its n uniform
    picks fall on it, taken from hashes. Without, rows are. Draws with one class are skipped. ``legacy_subset`` loses the
    multiplicity. No row is multiplied by draws: see ``drawn_pairs``."""
    key = cluster or "_row"
    base = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    if not cluster:
        # Rows alike in score and label are alike to the draw: they are told apart by their number only.
        w = Window.partitionBy(score, label).orderBy(F.lit(1))
        base = base.withColumn("_k", F.row_number().over(w)).withColumn("_row", F.concat_ws("/", score, label, "_k"))
    units = base.select(key).distinct()
    order = numbered(units, key, seed)
    n = units.count()
    counts = by_score(base, score, label, [key]).join(order, key).select("score", "_u", "pos", "neg")
    pairs = drawn_pairs(counts, draws, n, seed, legacy_subset)
    part = pairs.groupBy("draw", "_bin").agg(*[F.sum(c).alias(c) for c in ("u", "pos", "neg")])  # a row for each draw and bin
    below = Window.partitionBy("draw").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    part = part.withColumn("u", F.col("u") + F.col("pos") * F.coalesce(F.sum("neg").over(below), F.lit(0)))
    a = part.groupBy("draw").agg((F.sum("u") / zero_null(F.sum("pos").cast("double") * F.sum("neg"))).alias("a"))
    ci = a.agg(F.percentile("a", alpha / 2).alias("low"), F.percentile("a", 1 - alpha / 2).alias("high"), F.count("a").alias("draws_used"))  # one value a draw
    return auc(df, score, label).select("auc").crossJoin(ci)


def trapezoid(df: DataFrame, x: str, y: str, keys: Sequence[str]) -> DataFrame:
    """(keys, area) under the points of each key."""
    w = Window.partitionBy(*keys).orderBy(x)
    step = (F.lead(x).over(w) - F.col(x)) * (F.lead(y).over(w) + F.col(y)) / 2
    return df.withColumn("_a", step).groupBy(*keys).agg(F.sum("_a").alias("area"))

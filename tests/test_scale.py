"""Ranks, quantiles and folds on awkward distributions, and the pieces that must not depend on how work is dealt out."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import dsp
from pulsegrid.functions import window_features as W
from pulsegrid.learn import folds as L
from pulsegrid.operators import metrics as M
from pulsegrid.operators import tables as T
from tests.test_learn import EXPERTS, QUAL, table

RNG = np.random.default_rng(3)
SHAPES = {
    "outlier": np.append(RNG.normal(size=400), 1e12),
    "near one": 1 - RNG.random(400) * 1e-9,
    "ties": RNG.integers(0, 5, 400).astype(float),
    "negative": -np.exp(RNG.normal(size=400) * 6),
    "one": np.array([2.5]),
    "same": np.full(50, 0.25),
}


@pytest.mark.parametrize("name", SHAPES)
def test_ranks_and_quantiles_of_any_distribution(spark, name):
    v = SHAPES[name]
    y = (np.arange(len(v)) % 3 == 0).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"i": np.arange(len(v)), "v": v, "y": y})).repartition(4)
    got = {round(r["q"], 3): r["value"] for r in M.quantiles(df, "v", [0, 0.1, 0.5, 0.95, 1]).collect()}
    assert all(np.isclose(got[q], np.quantile(v, q), rtol=1e-12) for q in got) and len(got) == 5
    ranks = pd.Series(v).rank().to_numpy()
    rk = M.midranks(df.withColumn("k", F.lit(1)), ["v"], ["k"]).orderBy("i").toPandas()["rk_v"].to_numpy()
    assert np.array_equal(rk, ranks)
    if len(v) > 1:
        n1, n0 = y.sum(), (1 - y).sum()
        assert np.isclose(M.auc(df, "v", "y").first()["auc"], (ranks[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0))


def test_bins_are_balanced(spark):
    """Of a skewed distribution no bin holds much more than its share."""
    v = np.exp(RNG.normal(size=20_000) * 8)
    n = M.with_bins(spark.createDataFrame(pd.DataFrame({"v": v})), [], "v", 64).groupBy("_bin").count().toPandas()["count"]
    assert len(n) >= 60 and n.max() < 4 * 20_000 / 64


def test_quantiles_by_key(spark):
    t = pd.DataFrame({"k": list("aab") * 100, "v": [None if i % 17 == 0 else float(x) for i, x in enumerate(RNG.normal(size=300))]})
    df = spark.createDataFrame(list(t.astype(object).where(t.notna(), None).itertuples(index=False, name=None)), "k string, v double")
    got = {(r["k"], r["q"]): r["value"] for r in M.quantiles(df, "v", [0.25, 0.5], ["k"]).collect()}
    assert {k: round(v, 12) for k, v in got.items()} == {(k, q): round(g["v"].quantile(q), 12) for k, g in t.groupby("k") for q in (0.25, 0.5)}
    assert M.quantiles(spark.createDataFrame([], "k string, v double"), "v", [0.5], ["k"]).count() == 0


@pytest.mark.parametrize("workers", [1, 3, 256])
def test_folds_do_not_depend_on_the_dealing(spark, monkeypatch, workers):
    """Forty groups, each left out once, as plain loops do; rows without a fold learn and are not tested."""
    t = table(40, 5)
    t["fold"] = t["patient"].where(t["patient"] > 0).astype("Int64")
    monkeypatch.setattr(L, "WORKERS", workers)
    df = spark.createDataFrame(list(t.astype(object).where(t.notna(), None).itertuples(index=False, name=None)), "patient long, win_idx long, y long, " + ", ".join(f"p_{m} double, e_{m} double, q_{m} double, f_{m} double" for m in EXPERTS) + ", fold long")
    got = L.lopo_predictions(df.repartition(7), ["f_cecg", "f_ppg"], "y", "LR", "fold").toPandas().sort_values(["patient", "win_idx"])
    assert len(got) == 39 * 5 and not got.duplicated(["patient", "win_idx"]).any()
    score = L.fit_predict("LR", ["f_cecg", "f_ppg"], "y")
    want = np.concatenate([score(t[t["patient"] != p], t[t["patient"] == p]) for p in range(1, 40)])
    assert np.allclose(got["p"], want)


def test_fold_cache_is_made_once_and_checked(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame(table(6, 8))
    made = []
    plain = L.precompute_folds
    monkeypatch.setattr(L, "precompute_folds", lambda *a: made.append(a[0]) or plain(*a))
    columns = {m: [f"f_{m}"] for m in EXPERTS}
    one = L.run_moe(df, columns, QUAL, "y", "ridge", str(tmp_path)).toPandas()
    two = L.run_moe(df.orderBy(F.desc("win_idx")), columns, QUAL, "y", "ridge", str(tmp_path)).toPandas()
    keys = ["patient", "win_idx"]
    assert len(made) == 1 and one.sort_values(keys).reset_index(drop=True).equals(two.sort_values(keys).reset_index(drop=True)) and len(one) == 48
    L.run_moe(df, columns, QUAL, "y", "equal", str(tmp_path), spec=("LR", {"c": 0.1}))
    L.run_moe(df.withColumn("f_ppg", F.col("f_ppg") + 1), columns, QUAL, "y", "equal", str(tmp_path))
    assert len(made) == 3
    monkeypatch.setattr(L, "precompute_folds", lambda *a: plain(*a).where("win_idx > 0"))
    with pytest.raises(ValueError, match="other data"):
        L.cached_folds(df, columns, "y", str(tmp_path), inner=2)


def test_acf_width_in_lags_inside_the_band():
    fs, n = 64, 640
    x = np.sin(2 * np.pi * 1.25 * np.arange(n) / fs) + 0.2 * RNG.normal(size=n)
    got = W.acf_regularity(x, fs)
    r = dsp.autocorrelation(x)
    a, b = int(fs / 3.0), int(fs / 0.6)
    k = max(range(a, b), key=lambda i: (r[i], -i))
    left, right = k, k
    while left > a and r[left] > r[k] / 2:
        left -= 1
    while right < b and r[right] > r[k] / 2:
        right += 1
    assert got == {"acf_peak": r[k], "acf_bpm": 60 * fs / k, "acf_width": float(right - left)} and abs(got["acf_bpm"] - 75) < 2
    assert all(np.isnan(v) for v in W.acf_regularity(np.ones(n), fs).values()) and all(np.isnan(v) for v in W.acf_regularity(x[:50], fs).values())


def test_flat_but_for_rounding_has_no_papr():
    flat = np.full(64, 0.1) + np.array([1e-17, -1e-17] * 32)
    assert np.isnan(W.papr(flat, "spectrum")) and np.isnan(W.papr(np.zeros(64), "time")) and W.papr(np.eye(64)[0], "time") > 60


def test_valid_targets_and_coverage(spark):
    rows = [(1, True, 0.5), (1, False, 0.5), (1, None, 0.5), (2, True, None), (2, True, float("nan")), (2, True, float("inf")), (2, True, 1.0)]
    df = spark.createDataFrame(rows, "patient int, rel_ppg_valid boolean, e double")
    assert [r["e"] for r in T.with_valid_target(df, "ppg", "e").orderBy("e").collect()] == [0.5, 1.0]
    got = {r["patient"]: (r["coverage"], r["n"]) for r in T.validity_coverage(df, ["ppg"], ["patient"]).collect()}
    assert got == {1: (1 / 3, 3), 2: (1.0, 4)}


@pytest.mark.parametrize("bucket", [3, 4096])
@pytest.mark.parametrize("q", [0.0, 0.5, 0.95, 1.0])
def test_quantile_of_the_other_folds(spark, monkeypatch, q, bucket):
    """With ties, a fold of half the rows, a fold without a value, a missing fold, and values of one fold only."""
    monkeypatch.setattr(T, "BUCKET", bucket)
    rng = np.random.default_rng(5)
    n = 240
    t = pd.DataFrame({"f": np.where(rng.random(n) < 0.5, 0, rng.integers(1, 7, n)), "e": np.round(rng.normal(size=n), 1)})
    t.loc[t["f"] == 3, "e"] = np.nan
    rows = [(None if i < 5 else int(f), None if np.isnan(e) else float(e)) for i, (f, e) in enumerate(t.itertuples(index=False))]
    df = spark.createDataFrame(rows, "f int, e double").repartition(4)
    got = {r["f"]: r["value"] for r in T.others_quantile(df, "e", "f", q).collect()}
    want = {f: np.quantile([e for g, e in rows if e is not None and g != f], q) for f in range(7)}
    assert got.keys() == want.keys() and all(np.isclose(got[f], want[f]) for f in want)
    filled = T.with_sentinel(df, ["e"], "f", q).collect()
    assert len(filled) == n and all(r["e"] is not None for r in filled) and all(np.isclose(r["e"], want[3]) for r in filled if r["f"] == 3)
    lone = spark.createDataFrame([(1, 2.0), (1, None)], "f int, e double")
    assert [r["e"] for r in T.with_sentinel(lone, ["e"], "f", q).orderBy("e").collect()] == [1.0, 2.0]


def every_second(x, fs):
    return np.arange(0, len(x), 2 * int(fs))


def test_own_detector(spark):
    """A caller's function stands wherever a detector's name does."""
    from pulsegrid.functions import udfs
    from pulsegrid.functions.rr import rr_series
    from pulsegrid.operators import extract as E

    x = [float(v) for v in RNG.normal(size=1280)]
    got = spark.createDataFrame([(x,)], "x array<double>").select(udfs.peaks(every_second, 128)("x").alias("p"), udfs.rr_of(lambda v, fs: np.arange(0, len(v), int(fs)), 128)("x").alias("rr")).first()
    assert got["p"] == [0, 256, 512, 768, 1024] and got["rr"] == [1000.0] * 9
    assert rr_series(np.array(x), 128, lambda v, fs: [][1]) is None
    cfg = E.ExtractConfig(sources={"cecg": every_second, "ppg1": "prominence"})
    assert E.told(cfg)["sources"] == {"cecg": f"{__name__}.every_second", "ppg1": "prominence"}
    with pytest.raises(ValueError, match="unknown source"):
        E.ExtractConfig(sources={"cecg": "nope"}).checked()


def test_ranks_of_null_keys_and_null_values(spark):
    rows = [(g, None if i == 7 else float(i % 5), int(i % 3 == 0)) for g in ("a", None) for i in range(20)]
    df = spark.createDataFrame(rows, "g string, v double, y int")
    pdf = pd.DataFrame(rows[:20], columns=["g", "v", "y"]).dropna()
    auc = {r.g: r.auc for r in M.auc(df, "v", "y", ["g"]).collect()}
    rank = pdf["v"].rank()
    n1, n0 = (pdf["y"] == 1).sum(), (pdf["y"] != 1).sum()
    assert auc == {g: pytest.approx((rank[pdf["y"] == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)) for g in ("a", None)}
    assert {(r.g, r.q): r.value for r in M.quantiles(df, "v", [0.25, 0.9], ["g"]).collect()} == {(g, q): pytest.approx(pdf["v"].quantile(q)) for g in ("a", None) for q in (0.25, 0.9)}
    got = M.midranks(df, ["v"], ["g"]).collect()
    assert len(got) == 40 and sorted(r.rk_v for r in got if r.g is None and r.v is not None) == sorted(rank) and [r.rk_v for r in got if r.v is None] == [None, None]
    assert len(M.roc(df, "v", "y", ["g"]).where("g IS NULL").collect()) == 5 and M.choose_threshold(df, "v", "y", 0.5, ["g"]).count() == 2


@pytest.mark.parametrize("name", SHAPES)
def test_isotonic_regression_of_any_distribution(spark, name):
    from pulsegrid.learn.models import Isotonic
    from pulsegrid.operators import isotonic as I

    v = SHAPES[name]
    y = (RNG.random(len(v)) < 0.3 + 0.4 * (pd.Series(v).rank(pct=True).to_numpy())).astype(int)
    rows = [(i, k, float(a), int(b)) for k in ("a", None) for i, (a, b) in enumerate(zip(v, y, strict=True))]
    df = spark.createDataFrame([*rows, (-1, "a", None, 1), (-2, "a", float(v[0]), None), (-3, "b", 1.0, None)], "i int, k string, v double, y int").repartition(5)
    steps = I.isotonic(df, "v", "y", ["k"])
    want = Isotonic().fit(v, y.astype(float))
    got = {(r.k, r.i): r.p for r in I.calibrated(df, "v", steps, ["k"], "p").collect()}
    assert len(got) == len(rows) + 3 and got["a", -1] is None and got["b", -3] is None and got["a", -2] is not None
    fit = want.predict(v)
    assert all(np.isclose(got[k, i], fit[i], atol=1e-9) for k in ("a", None) for i in range(len(v)))
    values = [r.value for r in steps.where("k IS NULL").orderBy("low").collect()]
    assert all(a < b for a, b in zip(values, values[1:], strict=False))


def test_isotonic_regression_between_and_outside_the_stretches(spark):
    from pulsegrid.learn.models import Isotonic
    from pulsegrid.operators import isotonic as I

    v, y = np.array([1.0, 2, 3, 4, 5, 6]), np.array([0, 1, 0, 1, 0, 1])
    learn = spark.createDataFrame(list(zip(v.tolist(), y.tolist(), strict=True)), "v double, y int")
    ask = np.array([0.0, 1.0, 1.5, 2.5, 3.5, 5.9, 7.0, 7.0])
    got = sorted((r.v, r.calibrated) for r in I.calibrated(spark.createDataFrame([(float(a),) for a in ask], "v double"), "v", I.isotonic(learn, "v", "y")).collect())
    assert np.allclose([b for _, b in got], Isotonic().fit(v, y.astype(float)).predict(ask))
    apart = spark.createDataFrame([(1, 0.1, 0), (1, 0.9, 1), (2, 0.2, 1), (2, 0.8, 0), (None, 0.5, 1)], "f int, v double, y int")
    rows = {(r.f, r.v): r.calibrated for r in I.calibrated_apart(apart, "v", "y", "f").collect()}
    assert len(rows) == 5 and rows[None, 0.5] is None and rows[1, 0.1] == pytest.approx(2 / 3) and rows[2, 0.2] == pytest.approx(1 / 4)

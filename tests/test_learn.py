"""Learners, gates and fold machinery on seeded tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulsegrid.learn import folds as L
from pulsegrid.learn import gates as G
from pulsegrid.learn import models as M


def table(patients=12, windows=12, seed=0):
    """Scores, errors and qualities of three experts: an expert is right where its quality is high."""
    rng = np.random.default_rng(seed)
    n = patients * windows
    pat = np.repeat(np.arange(patients), windows)
    y = pat % 2
    q = rng.uniform(0, 1, (n, 3))
    p = np.clip(0.5 + (y - 0.5)[:, None] * (0.2 + 0.7 * q) + rng.normal(0, 0.25, (n, 3)) * (1.1 - q), 0.01, 0.99)
    e = 2 * (1 - q) + 0.1 * rng.random((n, 3))
    e[rng.random((n, 3)) < 0.05] = np.nan
    t = pd.DataFrame({"patient": pat, "win_idx": np.tile(np.arange(windows), patients), "y": y})
    for i, m in enumerate(("cecg", "ppg", "bcg")):
        t[f"p_{m}"], t[f"e_{m}"], t[f"q_{m}"] = p[:, i], e[:, i], q[:, i]
        t[f"f_{m}"] = (y - 0.5) * 1.5 + rng.normal(size=n)
    return t


EXPERTS, QUAL = ("cecg", "ppg", "bcg"), ("q_cecg", "q_ppg", "q_bcg")
TAB = table()
X, Y = TAB[["f_cecg", "f_ppg", "f_bcg"]].to_numpy(), TAB["y"].to_numpy(float)


@pytest.mark.parametrize("spec", ["LR", "SVM", "RF", "GB", "XGB", "LR+cal", ("LR", {"c": 0.1}), "GB+cal"])
def test_classifiers_learn(spec):
    holes = X.copy()
    holes[::9, 0] = np.nan
    p = M.make_classifier(spec).fit(holes, Y).predict(holes)
    assert M.rank_auc(p, Y) > 0.85 and ((p >= 0) & (p <= 1)).all()


def test_unknown_classifier_and_selection():
    with pytest.raises(ValueError):
        M.make_classifier("nope")
    noise = np.column_stack([X, np.random.default_rng(1).normal(size=(len(X), 5)) * 0])
    assert set(M.select_features(noise, Y, trees=30)) <= {0, 1, 2}


def test_isotonic_is_monotone_and_right():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=80), rng.normal(size=80)
    m = M.Isotonic().fit(x, y)
    f = m.predict(np.sort(x))
    assert (np.diff(f) >= -1e-12).all()
    ys = y[np.argsort(x)]
    c = np.concatenate([[0], np.cumsum(ys)])
    want = [max(min((c[j] - c[i]) / (j - i) for j in range(k + 1, 81)) for i in range(k + 1)) for k in range(80)]
    assert np.allclose(f, want)


def test_auc_ties_and_monotone_maps():
    rng = np.random.default_rng(3)
    p, y = rng.integers(0, 6, 60) / 5, rng.integers(0, 2, 60)
    want = np.mean([(a > b) + 0.5 * (a == b) for a in p[y == 1] for b in p[y == 0]])
    assert np.isclose(M.rank_auc(p, y), want) and np.isclose(M.rank_auc(np.exp(3 * p), y), want) and np.isnan(M.rank_auc(p, np.ones(60)))


def test_logistic_gradient_vanishes():
    m = M.Logistic(0.5).fit(X, Y)
    z = np.column_stack([m.prepare(X), np.ones(len(X))])
    g = z.T @ (M.balanced(Y) * (M.logistic(z @ m.w) - Y)) + np.append(m.w[:-1] / 0.5, 0)
    assert np.abs(g).max() < 1e-5


ERR, Q = TAB[[f"e_{m}" for m in EXPERTS]].to_numpy(), TAB[list(QUAL)].to_numpy()
P = TAB[[f"p_{m}" for m in EXPERTS]].to_numpy()


@pytest.mark.parametrize("kind", ["mlp", "deep", "gb", "xgb", "ridge"])
@pytest.mark.parametrize("target", ["standard", "log", "quantile", None])
def test_error_gates_predict(kind, target):
    pred = G.ErrorGate(kind, target).fit(Q, ERR).predict(Q)
    ok = np.isfinite(ERR[:, 0])
    assert np.corrcoef(pred[ok, 0], ERR[ok, 0])[0, 1] > 0.8


def test_weight_maps():
    w = G.softmax_weights(ERR)
    assert np.allclose(w.sum(axis=1), 1, atol=1e-6) and (w[np.isnan(ERR)] == 0).all()
    d = G.decay_weights(np.array([[np.nan] * 3, [0.1, 0.4, np.nan]]), 0.15, 0.25)
    assert np.allclose(d[0], 1 / 3) and np.allclose(d[1], [1 / (1 + np.exp(-1)), np.exp(-1) / (1 + np.exp(-1)), 0])
    assert np.allclose(G.blended(w, np.zeros(3)), 1 / 3) and np.allclose(G.quality_weights(Q).min(axis=1) >= 0.05, True)
    low = G.softmax_weights(np.array([[1.0, 2.0, 3.0]]), 1.0)[0]
    assert low[0] > low[1] > low[2]
    assert np.isclose(G.sentinel(np.array([[1.0], [np.nan]]))[0], 1) and G.sentinel(np.full((3, 1), np.nan))[0] == 1


def test_gating_networks_prefer_the_better_expert():
    for g in (G.GatingNet(), G.reliability_gate(), G.reliability_gate(hard=True, beta=0.01)):
        w = g.fit(Q, P, Y).weights(Q)
        assert np.allclose(w.sum(axis=1), 1) and M.rank_auc(g.predict(Q, P), Y) >= M.rank_auc(P.mean(axis=1), Y) - 0.01
    w = G.ClassGate().fit(Q, ERR).weights(Q)
    assert np.corrcoef(w[:, 0], Q[:, 0])[0, 1] > 0.5
    e = G.ErrorPrediction().fit(Q, P, Y)
    assert M.rank_auc(e.predict(Q, P), Y) > 0.8


@pytest.mark.parametrize("method", ["pca", "gmm"])
@pytest.mark.parametrize("scope", ["own", "shared"])
def test_unsupervised_gate_follows_its_anchor(method, scope):
    rng = np.random.default_rng(4)
    base = rng.uniform(0, 1, (300, 3))
    x = np.concatenate([base[:, [k]] * s + 0.1 * rng.normal(size=(300, 1)) for k in range(3) for s in (1, -1, 1)], axis=1)
    g = G.UnsupervisedGate([[0, 1, 2], [3, 4, 5], [6, 7, 8]], [0, 3, 6], scope, method).fit(x)
    q = g.quality(x)
    assert all(np.corrcoef(q[:, k], base[:, k])[0, 1] > 0.6 for k in range(3)) and np.allclose(g.weights(x).sum(axis=1), 1)


def test_group_folds_keep_groups_and_balance():
    f = L.group_folds(TAB["patient"].to_numpy(), TAB["y"].to_numpy())
    per = pd.DataFrame({"p": TAB["patient"], "f": f, "y": TAB["y"]})
    assert (per.groupby("p")["f"].nunique() == 1).all() and per["f"].nunique() == 5
    assert (L.group_folds(TAB["patient"].to_numpy(), TAB["y"].to_numpy()) == f).all()
    assert per.groupby("f").size().max() <= 3 * 12


def test_threshold_may_be_infinite():
    assert L.threshold(np.array([0.9, 0.1]), np.array([0, 1]), 0.8) == float("inf")
    assert L.threshold(np.array([0.9, 0.8, 0.1]), np.array([1, 1, 0]), 0.8) == 0.8


def test_lopo_and_cache(spark):
    df = spark.createDataFrame(TAB)
    cols = {m: [f"f_{m}"] for m in EXPERTS}
    oof = L.expert_oof(df, cols, "y").toPandas()
    assert len(oof) == len(TAB) and not oof.duplicated(["patient", "win_idx"]).any() and oof["p_cecg"].notna().all()
    one = oof.set_index(["patient", "win_idx"]).sort_index()["p_cecg"]
    tr, te = TAB[TAB["patient"] != 3], TAB[TAB["patient"] == 3]
    assert np.allclose(one[3].to_numpy(), L.fit_predict("LR", ["f_cecg"], "y")(tr, te))  # no row of the patient was learnt from
    cache = L.precompute_folds(df.where("patient < 6"), cols, "y").cache()
    n = cache.groupBy("fold", "split").count().toPandas().set_index(["fold", "split"])["count"]
    assert n[0, "test"] == 12 and n[0, "train"] == 60
    got = L.evaluate_moe(df.where("patient < 6"), EXPERTS, QUAL, "ridge", cache=cache).toPandas()
    assert len(got) == 72 and got["p"].between(0, 1).all()


@pytest.mark.parametrize(("kind", "options"), [("equal", {}), ("ridge", {"map": "decay"}), ("ridge", {"trust": True}), ("ridge", {"freeze": True}), ("net", {}), ("class_lr", {}), ("unsup_pca", {"groups": [[0], [1], [2]], "anchors": [0, 1, 2]}), ("stack_lr", {"discordance": True}), ("errpred", {})])
def test_evaluate_moe(spark, kind, options):
    got = L.evaluate_moe(spark.createDataFrame(TAB), EXPERTS, QUAL, kind, options).toPandas()
    assert len(got) == len(TAB) and M.rank_auc(got["p"].to_numpy(), got["y"].to_numpy()) > 0.75
    w = got[[f"w_{m}" for m in EXPERTS]].to_numpy()
    if not kind.startswith("stack"):
        assert np.allclose(w.sum(axis=1), 1, atol=1e-5)
    if options.get("freeze"):
        assert (got.groupby("patient")["w_cecg"].nunique() == 1).all()


@pytest.mark.parametrize("mode", ["window", "window_nested", "patient_pooled", "patient_nested"])
def test_nested_evaluation(spark, mode):
    got = L.nested_evaluation(spark.createDataFrame(TAB), ["f_cecg", "f_ppg", "f_bcg"], "y", mode=mode, weight="q_cecg" if mode == "patient_nested" else None).toPandas()
    assert len(got) == (12 if mode.startswith("patient") else len(TAB)) and ((got["call"] == 1) == (got["y"] == 1)).mean() > 0.7


def test_compare_and_tune(spark):
    df = spark.createDataFrame(TAB)
    got = {r["variant"]: r["auc"] for r in L.compare(df, EXPERTS, QUAL, {"equal": ("equal", {}), "ridge": ("ridge", {})}).collect()}
    assert got["ridge"] >= got["equal"] - 0.02
    t = L.tune(df, ["f_cecg"], "y", lambda rng: ("LR", {"c": float(10 ** rng.uniform(-3, 2))}), trials=3).toPandas()
    assert len(t) == 3 and t["auc"].between(0.5, 1).all()


def test_pipelines(spark):
    from pulsegrid.learn import pipelines as S

    df = spark.createDataFrame(TAB)
    for name in ("LR", "RF"):
        fitted = S.fit(df, ["f_cecg", "f_ppg", "f_bcg"], "y", name)
        got = fitted.transform(df).select("y", "p").toPandas()
        assert M.rank_auc(got["p"].to_numpy(), got["y"].to_numpy()) > 0.85
    mine = M.Logistic(1.0).fit(X, Y).predict(X)
    theirs = S.fit(df, ["f_cecg", "f_ppg", "f_bcg"], "y", "LR").transform(df).orderBy("patient", "win_idx").toPandas()["p"]
    assert np.abs(mine - theirs).max() < 0.02


# Fits from sums, and awkward ids and labels


def awkward(spark):
    """Ids beyond doubles, a null patient, missing and infinite values, rows without a label, a patient of one window."""
    rng = np.random.default_rng(11)
    rows = []
    for i in range(240):
        p = [2**53 + 1, 2**53 + 2, 5, 6, None, 7][i % 6] if i else 8
        a, b = rng.normal(), rng.normal()
        y = int(a + 0.5 * b + rng.normal() > 0)
        rows.append((p, 2**60 + i, None if i % 17 == 3 else y, None if i % 11 == 0 else a, float("inf") if i == 20 else b, 1.5))
    return spark.createDataFrame(rows, "patient long, win_idx long, y int, a double, b double, flat double")


@pytest.mark.parametrize("spec", ["LR", ("LR", {"c": 0.05})])
def test_fits_from_sums_equal_fits_of_frames(spark, monkeypatch, spec):
    x = awkward(spark)
    got = {(r.patient, r.win_idx): (r.y, r.p) for r in L.lopo_predictions(x, ["a", "b", "flat"], "y", spec).collect()}
    monkeypatch.setattr(L, "logistic_strength", lambda _: None)
    want = {(r.patient, r.win_idx): (r.y, r.p) for r in L.lopo_predictions(x, ["a", "b", "flat"], "y", spec).collect()}
    keys = {(r.patient, r.win_idx) for r in x.where("patient IS NOT NULL").collect()}
    assert got.keys() == want.keys() == keys
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-8 for k in keys)
    assert any(v[0] is None for v in got.values()) and all(v[1] is not None for v in got.values())


def test_fits_from_sums_of_several_models_at_once(spark):
    x = awkward(spark)
    both = {(r.patient, r.win_idx): (r.p_m, r.p_n) for r in L.expert_oof(x, {"m": ["a"], "n": ["b", "a"]}, "y").collect()}
    for i, cols in enumerate((["a"], ["b", "a"])):
        alone = {(r.patient, r.win_idx): r.p for r in L.lopo_predictions(x, cols, "y").collect()}
        assert all(abs(both[k][i] - v) < 1e-9 for k, v in alone.items()) and alone.keys() == both.keys()


def test_fits_from_sums_with_one_class_or_no_rows(spark):
    x = spark.createDataFrame([("a", 1, 1, 0.1), ("a", 2, 1, 0.3), ("b", 3, 1, 0.2), ("c", 4, 0, 0.9), ("c", 5, None, 0.4)], "patient string, win_idx int, y int, v double")
    got = {r.win_idx: r.p for r in L.lopo_predictions(x, ["v"], "y").collect()}
    assert got[4] == got[5] == 1.0 and 0 < got[1] < 1 and len(got) == 5
    assert L.lopo_predictions(x.where("y > 5"), ["v"], "y").collect() == []
    alone = L.lopo_predictions(x.where("patient = 'a'"), ["v"], "y").collect()
    assert [r.p for r in alone] == [0.5, 0.5]


def test_fits_from_sums_move_no_row_to_a_fold(spark):
    """The fit's pass has one exchange, of sums, and no row is spread over folds."""
    from pulsegrid.learn import sums

    x, values = sums.numbered(awkward(spark), ["a", "b"], "y", "patient")
    s = sums.statistics(x, ["a", "b"], values)
    run = sums.logistic_sums([([0, 1], s, np.zeros((len(values), 3)))], True)
    got = sums.passed(x.where("_y IS NOT NULL").repartition(7), ["a", "b"], len(values), run)
    pdf = x.where("_y IS NOT NULL").toPandas()
    want = run(pdf[["a", "b"]].to_numpy(float), pdf["_y"].to_numpy(float), pdf["_fold"].to_numpy())
    assert np.allclose(got, want, atol=1e-9) and got.shape == (len(values), 3 + 6)


def test_other_learners_score_unlabelled_rows_and_keep_ids(spark):
    x = awkward(spark).na.fill(0.0, ["a"])
    got = L.lopo_predictions(x, ["a", "b"], "y", ("GB", {"rounds": 3})).collect()
    assert {(r.patient, r.win_idx) for r in got} == {(r.patient, r.win_idx) for r in x.where("patient IS NOT NULL").collect()}
    assert all(r.p is not None and not np.isnan(r.p) for r in got)


@pytest.mark.parametrize("shared", [False, True])
def test_components_from_sums_equal_those_of_frames(spark, shared):
    from pulsegrid.learn import components as C

    rng = np.random.default_rng(8)
    n = 180
    base = rng.normal(size=n)
    x = np.column_stack([base + rng.normal(size=n) * s for s in (0.5, 1.0, 2.0)] + [-base + rng.normal(size=n), rng.normal(size=n)])
    x[::13, 1] = np.nan
    x[5, 4] = np.inf
    who = [[3, 4, 2**53 + 1, None][i % 4] if i else 8 for i in range(n)]
    rows = [(w, i, *[None if np.isnan(v) else float(v) for v in r]) for i, (w, r) in enumerate(zip(who, x, strict=True))]
    df = spark.createDataFrame(rows, "patient long, win_idx int, a double, b double, c double, d double, e double")
    groups, anchors = {"m": ["a", "b", "c"], "n": ["d", "e"]}, {"m": "a", "n": "d"}
    got = {r.win_idx: r for r in C.lopo_components(df, groups, anchors, shared=shared).collect()}
    assert len(got) == n
    places = [[0, 1, 2], [3, 4]]
    for p in (3, 4, 2**53 + 1, 8):
        te = np.array([w == p for w in who])
        gate = G.UnsupervisedGate(places, [0, 3], "shared" if shared else "own").fit(x[~te])
        want, weights = gate.quality(x[te]), gate.weights(x[te])
        for k, i in enumerate(np.flatnonzero(te)):
            r = got[int(i)]
            assert np.allclose([r.quality_m, r.quality_n], want[k], atol=1e-8) and np.allclose([r.w_m, r.w_n], weights[k], atol=1e-8)
    assert all(got[i].quality_m is None for i, w in enumerate(who) if w is None)
    assert C.lopo_components(df.limit(0), groups, anchors).collect() == []
    flat = C.lopo_components(df.withColumns({c: F.lit(1.0) for c in "abcde"}), groups, anchors).where("patient = 3").first()
    assert flat.quality_m == 0.5 and flat.w_m == pytest.approx(0.5)

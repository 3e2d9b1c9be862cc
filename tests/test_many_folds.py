"""Leaving many groups out must not cost rows x groups, and must give what plain fits give."""

from __future__ import annotations

import numpy as np
import pandas as pd

from pulsegrid.learn import folds as L
from pulsegrid.learn import sums


def many(patients=300, windows=40):
    """Two telling columns, one of them with gaps, one that tells nothing; some windows without a label."""
    rng = np.random.default_rng(0)
    n = patients * windows
    t = pd.DataFrame({"patient": np.repeat(np.arange(patients), windows), "win_idx": np.arange(n), "y": rng.integers(0, 2, n).astype(float)})
    for i, k in enumerate("abc"):
        t[k] = rng.normal(size=n) * (i + 1) + (t["y"] if i < 2 else 0) + 5
    t.loc[::13, "b"], t.loc[::17, "y"] = np.nan, np.nan
    return t


def test_logistic_fits_of_many_folds_make_no_pass_over_rows_x_folds(spark, monkeypatch):
    t, widest, plain = many(), [], sums.passed
    monkeypatch.setattr(sums, "passed", lambda x, columns, shape, run: widest.append(shape) or plain(x, columns, shape, run))
    df = spark.createDataFrame(t).selectExpr("patient", "win_idx", "if(isnan(y), null, cast(y as int)) AS y", "a", "if(isnan(b), null, b) AS b", "c")
    got = L.expert_oof(df.repartition(5), {"all": ["a", "b", "c"], "one": ["a"]}, "y").toPandas().sort_values("win_idx")
    assert len(got) == len(t) and max(widest, default=0) <= sums.FEW
    known = t["y"].notna()
    for m, columns in {"all": ["a", "b", "c"], "one": ["a"]}.items():
        score = L.fit_predict("LR", columns, "y")
        for p in (0, 7, 299):
            assert np.allclose(got.loc[got["patient"] == p, f"p_{m}"], score(t[known & (t["patient"] != p)], t[t["patient"] == p]), atol=1e-8, rtol=0)


def test_a_fold_far_from_the_others_is_fitted_by_passes(spark):
    """One group of other values, which the expansion can't reach: still the plain fit."""
    t = many(60, 20).dropna().astype({"y": int})
    t.loc[t["patient"] == 3, "a"] += 40
    got = L.lopo_predictions(spark.createDataFrame(t), ["a", "c"], "y").toPandas().sort_values("win_idx")
    score = L.fit_predict("LR", ["a", "c"], "y")
    for p in (3, 4):
        assert np.allclose(got.loc[got["patient"] == p, "p"], score(t[t["patient"] != p], t[t["patient"] == p]), atol=1e-8, rtol=0)

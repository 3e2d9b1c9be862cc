"""A search over logistic learners finds what frames of the whole table find, and gathers the table nowhere."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql.pandas.group_ops import PandasGroupedOpsMixin

from pulsegrid.learn import folds as L
from pulsegrid.learn.models import rank_auc
from tests.test_many_folds import many


def test_logistic_search_equals_frames(spark, monkeypatch):
    t = many(40, 25)
    columns, rng = ["a", "b"], np.random.default_rng(0)
    space = lambda rng: ("LR", {"c": float(10 ** rng.uniform(-5, 2))})
    specs = [space(rng) for _ in range(4)]
    known = t[t["y"].notna()].sort_values(["patient", "win_idx"]).reset_index(drop=True)
    part, want = L.group_folds(known["patient"].to_numpy(), known["y"].to_numpy(), 5), []
    for s in specs:
        p = np.full(len(known), np.nan)
        for f in range(5):
            p[part == f] = L.fit_predict(s, columns, "y")(known[part != f], known[part == f])
        want.append(rank_auc(p, known["y"].to_numpy()))
    monkeypatch.setattr(PandasGroupedOpsMixin, "applyInPandas", lambda *a: pytest.fail("a trial held the table"))
    df = spark.createDataFrame(t).selectExpr("patient", "win_idx", "if(isnan(y), null, cast(y as int)) AS y", "a", "if(isnan(b), null, b) AS b")
    got = {r["trial"]: r for r in L.tune(df.repartition(5), columns, "y", space, 4).collect()}
    assert [got[i]["spec"] for i in range(4)] == [repr(s) for s in specs] and len(set(want)) > 1
    assert np.allclose([got[i]["auc"] for i in range(4)], want, atol=1e-9)


def test_one_group_has_no_area(spark):
    df = spark.createDataFrame(pd.DataFrame({"patient": 1, "win_idx": range(6), "y": [0, 1] * 3, "a": np.arange(6.0)}))
    assert [r["auc"] for r in L.tune(df, ["a"], "y", lambda rng: "LR", 2).collect()] == [None, None]


def test_areas_count_ties_half(spark):
    from pulsegrid.learn import trials
    from pulsegrid.learn.nets import packed

    rng = np.random.default_rng(1)
    t = pd.DataFrame({"f": 0.0, "y": rng.integers(0, 2, 3000).astype(float), "a": rng.integers(0, 9, 3000) / 8, "b": 0.0})
    t["b"] = (t["a"] + rng.integers(0, 2, 3000) * t["y"]) / 2
    got = trials.areas(packed(spark.createDataFrame(t).repartition(4), ["f", "y", "a", "b"]), 4, lambda v: v[:, 2:], 2)
    assert np.allclose(got, [rank_auc(t[c].to_numpy(), t["y"].to_numpy()) for c in "ab"], atol=1e-12)

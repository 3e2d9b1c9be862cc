"""A search over ridge gates by passes finds what frames of the whole table find, and gathers the table nowhere."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql.pandas.group_ops import PandasGroupedOpsMixin

from pulsegrid.learn import folds as L
from pulsegrid.learn import reports
from pulsegrid.learn.models import rank_auc
from tests.test_nearby import EXPERTS, QUAL, framed, table


@pytest.mark.parametrize("options", [{}, {"map": "decay", "e0": 0.5, "tau": 1.0}])
def test_ridge_search_equals_frames(spark, monkeypatch, options):
    t = table()
    t["y"] = t["y"].astype("Int64")
    t.loc[t.index[5::40], "y"] = pd.NA
    space = lambda rng: ("ridge", {"alpha": float(10 ** rng.uniform(-2, 3))} | options)
    rng = np.random.default_rng(0)
    specs = [space(rng) for _ in range(4)]
    known = t[t["y"].notna()].astype({"y": int}).sort_values(["patient", "win_idx"]).reset_index(drop=True)
    part = L.group_folds(known["patient"].to_numpy(), known["y"].to_numpy(), 3)
    want = []
    for kind, o in specs:
        fused = np.full(len(known), np.nan)
        for f in range(3):
            a, b = known[part != f], known[part == f]
            fused[part == f] = (L.gate_weights(a, b, EXPERTS, QUAL, kind, o)[1] * b[[f"p_{m}" for m in EXPERTS]].to_numpy()).sum(axis=1)
        want.append(rank_auc(fused, known["y"].to_numpy()))
    monkeypatch.setattr(PandasGroupedOpsMixin, "applyInPandas", lambda *a: pytest.fail("a trial held the table"))
    got = {r["trial"]: r for r in reports.tune_gate(framed(spark, t), EXPERTS, QUAL, space, 4).collect()}
    assert [got[i]["spec"] for i in range(4)] == [repr(s) for s in specs] and len(set(want)) > 1
    assert np.allclose([got[i]["auc"] for i in range(4)], want, atol=1e-9)

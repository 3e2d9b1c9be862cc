"""Gating networks of a few groups: fitted where the rows lie, the same networks and thresholds as one frame's."""

from __future__ import annotations

import numpy as np
import pytest

from pulsegrid.learn import folds as L
from tests.test_learn import EXPERTS, QUAL, table


@pytest.mark.parametrize("kind", ["net", "reliability"])
def test_nets_hold_no_fold_in_one_task(spark, monkeypatch, kind):
    t = table(12, 30)
    t["fold"] = t["patient"] % 5
    t.loc[t["win_idx"] % 9 == 0, "q_ppg"] = np.nan
    df, options = spark.createDataFrame(t).repartition(4), {"epochs": 40}
    monkeypatch.setattr(L.sums, "FEW", 0)
    want = L.evaluate_moe(df, EXPERTS, QUAL, kind, options, "fold").toPandas().sort_values(["patient", "win_idx"]).reset_index(drop=True)
    monkeypatch.undo()
    monkeypatch.setattr(L, "by_fold", lambda *a: pytest.fail("a fold was fitted in one task"))
    got = L.evaluate_moe(df, EXPERTS, QUAL, kind, options, "fold").toPandas().sort_values(["patient", "win_idx"]).reset_index(drop=True)
    assert list(got) == list(want) and len(got) == len(t) and (got["call"] == want["call"]).all()
    for c in ("p", "threshold", *[f"w_{m}" for m in EXPERTS]):
        assert np.allclose(got[c], want[c], atol=1e-9, rtol=0)

"""Classification gates of many left-out groups from one expansion, against a fit of each fold's frame."""

from __future__ import annotations

import numpy as np
import pytest

from pulsegrid.learn import classgate
from pulsegrid.learn import folds as L
from tests.test_nearby import EXPERTS, QUAL, framed, table


@pytest.mark.parametrize("every", [False, True])
def test_class_gate_equals_frames_and_holds_no_table(spark, monkeypatch, every):
    """Gaps, one patient of many rows; all folds by passes, or only those that the expansion doesn't reach."""
    t = table(40, 900)
    passed, plain = [], classgate.passes
    monkeypatch.setattr(classgate, "passes", lambda *a: passed.append(len(a[4])) or plain(*a))
    if every:
        monkeypatch.setattr(classgate, "TOLERANCE", 1e-12)
    monkeypatch.setattr(L, "by_fold", lambda *a: pytest.fail("a task held the table"))
    got = L.evaluate_moe(framed(spark, t), EXPERTS, QUAL, "class_lr").toPandas().sort_values("win_idx")
    assert len(got) == len(t) and passed and (sum(passed) == 40 or not every)
    for f in (0, 7, 39):
        tr, te = t[t["patient"] != f].sort_values(["patient", "win_idx"]), t[t["patient"] == f]
        wa, wb = L.gate_weights(tr, te, EXPERTS, QUAL, "class_lr", {})
        p = [f"p_{m}" for m in EXPERTS]
        mine = got[got["patient"] == f]
        assert np.abs(mine[[f"w_{m}" for m in EXPERTS]].to_numpy() - wb).max() < 1e-8
        cut = L.threshold((wa * tr[p].to_numpy()).sum(axis=1), tr["y"].to_numpy(float))
        assert np.allclose(mine["threshold"].to_numpy(float), cut, atol=1e-8)


def test_too_few_good_windows_take_the_frames(spark):
    t = table(6, 60)
    assert len(L.evaluate_moe(framed(spark, t), EXPERTS, QUAL, "class_lr").collect()) == 60

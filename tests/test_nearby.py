"""Gates and components of many left-out groups from sums and bands, against a fit of each fold's frame."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import DataFrame

from pulsegrid.learn import folds as L
from pulsegrid.learn import gates as G
from pulsegrid.learn import nearby

EXPERTS, QUAL = ("a", "b", "c"), ("q_a", "q_b", "q_c")


def table(patients: int = 80, rows: int = 1200) -> pd.DataFrame:
    rng = np.random.default_rng(5)
    t = pd.DataFrame({"patient": rng.integers(0, patients, rows), "win_idx": np.arange(rows)})
    t.loc[t.index[:40], "patient"] = 0  # one patient of many rows
    t["y"] = (rng.random(rows) < 0.4).astype(int)
    for m in EXPERTS:
        q = rng.random(rows)
        t[f"q_{m}"], t[f"p_{m}"] = q, np.clip(0.5 * t["y"] * q + 0.5 * rng.random(rows), 0, 1)
        t[f"e_{m}"] = np.where(rng.random(rows) < 0.1, np.nan, 4 * (1 - q) + rng.random(rows))
    t.loc[t.index[::17], "q_b"] = np.nan
    return t


def framed(spark, t: pd.DataFrame) -> DataFrame:
    return spark.createDataFrame(t.astype(object).where(t.notna(), None), "patient long, win_idx long, y int, " + ", ".join(f"q_{m} double, p_{m} double, e_{m} double" for m in EXPERTS))


@pytest.fixture
def few_rows_to_the_driver(monkeypatch):
    """No action returns more rows than a band or the tasks' sums have."""
    collect = DataFrame.collect

    def counted(self):
        got = collect(self)
        assert len(got) <= 64, "a result of folds or rows came to the driver"
        return got

    monkeypatch.setattr(DataFrame, "collect", counted)
    return collect


def test_components_of_many_folds_stay_off_the_driver(spark, monkeypatch, few_rows_to_the_driver):
    from pulsegrid.learn.components import lopo_components

    t = table()
    monkeypatch.setattr(nearby, "LIMIT", 400)  # the band is cut
    df = framed(spark, t)
    out = lopo_components(df, {"a": ["q_a", "p_a", "q_b"], "c": ["q_c"]}, {"a": "q_a", "c": "q_c"})
    got = {r["win_idx"]: r["quality_a"] for r in few_rows_to_the_driver(out)}
    for f in (0, 33):
        tr, te = t[t["patient"] != f], t[t["patient"] == f]
        x = ["q_a", "p_a", "q_b"]
        want = G.Quality().fit(tr[x].to_numpy(), tr["q_a"].to_numpy()).predict(te[x].to_numpy())
        assert np.abs(want - [got[i] for i in te["win_idx"]]).max() < 1e-8


@pytest.mark.parametrize(("kind", "options", "limit"), [("ridge", {"map": "decay", "e0": 0.5, "tau": 1.0}, 300), ("ridge", {"freeze": True}, 1000), ("unsup_pca", {"groups": [[0], [2]], "anchors": [0, 2]}, 300)])
def test_gates_of_many_folds_equal_those_of_frames(spark, monkeypatch, kind, options, limit):
    t = table()
    df, experts = framed(spark, t), EXPERTS if kind == "ridge" else ("a", "c")
    want = {}
    for f in (0, 33):
        tr, te = t[t["patient"] != f], t[t["patient"] == f]
        wa, wb = L.gate_weights(tr, te, experts, QUAL, kind, options)
        p = [f"p_{m}" for m in experts]
        cut = L.threshold((wa * tr[p].to_numpy()).sum(axis=1), tr["y"].to_numpy(float))
        want |= {i: (a, *w, cut) for i, a, w in zip(te["win_idx"], (wb * te[p].to_numpy()).sum(axis=1), wb, strict=True)}
    monkeypatch.setattr(L, "by_fold", lambda *a: pytest.fail("the table was sent to a task for its folds"))
    monkeypatch.setattr(nearby, "LIMIT", limit)
    made = L.evaluate_moe(df, experts, QUAL, kind, options).collect()
    assert len(made) == len(t)
    got = {r["win_idx"]: (r["p"], *[r[f"w_{m}"] for m in experts], r["threshold"], r["call"]) for r in made}
    for i, w in want.items():
        assert np.allclose(got[i][:-1], w, atol=1e-7) and got[i][-1] == (got[i][0] >= got[i][-2])

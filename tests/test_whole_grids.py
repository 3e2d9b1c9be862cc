"""The comparisons show the whole grid of the reference, and each model or gate is fitted once for all its figures."""

from __future__ import annotations

import pytest

from pulsegrid.learn import folds as L
from pulsegrid.learn import reports
from pulsegrid.plans import catalog
from tests.test_learn import EXPERTS, QUAL, TAB

SF = "/root/testdata/sf0.001"
MODES = ["window", "window_nested", "patient_pooled", "patient_nested"]


def test_compare_models_takes_all_models_and_modes(spark, monkeypatch):
    told = {}
    monkeypatch.setattr(reports, "compare_models", lambda df, columns, label, specs, modes, fold: told.update(specs=specs, modes=modes) or df)
    catalog.queries()["compare_models"](spark, SF)
    assert {"SVM", "LR", "RF", "GB", "XGB", "LR+cal"} == set(told["specs"]) and list(told["modes"]) == MODES


def test_modes_share_the_fits_and_equal_each_mode_alone(spark, monkeypatch):
    df, columns = spark.createDataFrame(TAB), ["f_cecg", "f_ppg"]
    passes, plain = [], L.by_fold
    monkeypatch.setattr(L, "by_fold", lambda *a: passes.append(a[1]) or plain(*a))
    got = {(r["model"], r["mode"]): r for r in reports.compare_models(df, columns, "y", {"LR": "LR", "LR+cal": "LR+cal"}, MODES).collect()}
    assert len(got) == 8 and len(passes) == 2
    for mode in MODES:
        one = L.nested_evaluation(df, columns, "y", "LR", mode).toPandas()
        r = got["LR", mode]
        assert (r["tp"], r["fp"]) == (int((one["call"] & (one["y"] == 1)).sum()), int((one["call"] & (one["y"] == 0)).sum()))


@pytest.mark.parametrize("n", [1, 7, 12])
def test_workers_have_a_partition_each(spark, n):
    df = spark.createDataFrame([(k,) for k in L.apart(spark, n)], "k int").repartition(n, "k")
    assert sorted(df.rdd.mapPartitions(lambda rows: [len(list(rows))]).collect()) == [1] * n


def test_compare_gates_takes_all_gates_with_their_calls(spark, monkeypatch):
    told = {}
    monkeypatch.setattr(L, "compare", lambda df, experts, columns, variants, fold: told.update(variants) or df)
    catalog.queries()["compare_gates"](spark, SF)
    assert {"equal", "ridge", "gb", "mlp"} <= {kind for kind, _ in told.values()} and ("ridge", {"freeze": True}) in told.values()


def test_compare_tells_calls_and_thresholds(spark):
    df = spark.createDataFrame(TAB)
    got = {r["variant"]: r for r in L.compare(df, EXPERTS, QUAL, {"equal": ("equal", {}), "gb": ("gb", {"params": {"rounds": 3}})}).collect()}
    for name, (kind, options) in {"equal": ("equal", {}), "gb": ("gb", {"params": {"rounds": 3}})}.items():
        one = L.evaluate_moe(df, EXPERTS, QUAL, kind, options).toPandas()
        r = got[name]
        assert (r["tp"], r["tn"]) == (int((one["call"] & (one["y"] == 1)).sum()), int((~one["call"] & (one["y"] == 0)).sum()))
        assert r["threshold"] == pytest.approx(one.groupby("patient")["threshold"].min().mean(), abs=1e-9)

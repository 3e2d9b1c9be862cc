"""Every registered signal query against its SQL twin in DuckDB, and its output schema."""

from __future__ import annotations

import math
from collections import Counter

import duckdb
import pytest

from pulsegrid.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return float(v) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_its_twin(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    got = [tuple(norm(r[c]) for c in sorted(df.columns)) for r in df.collect()]
    assert got or name in ("routing_targets", "failing_windows")  # may be none in so few rows
    if sql := catalog.oracle_sql().get(name):
        res = duck.execute(sql)
        names = [c[0] for c in res.description]
        order = sorted(range(len(names)), key=lambda i: names[i])
        assert [names[i] for i in order] == sorted(df.columns)
        assert Counter(got) == Counter(tuple(norm(r[i]) for i in order) for r in res.fetchall())


def test_only_models_and_iterations_lack_a_twin():
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == catalog.WITHOUT_TWIN


def test_native_queries_run_no_python(spark):
    for name in ("hrv_features", "feat_time_domain", "weights_softmax", "auc_rank", "stream_k_of_m", "align_drift_interp", "reliability_best_channel"):
        plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "CartesianProduct" not in plan


def test_flagship(spark):
    out = catalog.flagship(spark, SF)
    assert out.count() == 15 and {"cv", "RMSSD", "first_alarm", "p"} <= set(out.columns)


def test_learners_are_registered_with_their_defaults(spark, monkeypatch):
    """No reduced number of draws, epochs, hidden units or trials."""
    from pulsegrid.learn import folds, reports
    from pulsegrid.operators import metrics

    told = {}

    def note(name):
        return lambda *args, **options: told.setdefault(name, (args, options)) and args[0]

    for module, name in ((metrics, "bootstrap"), (folds, "tune"), (reports, "tune_gate"), (folds, "evaluate_moe")):
        monkeypatch.setattr(module, name, note(name))
    monkeypatch.setattr(catalog, "rounded", lambda df: df)
    for name in ("bootstrap_ci", "tune_expert", "tune_gate"):
        catalog.queries()[name](spark, SF)
    assert not {"draws", "trials"} & {k for _, options in told.values() for k in options}
    for name in ("gating_net_5_folds", "reliability_gate_5_folds", "errpred_fusion_5_folds"):
        told.pop("evaluate_moe", None)
        catalog.queries()[name](spark, SF)
        assert told["evaluate_moe"][0][4] == {}

"""The bootstrap multiplies no row by its draws."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import metrics as M


def test_hash_is_sparks(spark):
    got = [r[0] for r in spark.range(50).select(F.xxhash64(F.lit(7).cast("long"), "id", F.lit(-3))).collect()]
    assert M.xxhash([7, np.arange(50)], -3).view(np.int64).tolist() == got


@pytest.mark.parametrize(("once", "ties"), [(False, 0), (True, 3), (False, 5000)])
def test_draws_equal_those_of_multiplied_rows(spark, once, ties):
    """Each draw's AUC from its picks, one by one; scores without ties, with some, and all but few alike."""
    rng = np.random.default_rng(2)
    t = pd.DataFrame({"g": rng.integers(0, 40, 4000), "y": rng.integers(0, 2, 4000), "p": rng.random(4000)})
    t["p"] = (t["p"] * ties).round(0) / ties if ties == 3 else t["p"] if not ties else np.where(t["p"] < 0.97, 0.5, t["p"])
    counts = M.by_score(spark.createDataFrame(t), "p", "y", ["g"]).withColumn("_u", F.col("g"))
    got = M.drawn_pairs(counts.select("score", "_u", "pos", "neg"), 30, 40, 1, once).toPandas().groupby("draw")[["pos", "neg"]].sum()
    low, high = M.bootstrap(spark.createDataFrame(t), "p", "y", "g", 30, 1, legacy_subset=once).select("low", "high").first()
    units = {r["g"]: r["_u"] for r in M.numbered(spark.createDataFrame(t).select("g").distinct(), "g", 1).collect()}
    aucs = []
    for d in range(30):
        w = np.minimum(M.picked(d, 40, 1), 1) if once else M.picked(d, 40, 1)
        assert w.sum() == 40 or once
        w = w[t["g"].map(units)]
        x = t.assign(p1=w * t["y"], p0=w * (1 - t["y"])).groupby("p")[["p1", "p0"]].sum().sort_index()
        aucs.append((x["p1"] * (x["p0"].cumsum() - x["p0"] / 2)).sum() / (x["p1"].sum() * x["p0"].sum()))
    assert np.allclose([low, high], np.quantile(aucs, [0.025, 0.975]), rtol=1e-12)
    own = M.picked(3, 40, 1)[t["g"]] if not once else np.minimum(M.picked(3, 40, 1), 1)[t["g"]]
    assert got.loc[3, "pos"] == own[t["y"] == 1].sum() and got.loc[3, "neg"] == own[t["y"] == 0].sum()


def test_no_row_is_multiplied_by_draws(spark):
    """Rows sent in a bootstrap of 2,000 draws are some times the table, not some times rows x draws."""
    df = spark.range(5000).select((F.col("id") % 500).alias("g"), (F.col("id") * 7919 % 5003 / 5003).alias("p"), (F.col("id") * 31 % 7 < 3).cast("int").alias("y"))
    written = lambda: spark._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    before = written()
    assert M.bootstrap(df, "p", "y", "g", 2000).first()["draws_used"] == 2000
    assert written() - before < 3_000_000

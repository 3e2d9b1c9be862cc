"""DataFrame operators against numpy kernels and small cases; sources, sinks and streams on files made here."""

from __future__ import annotations

import json
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import dsp, native, udfs
from pulsegrid.functions import rr as R
from pulsegrid.functions import window_features as W
from pulsegrid.operators import extract as E
from pulsegrid.operators import metrics as M
from pulsegrid.operators import rr as RR
from pulsegrid.operators import spectral as S
from pulsegrid.operators import tables as T
from pulsegrid.operators import windows as WN
from pulsegrid.sources import alignment, cache, packets, recordings
from pulsegrid.streaming import jobs

RNG = np.random.default_rng(0)
ROWS = [(i, [float(v) for v in RNG.normal(size=64)]) for i in range(6)] + [(6, [1.0] * 64)]


@pytest.fixture(scope="module")
def x(spark):
    return spark.createDataFrame(ROWS, "id int, x array<double>").orderBy("id").cache()


def values(x, column):
    return [r[0] for r in x.select(column.alias("v")).collect()]


def test_spectral_expressions_equal_kernels(x):
    a = [np.array(v) for _, v in ROWS]
    psd = S.power_spectrum(F.col("x"), 64)
    for got, v in zip(values(x, psd), a, strict=True):
        assert np.allclose(got, dsp.periodogram(v, 64, False)[1], atol=1e-9)
    for got, v in zip(values(x, udfs.spectrum(64, True)(F.col("x"))), a, strict=True):
        assert np.allclose(got, dsp.periodogram(v, 64, True)[1], atol=1e-9)
    for got, v in zip(values(x, S.spread(psd))[:6], a, strict=False):
        assert np.isclose(got, W.spread_of(dsp.periodogram(v, 64, False)[1]))
    for got, v in zip(values(x, S.papr_time(F.col("x")))[:6], a, strict=False):
        assert np.isclose(got, W.papr(v, "time"))
    for got, v in zip(values(x, S.lag_correlation(F.col("x"), 0, 20))[:6], a, strict=False):
        assert np.allclose(got, dsp.autocorrelation(v)[:21])
    assert values(x, S.lag_correlation(F.col("x"), 1, 2))[6] == [None, None]
    for got, v in zip(values(x, S.amplitude_stability(F.col("x"), 16)), a, strict=True):
        assert np.isclose(got, W.a_sqi(v, 8))
    for got, v in zip(values(x, S.local_maxima(F.col("x"))), a, strict=True):
        assert got == list(dsp.find_peaks(v))


@pytest.mark.parametrize("k", [0, 3, -5, 64, -64, 100, -100])
def test_shift_equals_kernel(x, k):
    for got, (_, v) in zip(values(x, native.shifted(F.col("x"), k)), ROWS, strict=True):
        assert np.allclose(got, dsp.shift(np.array(v), k))


@pytest.mark.parametrize(("a", "b"), [(0, 4), (2, 5), (-3, 1), (4, -4), (0, 0)])
def test_drift_equals_kernel(x, a, b):
    for got, (_, v) in zip(values(x, alignment.drifted(F.col("x"), F.lit(a), F.lit(b))), ROWS, strict=True):
        assert np.allclose(got, dsp.correct_drift(np.array(v), a, b))


def test_array_helpers(x):
    got = values(x, native.trimmed(native.flipped(F.col("x"), True), 2, 3))[0]
    assert got[:2] == [None] * 2 and got[-3:] == [None] * 3 and got[2] == -ROWS[0][1][2]
    assert values(x, native.min_max_range(F.col("x")))[6] is None and set(values(x, native.unit_range(F.col("x")))[6]) == {0.0}
    w = values(x, native.windows_of(F.col("x"), 30, 15))[0]
    assert [r["win_idx"] for r in w] == [0, 1, 2] and w[1]["samples"] == ROWS[0][1][15:45]
    assert values(x, native.windows_of(F.col("x"), 65, 15))[0] == []
    assert len(values(x, native.thinned(F.col("x"), 20))[0]) == 22


def test_arrow_functions(x):
    got = values(x, udfs.sqi(64, "ppg")(F.col("x")))
    for g, (_, v) in zip(got, ROWS, strict=True):
        want = W.sqi_block(np.array(v), 64, "ppg")
        assert all((g[k] is None and not np.isfinite(v)) or np.isclose(g[k], v) for k, v in want.items())
    holes = x.withColumn("x", F.transform("x", lambda v, i: F.when(i != 5, v)))
    assert values(holes, udfs.scalar("sample_entropy", 64)(F.col("x"))) == [None] * 7
    assert values(x, udfs.peaks("prominence", 64)(F.col("x")))[6] == []
    assert np.allclose(values(x, udfs.resampled(32)(F.col("x")))[1], dsp.fft_resample(np.array(ROWS[1][1]), 32))
    with pytest.raises(ValueError):
        udfs.peaks("nope", 64)


def test_sql_functions(spark, x):
    from pulsegrid.functions.registry import register

    names = register(spark, 64)
    assert "pg_peaks_prominence" in names and "pg_sqi_ppg" in names
    x.createOrReplaceTempView("windows_of_64")
    r = spark.sql("SELECT id, size(pg_peaks_prominence(x)) AS n, pg_sqi_ppg(x).pSQI AS p, pg_t_sqi(x) AS t FROM windows_of_64 ORDER BY id").collect()
    assert len(r) == 7 and abs(r[0]["p"] - W.p_sqi(np.array(ROWS[0][1]), 64, 0.6, 3.6)) < 1e-9


def test_rr_tables_equal_kernels(spark):
    rng = np.random.default_rng(1)
    series = {p: rng.uniform(400, 1200, n) for p, n in ((1, 40), (2, 13), (3, 5))}
    rr = spark.createDataFrame([(p, i + 1, float(v)) for p, s in series.items() for i, v in enumerate(s)], "p int, i int, rr double")
    one = lambda df: {r["p"]: r for r in df.collect()}
    h, l, t, s, r, d = one(RR.hrv(rr, "p")), one(RR.lorenz(rr, "p")), one(RR.turning_points(rr, "p")), one(RR.shannon(rr, "p")), one(RR.robust(rr, "p")), one(RR.dfa(rr, "p"))
    for p, v in series.items():
        for k, w in R.hrv(v).items():
            assert (h[p][k] is None and np.isnan(w)) or np.isclose(h[p][k], w)
        for k, w in R.lorenz(v).items():
            assert np.isclose(l[p][k], w)
        for k, w in R.robust(v).items():
            assert np.isclose(r[p][k], w)
        assert np.isclose(t[p]["TPR"], R.turning_points(v)) and np.isclose(s[p]["rrShannon"], R.shannon(v))
        assert p not in d if np.isnan(R.dfa_alpha1(v)) else np.isclose(d[p]["DFA_a1"], R.dfa_alpha1(v))


def test_weight_expressions_equal_kernels(spark):
    from pulsegrid.learn import gates as G

    rng = np.random.default_rng(2)
    e, q = rng.uniform(0, 3, (50, 3)), rng.uniform(0, 1, (50, 3))
    e[rng.random((50, 3)) < 0.2] = np.nan
    e[0] = np.nan
    rows = [(i, *[None if np.isnan(v) else float(v) for v in a], *map(float, b)) for i, (a, b) in enumerate(zip(e, q, strict=True))]
    df = spark.createDataFrame(rows, "i int, e0 double, e1 double, e2 double, q0 double, q1 double, q2 double").orderBy("i")
    got = lambda w: np.array([list(r) for r in df.select(*[c.alias(f"w{k}") for k, c in enumerate(w)]).collect()], float)
    E3, Q3 = ("e0", "e1", "e2"), ("q0", "q1", "q2")
    assert np.allclose(got(native.softmax_weights(E3, 1.5)), G.softmax_weights(e, 1.5))
    assert np.allclose(got(native.decay_weights(E3, 0.5, 0.25)), G.decay_weights(e, 0.5, 0.25)) and (got(native.decay_weights(E3, 0.5, 0.25, "keep"))[0] == 0).all()
    assert np.allclose(got(native.quality_weights(Q3)), G.quality_weights(q))
    assert np.allclose(got(native.blended_weights(native.quality_weights(Q3), [0.9, 2, -1])), G.blended(G.quality_weights(q), np.array([0.9, 2, -1])))


def test_quantiles_and_auc_do_not_sort_in_one_partition(spark):
    rng = np.random.default_rng(3)
    v = np.round(rng.normal(size=500), 1)
    df = spark.createDataFrame([(float(a), int(a > 0.2) if i % 3 else int(i % 2)) for i, a in enumerate(v)] + [(None, 1)], "v double, y int")
    got = {r["q"]: r["value"] for r in M.quantiles(df, "v", [0, 0.1, 0.37, 0.5, 1]).collect()}
    assert all(np.isclose(got[q], np.quantile(v, q)) for q in got) and len(got) == 5
    from pulsegrid.learn.models import rank_auc

    y = np.array([r["y"] for r in df.where("v IS NOT NULL").collect()])
    vv = np.array([r["v"] for r in df.where("v IS NOT NULL").collect()])
    assert np.isclose(M.auc(df, "v", "y").first()["auc"], rank_auc(vv, y)) and M.auc(df.where("y = 1"), "v", "y").first()["auc"] is None


def test_threshold_null_when_none_fits(spark):
    df = spark.createDataFrame([(0.9, 0), (0.1, 1)], "p double, y int")
    r = M.choose_threshold(df, "p", "y").first()
    assert (r["threshold"], r["tpr"], r["spec"]) == (None, 0.0, 1.0)


def test_bootstrap(spark):
    rng = np.random.default_rng(4)
    rows = [(g, float(rng.normal() + 0.8 * (g % 2)), g % 2) for g in range(16) for _ in range(8)]
    df = spark.createDataFrame(rows, "patient int, p double, y int")
    a = M.bootstrap(df, "p", "y", "patient", draws=100, seed=1).first()
    b = M.bootstrap(df, "p", "y", None, draws=60, seed=1).first()
    c = M.bootstrap(df, "p", "y", "patient", draws=60, seed=1, legacy_subset=True).first()
    for r in (a, b, c):
        assert 0.5 < r["low"] <= r["auc"] <= r["high"] <= 1 and r["draws_used"] > 40
    assert a["high"] - a["low"] < 0.35


def test_neighbours_stay_inside_a_patient(spark):
    df = spark.createDataFrame([(p, i, float(10 * p + i)) for p in (1, 2) for i in range(3)], "patient int, win_idx int, v double")
    r = {(x["patient"], x["win_idx"]): (x["v_prev1"], x["v_next1"]) for x in WN.neighbor_context(df, ["v"], 1).collect()}
    assert r[1, 0] == (10, 11) and r[1, 2] == (11, 12) and r[2, 0] == (20, 21)


def test_grid_mismatch_is_an_error(spark):
    a = spark.createDataFrame([(1, 0, 30.0)], "patient int, win_idx int, window_s double")
    assert T.aligned(a, a.withColumn("z", F.lit(1))).count() == 1
    with pytest.raises(ValueError):
        T.aligned(a, a.withColumn("window_s", F.lit(20.0)))


def test_column_helpers():
    cfg = E.ExtractConfig()
    cols = ["patient", "AF", "win_idx", "t_start_s", *E.feature_keys(cfg)]
    assert len(cols) == 191
    assert [len(T.expert_columns(cols, m)) for m in T.EXPERTS] == [33, 66, 52] and len(T.gate_columns(cols)) == 30 and len(T.gate_columns(cols, "composite")) == 5
    assert len(E.feature_keys(E.ExtractConfig(bcg_mode="rr"))) == 187 + 2 * 7
    assert T.modality_of("sqi_ppg1_tSQI") == "ppg" and T.modality_of("sqi_xmodal_confidence") is None
    T.no_informative_gate(cols, W.AF_KEYS)
    with pytest.raises(ValueError):
        T.no_informative_gate([*cols, "sqi_ppg1_CoSEn"], R.AF_KEYS)
    with pytest.raises(ValueError):
        T.expert_columns(cols, "nope")
    with pytest.raises(ValueError):
        E.ExtractConfig(sources={"cecg": "nope"}).checked()


# Packets


def packet(t, ms=250, ecg=(1, -2, 3, -4), fill=7):
    b = bytearray(77)
    b[0:8] = struct.pack("<Q", t)
    b[8:24] = struct.pack("<4i", *[int(v * 2**24 / 4800) for v in ecg])
    b[28:32] = struct.pack("<2H", 111, 444)
    b[40:48] = struct.pack("<4H", 1, 2, 222, 4)
    b[48:72] = struct.pack("<12h", *range(-6, 6))
    b[60:62] = struct.pack("<H", 333)
    b[72:74] = struct.pack("<H", ms)
    b[74] = fill
    return bytes(b)


def escape(b):
    return b.replace(b"\x7d", b"\x7d\x5d").replace(b"\x7e", b"\x7d\x5e")


def test_packet_decoding(spark, tmp_path):
    good = [packet(1000), packet(0x7D7E01, 5), packet(0, 0), packet(5)[:60]]
    (tmp_path / "a.bin").write_bytes(b"\x7e".join([b"", *map(escape, good), b"junk" * 20]))
    rows = packets.read_packet_files(spark, str(tmp_path)).orderBy("time").collect()
    assert [r["time"] for r in rows] == [1000.25, 0x7D7E01 + 0.005]
    r = rows[0]
    assert abs(r["ecg2"] + 2) < 1e-3 and (r["ppg1"], r["ppg2"], r["ppg3"], r["ppg4"]) == (111, 222, 333, 444) and r["mi3"] == 222
    assert r["scg1"]["x"] == -6 and r["scg4"]["z"] == 5 and r["bufFillState"] == 7
    flat = packets.flat(packets.read_packet_files(spark, str(tmp_path)))
    assert len(flat.columns) == 26  # time, 12 numbers, 12 motion axes, fill state
    packets.write_packet_csv(packets.read_packet_files(spark, str(tmp_path)), str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 2


def test_lone_escape_moves_later_replacements():
    assert packets.unescape(b"\x01\x7d\x5d\x02\x7d\x5e\x03") == b"\x01\x7d\x02\x7e\x03"
    assert packets.unescape(b"\x7d\x01\x02\x03\x7d\x5e\x04") == b"\x7d\x01\x02\x7e\x5e\x04"
    assert packets.unescape(b"\x01\x7d") == b"\x01\x7d"


def test_realtime_frames(spark):
    frames = b"".join(packet(t) + b"\0" * 4 for t in (1, 2, 3)) + b"rest"
    df = spark.createDataFrame([("c1", bytearray(frames)), ("c2", bytearray(b"")), ("c3", None)], "path string, content binary")
    rows = packets.read_realtime(df).orderBy("time").collect()
    assert [r["time"] for r in rows] == [1.25, 2.25, 3.25] and rows[0]["scg1"] == -4


# Recordings and alignment


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    """Two patients of 70 s (one in AF) and a broken one."""
    base = tmp_path_factory.mktemp("cohort")
    n = 70 * 128
    t = np.arange(n) / 128
    for k, p in enumerate(("PAT01", "PAT02")):
        (base / p / "Signals").mkdir(parents=True)
        (base / p / "gt").mkdir()
        rng = np.random.default_rng(k)
        data = 0.05 * rng.normal(size=(n, 25))
        for c in (1, 2, 3, 12, 24):
            data[:, c] += np.sin(2 * np.pi * 1.2 * t) + 0.3 * np.sin(2 * np.pi * 2.4 * t)
        pd.DataFrame(data, columns=[f"h{i}" for i in range(25)]).to_csv(base / p / "Signals/New_Data.csv", index=False)
        g = np.zeros((70 * 500, 4), int)
        at = np.cumsum(0.8 + (0.15 * rng.normal(size=85) if k else np.zeros(85)))
        tt = np.arange(70 * 500) / 500
        g[:, 3] = (1000 * sum(np.exp(-0.5 * ((tt - a) / 0.012) ** 2) for a in at)).astype(int)
        pd.DataFrame(g).to_csv(base / p / "gt/NOM_ECG_1.csv", header=False, index=False)
    (base / "PAT03/Signals").mkdir(parents=True)
    (base / "PAT03/Signals/New_Data.csv").write_text("a,b\n1,x\n")
    (base / "PAT01/alignment.json").write_text(json.dumps({"invert": {"cecg": True}, "initial_offset": 2, "final_offset": 3, "trim_end_s": 1.0}))
    (base / "PAT02/alignment.json").write_text("{broken")
    (base / "PAT02/polarity.json").write_text(json.dumps({"ppg1": -1, "gt_ecg": -1}))
    (base / "af.txt").write_text("PAT02\n\n  \n")
    return str(base)


def test_recordings(spark, root):
    r = recordings.reject_reason(recordings.read_device(spark, root)).orderBy("patient").collect()
    assert [x["patient"] for x in r] == ["PAT01", "PAT02", "PAT03"] and [x["reason"] is None for x in r] == [True, True, False]
    raw = pd.read_csv(f"{root}/PAT01/Signals/New_Data.csv")
    assert np.allclose(r[0]["ppg2"], raw["h24"]) and np.allclose(r[0]["bcg1"], raw["h2"])
    gt = recordings.read_reference(spark, root).where("patient = 'PAT01'").first()["gt"]
    assert len(gt) == 35_000 and max(gt) > 900
    assert [x["patient"] for x in recordings.patients(spark, root, ("Signals/New_Data.csv", "gt/*.csv")).collect()] == ["PAT01", "PAT02"]
    assert [x["patient"] for x in recordings.read_af_list(spark, f"{root}/af.txt").collect()] == ["PAT02"]
    assert recordings.long_form(recordings.read_device(spark, root).where("patient = 'PAT01'"), ["cecg", "ppg1"]).count() == 2 * 8960


def test_alignment_priority_and_fallthrough(spark, root):
    s = {r["patient"]: r for r in alignment.read_settings(spark, root).collect()}
    assert s["PAT01"]["source"] == "alignment.json" and s["PAT01"]["invert"]["cecg"] and s["PAT01"]["final_offset"] == 3
    assert s["PAT02"]["source"] == "polarity.json" and s["PAT02"]["invert"]["ppg1"] and s["PAT02"]["invert_gt"]
    files = [
        ("a", "offsets.json", json.dumps({"gt": {"flipped": True}, "global": {"start_sample": 256, "time_offset_samples": 7}, "signals": {"bcg1": {"flipped": True}}})),
        ("b", "offsets.json", json.dumps({"signals": {"cecg": {"start_sample": 128, "time_offset_samples": 4}}})),
        ("c", "offsets.txt", "3\n-9.0\n"),
        ("d", "offsets.txt", "x\ny\n"),
        ("e", "offsets.txt", "5"),
        ("c", "polarity.json", "nonsense"),
    ]
    got = {r["patient"]: r for r in alignment.resolve(spark.createDataFrame(files, "patient string, name string, content string")).collect()}
    assert (got["a"]["final_offset"], got["a"]["trim_start_s"], got["a"]["invert_gt"], got["a"]["invert"]["bcg1"]) == (7, 2.0, True, True)
    assert (got["b"]["final_offset"], got["b"]["trim_start_s"]) == (4, 1.0)
    assert (got["c"]["initial_offset"], got["c"]["final_offset"]) == (3, -9) and "d" not in got and got["e"]["final_offset"] == 0


def test_offset_correction(spark, root):
    raw = recordings.read_device(spark, root).where("patient <> 'PAT03'")
    got = {r["patient"]: r for r in alignment.offset_corrected(raw, alignment.read_settings(spark, root)).collect()}
    src = {r["patient"]: r for r in raw.collect()}
    want = dsp.correct_drift(-np.array(src["PAT01"]["cecg"]), 2, 3)
    assert np.allclose(got["PAT01"]["cecg"][:-128], want[:-128]) and got["PAT01"]["cecg"][-128:] == [None] * 128
    assert np.allclose(got["PAT02"]["ppg1"], -np.array(src["PAT02"]["ppg1"])) and np.allclose(got["PAT02"]["ppg2"], src["PAT02"]["ppg2"])


def test_offset_files(tmp_path):
    alignment.save_offsets(str(tmp_path), {"cecg": 5, "other": 1})
    assert alignment.load_offsets(str(tmp_path / "offsets_per_signal.json"))["cecg"] == 5 and "other" not in alignment.load_offsets(str(tmp_path / "offsets_per_signal.json"))
    assert (tmp_path / "offsets.txt").read_text() == "0\n5\n" and set(alignment.load_offsets(str(tmp_path / "none")).values()) == {0}


def test_extract_end_to_end(spark, root, tmp_path):
    cfg = E.ExtractConfig(data_root=root, af_list=f"{root}/af.txt")
    table = E.load_or_extract(spark, cfg, str(tmp_path))
    assert len(table.columns) == 191 and table.columns[:5] == ["patient", "AF", "win_idx", "t_start_s", "n_valid_hrv"]
    rows = {(r["patient"], r["win_idx"]): r for r in table.collect()}
    assert len(rows) == 6 and rows["PAT02", 0]["AF"] == 1 and rows["PAT01", 0]["AF"] == 0
    r = rows["PAT02", 1]
    assert abs(r["ppg1_freq_dominant"] - 1.2) < 0.05 and abs(r["ppg1_meanRR"] - 1 / 1.2) < 0.05 and r["sqi_ppg_xcorr"] < -0.9
    assert rows["PAT01", 2]["ppg1_mean"] is not None  # 60 s end before the trimmed second
    again = E.load_or_extract(spark, cfg, str(tmp_path))
    assert again.count() == 6 and cache.newest(spark, f"{tmp_path}/features_sig=*/*.parquet").endswith(".parquet")


def test_reliability_and_reference_quality(spark, root):
    cfg = E.ExtractConfig(data_root=root)
    recs = E.prepared(spark, cfg).join(recordings.read_reference(spark, root), "patient")
    w = WN.aligned_windows(recs, 128, 500, 30, 15, list(E.SIGNALS), "gt").cache()
    assert w.count() == 6 and all(r["n"] == 15_000 for r in w.select(F.size("gt").alias("n")).collect())
    rel = E.reliability(w, 128, 500).collect()
    assert len(rel) == 6 and "rel_ppg_target" in rel[0].asDict() and any(r["rel_ppg_valid"] for r in rel)
    q = {(r["patient"], r["win_idx"]): r for r in E.reference_quality(w, 500).collect()}
    assert q["PAT01", 0]["gt_conf"] > 0.9
    g = {(r["patient"], r["win_idx"]): r for r in E.reference_windows(recs, 500).collect()}
    assert len(g) == 4 and g["PAT01", 0]["label"] == 0 and g["PAT02", 0]["label"] == 1


def test_cache_signature(spark):
    a, b = {"fs": 128, "path": "x"}, {"path": "x", "fs": 128}
    assert cache.signature(a) == cache.signature(b) != cache.signature(a | {"fs": 64})
    df = spark.createDataFrame([(1, 2.0), (2, 3.0)], "a int, b double")
    assert cache.table_signature(df, ["a", "b"]) == cache.table_signature(df.orderBy(F.col("a").desc()), ["a", "b"]) != cache.table_signature(df.limit(1), ["a", "b"])
    with pytest.raises(ValueError):
        cache.verify("a", "b")


def test_auto_flip(spark):
    df = spark.createDataFrame([([-9.0, 1.0, 1.0, 2.0],), ([9.0, 1.0, 1.0, 2.0],)], "cecg array<double>")
    got = [r["cecg"] for r in recordings.auto_flipped(df).collect()]
    assert got == [[9.0, -1.0, -1.0, -2.0], [9.0, 1.0, 1.0, 2.0]]


# Streams


def test_windowed_stream_equals_batch(spark, tmp_path):
    ev = jobs.event_stream(spark, "/root/testdata/sf0.001")
    got = jobs.run_available(jobs.windowed(ev), "win_stream", str(tmp_path / "c1"), "complete")
    want = spark.read.parquet("/root/testdata/sf0.001/events.parquet").groupBy("user_id", F.window(F.col("ts").cast("timestamp"), "1 day")).count()
    assert {(r["patient"], r["win_start"]): r["n"] for r in got.collect()} == {(r["user_id"], r["window"]["start"]): r["count"] for r in want.collect()}


def test_alarm_stream_equals_batch(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("user_id").alias("patient"), F.col("ts").cast("timestamp").alias("win_start"), (F.col("event_id") * 48271 % 2147483647 / 2147483647.0).alias("score"))
    # Several files in order of time, one micro-batch each.
    cuts = [r[0] for r in src.selectExpr("percentile_approx(unix_micros(win_start), array(0.33, 0.66)) a").select(F.explode("a")).collect()]
    edges = [-(2**62), *cuts, 2**62]
    for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        src.where(F.unix_micros("win_start").between(a + 1, b)).coalesce(1).write.parquet(str(tmp_path / f"in/b{i}"))
    stream = spark.readStream.schema(src.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").parquet(str(tmp_path / "in"))
    got = jobs.run_available(jobs.alarms(stream, 0.5), "alarm_stream", str(tmp_path / "c2"))
    batch = WN.k_of_m(src, F.col("score") >= 0.5, order="win_start")
    want = {(r["patient"], r["win_start"]): (r["hits"], r["alarm"]) for r in batch.collect()}
    assert {(r["patient"], r["win_start"]): (r["hits"], r["alarm"]) for r in got.collect()} == want
    first = {r["patient"]: r["first_alarm"] for r in WN.alarm_report(batch.withColumn("y", F.lit(1)), "y", "win_start").collect()}
    assert {r["patient"]: r["f"] for r in got.groupBy("patient").agg(F.max("first_alarm").alias("f")).collect()} == first

"""Windows filtered, drifted and cut in parts have the features of those of whole recordings."""

from __future__ import annotations

import json

import numpy as np
import pytest

from pulsegrid.functions import dsp
from pulsegrid.operators import extract as E
from pulsegrid.sources import alignment
from pulsegrid.sources import recordings as R


def files(root, patient: str, n: int, settings: dict | None = None, bad: int | None = None) -> None:
    rng = np.random.default_rng(n)
    (root / patient / "Signals").mkdir(parents=True)
    t = np.arange(n) / 128
    rows = np.zeros((n, 26))
    for i in R.CHANNEL_AT.values():
        rows[:, i] = 5 + np.sin(2 * np.pi * (1 + i / 40) * t) + 0.3 * rng.normal(size=n)
    lines = [",".join(f"{v:.6f}" for v in r) for r in rows]
    if bad is not None:
        lines[bad] = lines[bad].replace(",", ",x", 1)
    (root / patient / "Signals/New_Data.csv").write_text("\n".join([",".join(f"c{i}" for i in range(26)), *lines]) + "\n")
    if settings is not None:
        (root / patient / "alignment.json").write_text(json.dumps(settings))


def test_parts_equal_whole_recordings(spark, tmp_path, monkeypatch):
    """Several parts of a recording, one with flips, drift and trim, one too short, one with a value that is no number, one whose first windows drift out of it."""
    files(tmp_path, "PAT1", 24_000)
    files(tmp_path, "PAT2", 22_345, {"invert": {"ppg1": True}, "initial_offset": 17, "final_offset": -40, "trim_start_s": 1.5, "trim_end_s": 2.0})
    files(tmp_path, "PAT3", 3_000)
    files(tmp_path, "PAT4", 9_000, bad=7_000)
    files(tmp_path, "PAT5", 16_000, {"initial_offset": 9_000, "final_offset": 9_001})
    cfg = E.ExtractConfig(data_root=str(tmp_path))
    want = {(r["patient"], r["win_idx"]): r.asDict() for r in E.extract(E.five_windows(E.prepared(spark, cfg), cfg), cfg).collect()}
    monkeypatch.setattr(E, "PART", 2)
    monkeypatch.setattr(E, "PIECE", 1000)
    monkeypatch.setattr(R, "gathered", lambda *a: pytest.fail("a recording became a row"))
    device = R.placed(R.device_rows(spark, str(tmp_path)))
    table = E.extract_samples(device, alignment.read_settings(spark, str(tmp_path), cfg.fs), cfg)
    got = {(r["patient"], r["win_idx"]): r.asDict() for r in table.collect()}
    assert set(got) == set(want) and {p for p, _ in got} == {"PAT1", "PAT2", "PAT5"} and len(got) > 20
    for k, w in want.items():
        assert list(got[k]) == list(w)
        for c, v in w.items():
            assert got[k][c] == v if v is None or isinstance(v, str) else got[k][c] == pytest.approx(v, rel=1e-6, abs=1e-9), (k, c)


@pytest.mark.parametrize(("initial", "final"), [(0, 0), (3, 7), (-5, 20), (60, -60), (300, 0), (-300, -300)])
def test_drift_of_a_part(initial, final):
    x = np.random.default_rng(1).normal(size=200)
    want = dsp.correct_drift(x, initial, final)
    for a, b in ((0, 200), (0, 50), (70, 120), (150, 200)):
        assert np.allclose(dsp.correct_drift_part(x, 0, 200, initial, final, np.arange(a, b)), want[a:b], atol=1e-12)

"""Packets leave the decoder in batches of a bounded size, whatever a blob holds."""

from __future__ import annotations

import struct

from pulsegrid.sources import packets as P


def test_a_large_blob_is_decoded_in_parts(spark, monkeypatch):
    frames = [bytes(struct.pack("<Q", 1 + i).ljust(81, b"\0")) for i in range(2 * 8192 + 5)]
    df = spark.createDataFrame([("a", b"".join(frames)), ("b", None), ("c", frames[3] + b"x")], "path string, content binary").repartition(1)
    runs = []
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema: runs.append(run) or self)
    P.decoded(df, realtime=True)
    import pyarrow as pa

    table = pa.table({"path": ["a", "b", "c"], "content": pa.array([b"".join(frames), None, frames[3] + b"x"], pa.binary())})
    got = list(runs[0](iter(table.to_batches())))
    assert max(b.num_rows for b in got) <= 8192
    times = [(r["path"], r["time"]) for b in got for r in b.select(["path", "time"]).to_pylist()]
    assert times == [*[("a", 1.0 + i) for i in range(len(frames))], ("c", 4.0)]

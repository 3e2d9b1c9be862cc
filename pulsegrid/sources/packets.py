"""Device packet streams: delimited files and fixed real-time frames, decoded in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The wire format.
DELIMITER, ESCAPE, ESCAPED_ESCAPE, ESCAPED_DELIMITER = 0x7E, 0x7D, 0x5D, 0x5E
MIN_FRAME, REALTIME_FRAME, NEEDED = 76, 81, 75
PPG_AT, MI_AT, SCG_AT, ECG_SCALE = (28, 44, 60, 30), (40, 42, 44, 46), (48, 54, 60, 66), 4800 / 2**24

#: Frames of a blob that are decoded at a time.
FRAMES = 8192

NUMBERS = ["time", *[f"{s}{i}" for s in ("ecg", "ppg", "mi") for i in range(1, 5)]]
PACKET = ", ".join(f"{n} double" for n in NUMBERS) + ", " + ", ".join(f"scg{i} struct<x smallint, y smallint, z smallint>" for i in range(1, 5)) + ", bufFillState double"


def unescape(raw: bytes) -> bytes:
    """Replace escape pairs. Bytes 7D that begin no pair move all later replacements back by one place, as the device's decoder
    does: positions in the result count every 7D before as removed."""
    out = bytearray(raw)
    marks = [j for j, b in enumerate(raw) if b == ESCAPE]
    for before, j in enumerate(marks):
        follows = raw[j + 1] if j + 1 < len(raw) else None
        if follows in (ESCAPED_ESCAPE, ESCAPED_DELIMITER):
            at = j - before
            if follows == ESCAPED_DELIMITER:
                out[at] = DELIMITER
            del out[at + 1 : at + 2]
    return bytes(out)


def kept_frames(data: bytes) -> list[bytes]:
    """Delimited frames whose raw bytes are long enough and have zeros at 6 and 7; unescaped. Frames that are too short once
    unescaped are dropped."""
    raw = [f for f in data.split(bytes([DELIMITER])) if len(f) > MIN_FRAME and f[6:8] == b"\0\0"]
    return [f[:NEEDED] for f in map(unescape, raw) if len(f) >= NEEDED]


def realtime_frames(data: bytes) -> list[bytes]:
    """Frames of a fixed size; bytes after the last whole one are dropped."""
    raw = [data[i : i + REALTIME_FRAME] for i in range(0, len(data) // REALTIME_FRAME * REALTIME_FRAME, REALTIME_FRAME)]
    return [f[:NEEDED] for f in map(unescape, [f for f in raw if f[6:8] == b"\0\0"]) if len(f) >= NEEDED]


def decode(frames: list[bytes]) -> dict[str, np.ndarray]:
    """Fields of all frames as arrays, by typed views of one byte matrix; packets without a time are dropped."""
    m = np.frombuffer(b"".join(frames), np.uint8).reshape(-1, NEEDED)
    view = lambda at, n, kind: np.ascontiguousarray(m[:, at : at + n]).view(kind)
    out = {"time": view(0, 8, "<u8")[:, 0].astype(float) + view(72, 2, "<u2")[:, 0] / 1000}
    ecg = view(8, 16, "<i4") * ECG_SCALE
    out |= {f"ecg{i + 1}": ecg[:, i] for i in range(4)}
    out |= {f"ppg{i + 1}": view(at, 2, "<u2")[:, 0].astype(float) for i, at in enumerate(PPG_AT)}
    out |= {f"mi{i + 1}": view(at, 2, "<u2")[:, 0].astype(float) for i, at in enumerate(MI_AT)}
    out |= {f"scg{i + 1}": view(at, 6, "<i2") for i, at in enumerate(SCG_AT)}
    out["bufFillState"] = m[:, 74].astype(float)
    keep = out["time"] != 0
    return {k: v[keep] for k, v in out.items()}


def as_batch(key: list[str], fields: dict[str, np.ndarray]) -> pa.RecordBatch:
    columns, names = [pa.array(key, pa.string())], ["path"]
    for k, v in fields.items():
        names.append(k)
        if v.ndim == 2:
            columns.append(pa.StructArray.from_arrays([pa.array(v[:, j], pa.int16()) for j in range(3)], list("xyz")))
        else:
            columns.append(pa.array(v, pa.float64()))
    return pa.RecordBatch.from_arrays(columns, names)


def decoded(blobs: DataFrame, path: str = "path", content: str = "content", realtime: bool = False) -> DataFrame:
    """(path, packet fields) of a table of binary blobs. Works on static tables and on streams: no state is kept."""
    frames = realtime_frames if realtime else kept_frames

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, data in zip(b.column(0), b.column(1), strict=True):  # one blob is in Python's hands at a time
                found, name = frames(data.as_py() or b""), p.as_py()
                for i in range(0, len(found), FRAMES):
                    fields = decode(found[i : i + FRAMES])
                    yield as_batch([name] * len(fields["time"]), fields)

    return blobs.select(path, content).mapInArrow(run, f"path string, {PACKET}")


def read_packet_files(spark: SparkSession, path: str) -> DataFrame:
    """Packets of all files under a path; one file is one task at most, as frames have no index."""
    return decoded(spark.read.format("binaryFile").load(path))


def read_realtime(blobs: DataFrame, content: str = "content", path: str = "path") -> DataFrame:
    """Fixed frames; of the motion sensors only the z axis."""
    d = decoded(blobs, path, content, realtime=True)
    return d.withColumns({f"scg{i}": F.col(f"scg{i}.z") for i in range(1, 5)})


def flat(packets: DataFrame) -> DataFrame:
    """The export columns, motion flattened."""
    axes: list[Column] = [F.col(f"scg{i}.{a}").alias(f"scg{i}_{a}") for i in range(1, 5) for a in "xyz"]
    return packets.select(*NUMBERS, *axes, "bufFillState")


def write_packet_csv(packets: DataFrame, path: str) -> None:
    flat(packets).write.mode("overwrite").csv(path, header=True)

"""Streaming twins of the batch operators: event windows with a watermark, the stateful K-of-M alarm, the real-time decoder."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pulsegrid.sources.packets import read_realtime

EPISODE = "patient long, win_start timestamp, score double, hits int, alarm boolean, episode_start timestamp, first_alarm timestamp"
ALARM = "patient long, win_start timestamp, score double, hits int, alarm boolean, first_alarm timestamp"


def event_stream(spark: SparkSession, folder: str, files: str = "events.parquet", per_trigger: int = 1) -> DataFrame:
    """The event table as a stream with ``ts`` as a timestamp (UTC)."""
    schema = spark.read.parquet(f"{folder}/{files.replace('*', '')}").schema if "*" not in files else spark.read.parquet(folder).schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", files).option("maxFilesPerTrigger", per_trigger).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, size: str = "1 day", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Count and mean value of each user's event windows. Events later than the watermark are dropped (an extension: the
    batch form has no event time)."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    g = events.withWatermark("ts", late).groupBy(w.alias("w"), "user_id")
    return g.agg(F.count("*").alias("n"), F.avg("value").alias("mean_value")).select(F.col("user_id").alias("patient"), F.col("w.start").alias("win_start"), "n", "mean_value")


def alarms(scores: DataFrame, threshold: float, k: int = 2, m: int = 3) -> DataFrame:
    """Per scored window of (patient, win_start, score): hits among the patient's last m windows, the alarm, and when it first rose.

    State: the last m - 1 flags and the first alarm's time, as large for a patient with any history. Windows of one
    micro-batch are taken in order of time; the source delivers windows in that order between batches."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        past, first = state.get if state.exists else ([], None)
        past, rows = list(past), []
        for r in pd.concat(list(frames)).sort_values("win_start").itertuples():
            past = [*past, int(r.score >= threshold)][-m:]
            alarm = sum(past) >= k
            if alarm and first is None:
                first = r.win_start.to_pydatetime()
            rows.append((key[0], r.win_start, float(r.score), sum(past), alarm, first))
        state.update((past, first))
        yield pd.DataFrame(rows, columns=["patient", "win_start", "score", "hits", "alarm", "first_alarm"])

    return scores.groupBy("patient").applyInPandasWithState(step, ALARM, "past array<int>, first timestamp", "append", GroupStateTimeout.NoTimeout)


class Episodes(StatefulProcessor):
    """The K-of-M alarm of one patient with a memory that ends: after ``horizon_ms`` without a window the history is forgotten, and the next window
    begins a new episode. State: the last m - 1 flags, the episode's start, its first alarm and last window. A timer clears it once the
    watermark has passed the horizon; whether it has or not, a window beyond the horizon begins anew, so results don't depend on when timers run."""

    def __init__(self, threshold: float, k: int, m: int, horizon_ms: int):
        self.threshold, self.k, self.m, self.horizon_ms = threshold, k, m, horizon_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.history = handle.getValueState("history", "flags array<int>, start timestamp, first timestamp, last_ms bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        past, start, first, last = self.history.get() if self.history.exists() else ([], None, None, None)
        past, out = list(past), []
        for r in pd.concat(list(rows)).sort_values("win_start").itertuples():
            now: datetime = r.win_start.to_pydatetime()
            if last is None or r.at_ms - last > self.horizon_ms:
                past, start, first = [], now, None
            past, last = [*past, int(not math.isnan(r.score) and r.score >= self.threshold)][-self.m :], int(r.at_ms)
            alarm = sum(past) >= self.k
            first = now if alarm and first is None else first
            out.append((key[0], now, None if math.isnan(r.score) else r.score, sum(past), alarm, start, first))
        self.history.update((past, start, first, last))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(last + self.horizon_ms + 1)
        yield pd.DataFrame(out, columns=["patient", "win_start", "score", "hits", "alarm", "episode_start", "first_alarm"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.history.clear()
        yield from ()

    def close(self) -> None:
        pass


def alarm_episodes(scores: DataFrame, threshold: float, k: int = 2, m: int = 3, horizon_s: float = 7 * 86400) -> DataFrame:
    """Per scored window of (patient, win_start, score) with a watermark: hits among the patient's last m windows of the episode, the alarm, when the episode
    began and when the alarm first rose in it. A missing score is no hit. Windows must come in order of time between batches, as closed windows do.

    Needs the RocksDB state store (``state_store``)."""
    timed = scores.select("patient", "win_start", F.col("score").cast("double").alias("score"), F.unix_millis("win_start").alias("at_ms"))
    return timed.groupBy("patient").transformWithStateInPandas(Episodes(threshold, k, m, int(horizon_s * 1000)), EPISODE, "append", "EventTime")


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB; the session's setting is put back afterwards."""
    key, before = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def realtime_packets(spark: SparkSession, folder: str, files: str = "*.bin") -> DataFrame:
    """Packets of arriving binary chunks; no state."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return read_realtime(spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", files).load(folder))


def into_files(df: DataFrame, path: str, checkpoint: str, partition_by: Sequence[str] = ()):
    """Run an appending stream over all that is there into Parquet files; the ended query. What a batch wrote counts once its commit is in the sink's log,
    so a run that was cut off is taken up again from the checkpoint and leaves neither gaps nor repeats."""
    writer = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    q = (writer.partitionBy(*partition_by) if partition_by else writer).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def run_available(df: DataFrame, table: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run over all that is there, into files beside the checkpoint, read back; in complete mode each batch replaces what was there."""
    path = f"{checkpoint.rstrip('/')}-{table}"
    if mode == "append":
        into_files(df, path, checkpoint)
    else:
        q = df.writeStream.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path)).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)

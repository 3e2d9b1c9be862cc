"""Job 1: the alarm feed of monitored patients, from event files as they arrive.

    python -m jobs.alarm_feed --source in/events.parquet --target out/alarms --checkpoint out/state [--config mine.json]

Each run takes the files of ``source`` that no earlier run has taken (a file stream with a checkpoint), gathers each patient's events into tumbling
windows, and publishes every window once it is closed: the watermark, the latest event time less ``late``, has passed its end. A published
window has its mean value, how many of the patient's last m windows reached ``threshold``, whether these are k or more (the alarm), when the episode
began (a patient without a window for ``horizon_s`` seconds starts anew) and when its alarm first rose. Windows are appended to Parquet partitioned by day.

Events without a patient or a time are left out; those later than the watermark are dropped and counted in the log. Missing values don't enter
a mean; a window of missing values alone is published and is no hit. A run over nothing new publishes nothing.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import command_line, settings
from pulsegrid.streaming import jobs as streams

LOG = logging.getLogger("jobs.alarm_feed")


def published(spark: SparkSession, target: str) -> DataFrame:
    """All windows that are published so far."""
    return spark.read.schema(f"{streams.EPISODE}, day date").parquet(target)


def alarm_feed(spark: SparkSession, source: str, target: str, checkpoint: str, config: str | None = None) -> dict:
    """One run; how many rows were read, dropped as late and kept in the state, and what is published by now."""
    c, source = settings(spark, config, __file__), source.rstrip("/")
    stream = spark.readStream.schema(spark.read.parquet(source).schema)
    if c["files_per_batch"]:
        stream = stream.option("maxFilesPerTrigger", c["files_per_batch"])
    # As a pattern that only the source matches: a stream takes a folder or a pattern, and the source may be a single file.
    events = stream.parquet(f"{source[:-1]}[{source[-1]}]")
    events = events.select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("double").alias("value")).where("user_id IS NOT NULL AND ts IS NOT NULL")
    windows = streams.windowed(events, c["window"], late=c["late"]).select("patient", "win_start", F.col("mean_value").alias("score"))
    with streams.state_store(spark):
        out = streams.alarm_episodes(windows, c["threshold"], c["k"], c["m"], c["horizon_s"]).withColumn("day", F.to_date("win_start"))
        q = streams.into_files(out, target, checkpoint, ["day"])
    said = {"read": 0, "late": 0}
    for p in q.recentProgress:
        said["read"] += p["numInputRows"]
        said["late"] += sum(int(s["numRowsDroppedByWatermark"]) for s in p["stateOperators"])
        LOG.info("batch %s: %s rows read, watermark %s", p["batchId"], p["numInputRows"], p["eventTime"].get("watermark"))
    now = published(spark, target).agg(F.count("*").alias("windows"), F.count_if("alarm").alias("alarms")).first()
    said |= {"windows": now["windows"], "alarms": now["alarms"]}
    LOG.info("read %(read)d new rows of %(source)s, %(late)d late; %(target)s has %(windows)d windows, %(alarms)d of them alarms", said | {"source": source, "target": target})
    return said


if __name__ == "__main__":
    command_line("alarm_feed", __doc__, ["source", "target", "checkpoint"], alarm_feed)

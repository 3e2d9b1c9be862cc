"""Result caches as Parquet under a signature of everything that shapes the result."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def signature(settings: dict, length: int = 16) -> str:
    """sha1 over the settings with sorted keys: detectors, flags, window and hop, rate, input paths and label file alike."""
    return hashlib.sha1(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()[:length]


def table_signature(df: DataFrame, columns: list[str], length: int = 16) -> str:
    """Of a table's content, whatever the order of its rows: a sum of row hashes, their number, and the column names."""
    h = F.xxhash64(*columns)
    r = df.agg(F.sum(h.cast("decimal(38,0)")).alias("s"), F.count("*").alias("n")).first()
    return signature({"columns": columns, "s": str(r["s"]), "n": r["n"]}, length)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def load_or_make(spark: SparkSession, folder: str, name: str, settings: dict, make: Callable[[], DataFrame], force: bool = False, partition_by: str | None = None) -> DataFrame:
    """The table of these settings, made and written first if it isn't there."""
    path = f"{folder.rstrip('/')}/{name}_sig={signature(settings)}"
    if force or not exists(spark, path):
        w = make().write.mode("overwrite")
        (w.partitionBy(partition_by) if partition_by else w).parquet(path)
    return spark.read.parquet(path)


def verify(expected: str, actual: str) -> None:
    """A cache made from other data is an error, not a silent miss."""
    if expected != actual:
        raise ValueError(f"the cache belongs to other data: {expected} is not {actual}")


def folder(spark: SparkSession) -> str:
    """A new path that driver and executors share, for what shall stay: inside ``spark.checkpoint.dir`` or the context's checkpoint
    folder; only a single machine without either takes its own temporary folder."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="pulsegrid-")
    return f"{root.rstrip('/')}/pulsegrid/{uuid.uuid4().hex}"


def scratch(spark: SparkSession) -> str:
    """A new folder as ``folder`` gives, gone when the session's JVM ends."""
    path = folder(spark)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return path


def leaf(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1]


def newest(spark: SparkSession, pattern: str) -> str:
    """The path last modified among those that match; ties to the greater path."""
    r = spark.read.format("binaryFile").load(pattern).agg(F.max_by("path", F.struct("modificationTime", "path")).alias("p")).first()
    return r["p"]


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_parameters(path: str, parameters: dict) -> None:
    """Tuned parameters, a small file written by the driver right after tuning."""
    with open(path, "w", encoding="utf-8") as f:
        json.dump(parameters, f, indent=2, sort_keys=True)


def read_parameters(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)

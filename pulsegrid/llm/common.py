"""Helpers shared by the text operators: tables in the shared folder, free column names, the learning folds."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"
BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"

#: Learning rows are those whose crc32 of the id, written as text, has a remainder other than 0.
FOLDS = 5


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``, or the context's checkpoint folder.

    Only a single-machine session without either gets a temporary folder, made once and remembered; on a cluster that is an error.
    """
    sc = spark.sparkContext
    folder = spark.conf.get(CHECKPOINT_KEY, None) or sc.getConf().get(CHECKPOINT_KEY) or sc.getCheckpointDir()
    if folder:
        return folder
    if not sc.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that the driver and all executors share")
    if not hasattr(sc, "_pulsegrid_folder"):
        sc._pulsegrid_folder = "file://" + tempfile.mkdtemp(prefix="pulsegrid-")
    return sc._pulsegrid_folder


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def written(df: DataFrame, name: str, instead_of: DataFrame | None = None) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back: later steps have no lineage
    behind them, so an executor lost afterwards costs no more than one read.

    ``instead_of``: a former result of ``written`` that nothing reads any longer; its files go. All others go when the session's JVM ends."""
    spark = df.sparkSession
    root = f"{shared_folder(spark).rstrip('/')}/pulsegrid/{spark.sparkContext.applicationId}"
    path = f"{root}/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    fs, p = _files(spark, root)
    fs.deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out._pulsegrid_path = path
    if instead_of is not None:
        forget(instead_of)
    return out


def forget(table: DataFrame) -> None:
    """Delete the files of a result of ``written`` that nothing reads any longer."""
    fs, p = _files(table.sparkSession, table._pulsegrid_path)
    fs.delete(p, True)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Inside, what runs at once hands at most ``rows`` rows to Python at a time, so that whole texts take little memory beside the JVM;
    afterwards the session's setting is as it was."""
    before = spark.conf.get(BATCH_KEY)
    if int(before) > rows:
        spark.conf.set(BATCH_KEY, str(rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH_KEY, before)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores behind it until ``df`` has no such column (case doesn't count)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_results(docs: DataFrame, result: Column, names: Sequence[str]) -> DataFrame:
    """``docs`` with the fields ``names`` of the struct column ``result``; columns of these names (case doesn't count) are replaced,
    all others stay, whatever they are called."""
    at = fresh(docs, "result")
    new = {n.lower() for n in names}
    kept = [F.col(quoted(c)) for c in docs.columns if c.lower() not in new]
    return docs.withColumn(at, result).select(*kept, *[F.col(at)[n].alias(n) for n in names])


#: Copies of a row that one task makes at a time.
COPIES = 1 << 16


def copies(alike: DataFrame, times: str, number: str) -> DataFrame:
    """Each row as often as its column ``times`` says, numbered from 0 by ``number``. A row of many copies is first dealt out in ranges of
    COPIES to all tasks, so that the commonest row of a table is no single task's work."""
    n = F.col(times)
    few = alike.where(n <= COPIES).withColumn(number, F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    at = fresh(alike, "range")
    many = alike.where(n > COPIES).withColumn(at, F.explode(F.sequence(F.lit(0).cast("long"), n - 1, F.lit(COPIES).cast("long")))).repartition(at, *alike.columns)
    last = F.least(F.col(at) + COPIES, n) - 1
    many = many.withColumn(number, F.explode(F.sequence(F.col(at), last))).drop(at)
    return few.unionByName(many)


def fold(doc_id: str) -> Column:
    """crc32 of the id as text, modulo FOLDS; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % FOLDS


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")

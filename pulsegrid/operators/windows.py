"""Windows over recordings and events, neighbour context, and the K-of-M alarm."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions import native
from pulsegrid.operators.metrics import quantiles


def micros(ts: str) -> Column:
    """Microseconds since the epoch; a time without zone counts as UTC."""
    return F.unix_micros(F.col(ts).cast("timestamp"))


def index_windows(recordings: DataFrame, size: int, hop: int, samples: str = "samples", fs: float = 1.0) -> DataFrame:
    """One row for each complete window of each recording: win_idx, t_start_s and the window's samples. Narrow: no shuffle."""
    rest = [c for c in recordings.columns if c != samples]
    w = recordings.select(*rest, F.explode(native.windows_of(F.col(samples), size, hop)).alias("w"))
    return w.select(*rest, F.col("w.win_idx").alias("win_idx"), (F.col("w.win_idx") * hop / fs).alias("t_start_s"), F.col("w.samples").alias(samples))


def aligned_windows(recordings: DataFrame, fs: int, fs_ref: int, window_s: float, hop_s: float, channels: Sequence[str], reference: str) -> DataFrame:
    """Windows of several channels beside the reference slice that starts at start * fs_ref // fs; the windows end where the
    reference is too short."""
    size, hop, ref_size = int(window_s * fs), int(hop_s * fs), int(window_s * fs_ref)
    rest = [c for c in recordings.columns if c not in (*channels, reference)]
    n = F.floor((F.least(*[F.size(c) for c in channels]) - size) / hop) if len(channels) > 1 else F.floor((F.size(channels[0]) - size) / hop)
    w = recordings.where(n >= 0).select(*rest, *channels, reference, F.explode(F.sequence(F.lit(0), n.cast("int"))).alias("win_idx"))
    at = F.floor(F.col("win_idx") * hop * fs_ref / fs).cast("int")
    out = w.where(at + ref_size <= F.size(reference))
    return out.select(*rest, "win_idx", (F.col("win_idx") * hop / fs).alias("t_start_s"), *[F.slice(c, F.col("win_idx") * hop + 1, F.lit(size)).alias(c) for c in channels], F.slice(reference, at + 1, F.lit(ref_size)).alias(reference))


def sample_windows(samples: DataFrame, columns: Sequence[str], size: int, hop: int, ratio: tuple[int, int] = (1, 1)) -> DataFrame:
    """(patient, win_idx, columns as arrays) of every complete window of rows (patient, n, total, columns) for samples: window i begins at i * hop * ratio, rounded
    down. A sample goes to its windows, so no recording meets in one task; a window does."""
    up, down = ratio
    begin = lambda i: F.floor(i * (hop * up) / down)
    n = F.col("n")
    low = F.greatest(F.floor((n - size) * down / (hop * up)) - 1, F.lit(0))
    near = F.filter(F.sequence(low, F.greatest(F.floor(n * down / (hop * up)) + 1, low)), lambda i: (begin(i) <= n) & (n < begin(i) + size) & (begin(i) + size <= F.col("total")))
    x = samples.select("patient", F.explode(near).alias("win_idx"), F.struct("n", *columns).alias("s"))
    w = x.groupBy("patient", "win_idx").agg(F.array_sort(F.collect_list("s")).alias("s"))
    return w.select("patient", F.col("win_idx").cast("int").alias("win_idx"), *[F.col(f"s.{c}").alias(c) for c in columns])


def aligned_sample_windows(device: DataFrame, reference: DataFrame, fs: int, fs_ref: int, window_s: float, hop_s: float, channels: Sequence[str], gt: str) -> DataFrame:
    """As ``aligned_windows``, of rows (patient, n, total, channels) for samples of both tables: patient, win_idx, t_start_s, channels, reference."""
    size, hop, ref_size = int(window_s * fs), int(hop_s * fs), int(window_s * fs_ref)
    a = sample_windows(device, channels, size, hop)
    b = sample_windows(reference, [gt], ref_size, hop, (fs_ref, fs))
    return a.join(b, ["patient", "win_idx"]).select("patient", "win_idx", (F.col("win_idx") * hop / fs).alias("t_start_s"), *channels, gt)


def event_windows(events: DataFrame, keys: Sequence[str], size: str, slide: str | None = None, ts: str = "ts") -> DataFrame:
    """``events`` with win_start, one row for each window that holds the event (epoch-aligned; slide None: tumbling)."""
    w = F.window(F.col(ts).cast("timestamp"), size, slide) if slide else F.window(F.col(ts).cast("timestamp"), size)
    return events.withColumn("_w", w).withColumn("win_start", F.col("_w.start")).drop("_w")


def neighbor_context(df: DataFrame, columns: Sequence[str], k: int, key: str = "patient", order: str = "win_idx") -> DataFrame:
    """Each column's values 1 to k windows before and after, inside its patient; at the edges the row's own value."""
    w = Window.partitionBy(key).orderBy(order)
    new = {}
    for c in columns:
        for i in range(1, k + 1):
            new[f"{c}_prev{i}"] = F.coalesce(F.lag(c, i).over(w), F.col(c))
            new[f"{c}_next{i}"] = F.coalesce(F.lead(c, i).over(w), F.col(c))
    return df.withColumns(new)


def k_of_m(df: DataFrame, flag: Column, k: int = 2, m: int = 3, key: str = "patient", order: str = "win_idx") -> DataFrame:
    """``df`` with hits (flags among the last m windows, fewer at the start) and alarm (hits >= k)."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-(m - 1), Window.currentRow)
    return df.withColumn("hits", F.sum(F.coalesce(flag.cast("int"), F.lit(0))).over(w)).withColumn("alarm", F.col("hits") >= k)


def alarm_report(df: DataFrame, label: str, time: str, key: str = "patient") -> DataFrame:
    """Per patient: label, the time of its first alarm (null: none) and whether there was one."""
    return df.groupBy(key).agg(F.max(label).alias("y"), F.min(F.when(F.col("alarm"), F.col(time))).alias("first_alarm")).withColumn("flagged", F.col("first_alarm").isNotNull())


def alarm_summary(report: DataFrame) -> DataFrame:
    """Detection rate and median latency among positives, false alarms among controls."""
    pos = F.col("y") == 1
    rates = report.agg(F.avg(F.when(pos, F.col("flagged").cast("double"))).alias("detection"), F.count_if(~pos & F.col("flagged")).alias("false_alarms"), F.count_if(~pos).alias("controls"))
    late = quantiles(report.where(pos), "first_alarm", [0.5]).agg(F.max("value").alias("median_latency"))
    return rates.crossJoin(F.broadcast(late)).select("detection", "median_latency", "false_alarms", "controls")  # one row each


def evenly_spread(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """At most n rows of each key, at the rounded places of an even grid from the first to the last."""
    w = Window.partitionBy(key)
    x = df.withColumn("_r", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count("*").over(w))
    at = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * (F.col("_n") - 1) / max(1, n - 1)).cast("int")))
    return x.where(F.array_contains(at, F.col("_r"))).drop("_r", "_n")

"""Isotonic calibration of whole tables: pooled blocks from range partitions, merged in the order of scores, and scores read off between them.

Rows that violate the order inside a range are pooled inside every range that holds this one, so each partition pools its own scores as a stream, and one stream
over the blocks that are left finishes the key. A block's mean is a ratio of counts that is unlike all others', so of N rows a key keeps some N^(2/3) blocks at most.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.operators.metrics import with_bins


def pooled(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Blocks (keys, low, high, n, s) of sorted partitions with neighbours of one key merged while their means don't rise."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[tuple] = []
        key: tuple | None = None

        def out(k: tuple | None) -> pa.RecordBatch:
            low, high, n, s = zip(*stack, strict=True) if stack else ((), (), (), ())
            ids = [pa.array([v] * len(stack), kinds.field(c).type) for c, v in zip(keys, k or (None,) * len(keys), strict=True)]
            return pa.RecordBatch.from_arrays([*ids, *[pa.array(x, pa.float64()) for x in (low, high, n, s)]], [*keys, "low", "high", "n", "s"])

        for b in batches:
            kinds = b.schema
            ids = list(zip(*[b[c].to_pylist() for c in keys], strict=True)) if keys else [()] * b.num_rows
            for k, low, high, n, s in zip(ids, *[b[c].to_pylist() for c in ("low", "high", "n", "s")], strict=True):
                if key is not None and k != key:
                    yield out(key)
                    stack.clear()
                key = k
                stack.append((low, high, n, s))
                while len(stack) > 1 and stack[-2][3] * stack[-1][2] >= stack[-1][3] * stack[-2][2]:
                    _, h, n2, s2 = stack.pop()
                    l1, _, n1, s1 = stack.pop()
                    stack.append((l1, h, n1 + n2, s1 + s2))
        if key is not None:
            yield out(key)

    return blocks.mapInArrow(stream, blocks.schema)


def isotonic(df: DataFrame, score: str, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, low, high, value): for each key the isotonic regression of the label on the score, a row for each constant stretch. Rows without a score or a label
    are left out; a null key is a key. One key may hold the whole table."""
    keys = list(keys)
    one = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*keys, F.col(score).cast("double").alias("low"))
    d = one.agg(F.count("*").cast("double").alias("n"), F.sum(F.col(label).cast("double")).alias("s")).select(*keys, "low", F.col("low").alias("high"), "n", "s")
    local = pooled(d.repartitionByRange(*keys, "low").sortWithinPartitions(*keys, "low"), keys)
    whole = local.repartition(*keys) if keys else local.repartition(1)  # blocks only
    return pooled(whole.sortWithinPartitions(*keys, "low"), keys).select(*keys, "low", "high", (F.col("s") / F.col("n")).alias("value"))


def same_keys(a: str, b: str, keys: Sequence[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return out


def calibrated(df: DataFrame, score: str, steps: DataFrame, keys: Sequence[str] = (), name: str = "calibrated") -> DataFrame:
    """``df`` with ``name``: the value of ``steps`` (of ``isotonic``) at the row's score, linear between stretches, the end's value outside; null without a
    score or for a key without steps. Distinct scores meet the stretches in bins of balanced size."""
    keys = list(keys)
    ends = steps.select(*keys, "value", F.explode(F.array_distinct(F.array("low", "high"))).alias("x"))
    asked = df.where(F.col(score).isNotNull()).select(*keys, F.col(score).cast("double").alias("x")).distinct()
    both = ends.select(*keys, "x", F.struct("x", "value").alias("at"), F.lit(False).alias("asked")).unionByName(asked.select(*keys, "x", F.lit(None).cast("struct<x:double,value:double>").alias("at"), F.lit(True).alias("asked")))
    # Keys go along as one struct, which is never null: no row is lost to a null key.
    both = with_bins(both.withColumn("_key", F.struct(F.lit(0).alias("_"), *[F.col(k) for k in keys])), ["_key"], "x")
    first, last = (lambda c: F.first(c, ignorenulls=True)), (lambda c: F.last(c, ignorenulls=True))
    inside = Window.partitionBy("_key", "_bin").orderBy("x").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    after = Window.partitionBy("_key", "_bin").orderBy("x").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    both = both.withColumns({"below": last("at").over(inside), "above": first("at").over(after)})
    per = both.groupBy("_key", "_bin").agg(F.max("at").alias("top"), F.min("at").alias("bottom"))
    bins = Window.partitionBy("_key").orderBy("_bin")  # 256 rows
    per = per.select("_key", "_bin", last("top").over(bins.rowsBetween(Window.unboundedPreceding, -1)).alias("before"), first("bottom").over(bins.rowsBetween(1, Window.unboundedFollowing)).alias("behind"))
    read = both.where("asked").join(per, ["_key", "_bin"]).select(*[F.col(f"_key.{k}").alias(k) for k in keys], "x", F.coalesce("below", "before").alias("a"), F.coalesce("above", "behind").alias("b"))
    a, b = F.col("a"), F.col("b")
    value = F.when(a.isNull(), b["value"]).when(b.isNull() | (b["x"] == a["x"]), a["value"])
    value = value.otherwise(a["value"] + (b["value"] - a["value"]) * (F.col("x") - a["x"]) / (b["x"] - a["x"]))
    read = read.select(*keys, "x", value.alias("_value"))
    out = df.alias("d").join(read.alias("r"), same_keys("d", "r", keys) & (F.col(f"d.{score}").cast("double") == F.col("r.x")), "left")
    return out.select(*[F.col(f"d.{c}").alias(c) for c in df.columns if c != name], F.col("r._value").alias(name))


def calibrated_apart(df: DataFrame, score: str, label: str, fold: str, name: str = "calibrated") -> DataFrame:
    """``calibrated`` by the rows of all other folds, for a few folds (each row learns in all but its own); rows without a fold learn in all and have no value."""
    folds = df.select(fold).where(F.col(fold).isNotNull()).distinct()
    values = F.array(*[F.lit(r[0]) for r in folds.orderBy(fold).collect()])
    if not folds.take(1):
        return df.withColumn(name, F.lit(None).cast("double"))
    others = F.filter(values, lambda f: ~F.col(fold).eqNullSafe(f))
    learn = df.select(F.col(score), F.col(label), F.explode(others).alias(fold))
    return calibrated(df, score, isotonic(learn, score, label, [fold]), [fold], name)

"""What both vector searches share: usable vectors, classes of equal vectors, and the way back to rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.common import written


def usable(emb: DataFrame, nonzero: bool) -> DataFrame:
    """(vec_id, v): v is array<double>. Vectors that are null, empty, or hold null or non-finite components are left
    out, with ``nonzero`` also those without a component other than 0. Rows without a vec_id take no part."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = emb.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where((F.size("v") > 0) & ~F.coalesce(bad, F.lit(True)))
    return rows.where(F.exists("v", lambda x: x != 0)) if nonzero else rows


def classes(rows: DataFrame, every: int, k: int) -> tuple[DataFrame, DataFrame]:
    """(cid, v, dim, ids, asked, need) of the distinct vectors, and (vec_id, cid) of the queries, whose ids ``every`` divides.

    ids: the k + 1 smallest ids of the copies, in order, each as often as there are rows of it, but at most k times; cid the smallest.
    A query leaves out the rows of its own id and takes k others, so it never needs more: further copies have the same
    score and larger ids. Rows of one id and vector are counted first and the rank is limited before the shuffle, so
    a vector that a third of all rows share sends k + 1 rows from each task. asked: is a copy a query? All queries of a class share
    one search, for need rows: k and the most that one of them leaves out. Of several vectors under one query id the smallest
    asks; all are candidates of other queries."""
    keyed = rows.select("vec_id", "v", F.xxhash64("v").alias("h")).groupBy("h", "v", "vec_id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("n"))
    rank = F.row_number().over(Window.partitionBy("h", "v").orderBy("vec_id"))
    few = keyed.withColumn("r", rank).where(F.col("r") <= k + 1).groupBy("h", "v").agg(F.array_sort(F.collect_list(F.struct("vec_id", "n"))).alias("ids"))
    ids = F.flatten(F.transform("ids", lambda x: F.array_repeat(x["vec_id"], x["n"])))
    asks = keyed.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("v", "h", "n")).alias("x")).select("vec_id", "x.*")
    asked = asks.groupBy("h", "v").agg(F.max("n").alias("own"))
    own = few.join(asked, ["h", "v"], "left")
    table = written(own.select("h", "v", F.element_at("ids", 1)["vec_id"].alias("cid"), F.size("v").alias("dim"), ids.alias("ids"), F.col("own").isNotNull().alias("asked"), (F.coalesce("own", F.lit(0)) + k).alias("need")), "classes")
    members = asks.join(table.where("asked").select("h", "v", "cid"), ["h", "v"]).select("vec_id", "cid")
    return table.drop("h"), members


def ranked(found: DataFrame, members: DataFrame, k: int, score: str) -> DataFrame:
    """query_id, rank, vec_id, score: from (q, score, ids) of the query classes' best entries.

    Of each query class the best 2 k rows stay (higher score, then smaller id), as no query leaves out more than k; each query leaves
    out the rows of its own id."""
    one = found.select("q", "score", F.explode("ids").alias("id"))
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), "id")
    best = one.withColumn("r", F.row_number().over(order)).where(F.col("r") <= 2 * k)
    lists = best.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("r", "id", "score"))).alias("best"))
    mine = members.join(lists, members["cid"] == lists["q"])
    rest = F.slice(F.filter("best", lambda x: x["id"] != F.col("vec_id")), 1, k)
    out = mine.select(F.col("vec_id").alias("query_id"), F.posexplode(rest).alias("i", "x"))
    return out.select("query_id", (F.col("i") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").cast(score).alias("score"))


def matrix(column) -> np.ndarray:
    """Rows of an array column as a float64 matrix."""
    return np.array([np.asarray(x, np.float64) for x in column], np.float64) if len(column) else np.zeros((0, 0))

"""Exact top-k search by distributed histogram selection.

A bounded batch of query classes is sent to all tasks, which score it against their own rows where these lie; no vector is
shuffled. First the tasks only count: per query a histogram of scores between two bounds. The summed histograms locate the bin that
holds the last value needed; it becomes the new interval, until it is one integer wide. A last pass keeps the rows that reach that
value and breaks ties by id. A task sends at most as many bins or rows for a query as it needs: what lies below its own last
value can't be above the global one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.common import written
from pulsegrid.llm.vectors import classes, matrix, ranked, usable

#: Query classes of a batch (as expected: they are dealt by a hash), bins of a histogram, queries scored at once.
QUERIES, BINS, AT_ONCE = 16_384, 512, 64
EXACT = 2.0**53


def block_scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Integer inner products. Doubles are exact while no sum can reach 2^53; beyond, 64-bit integers."""
    bound = np.sqrt((q * q).sum(axis=1).max()) * np.sqrt((v * v).sum(axis=1).max())
    return (q @ v.T).astype(np.int64) if bound < EXACT else q.astype(np.int64) @ v.astype(np.int64).T


class Batch:
    """Query classes of one length on the driver: vectors, the interval lo <= score < hi that holds each one's last value, how many
    rows are still to be found in it, and how many each needs at all."""

    def __init__(self, queries: pd.DataFrame, longest: float):
        queries = queries.sort_values("cid").reset_index(drop=True)
        self.q, self.v, self.need = queries["cid"].to_numpy(np.int64), matrix(queries["v"]), queries["need"].to_numpy(np.int64)
        bound = np.ceil(np.sqrt((self.v * self.v).sum(axis=1)) * longest).astype(np.int64) + 1
        self.lo, self.hi, self.rest = -bound, bound + 1, self.need.copy()
        self.done = np.zeros(len(self.q), bool)

    def width(self) -> np.ndarray:
        return np.maximum(1, -(-(self.hi - self.lo) // BINS))

    def narrow(self, found: pd.DataFrame) -> None:
        """Take the bin (and the rows still to be found in it) of each query that has one. Without one everything counts: the lower bound
        stays and the search is over."""
        width, live = self.width(), ~self.done
        self.done |= width == 1
        at = found["q"].to_numpy(np.int64)
        has = np.zeros(len(self.q), bool)
        has[at] = True
        self.done |= live & ~has
        low = self.lo[at] + found["bin"].to_numpy(np.int64) * width[at]
        self.lo[at], self.hi[at], self.rest[at] = low, np.minimum(low + width[at], self.hi[at]), found["rest"].to_numpy(np.int64)


def count_rows(batches: Iterator[pd.DataFrame], b: Batch) -> Iterator[pd.DataFrame]:
    """(q, bin, n): a task's histogram of each open query, from the top down to the last row that may be needed; q: its place in the batch."""
    live = np.flatnonzero(~b.done)
    width, n = b.width(), np.zeros((len(live), BINS), np.int64)
    for rows in batches:
        if len(rows):
            v, weight = matrix(rows["v"]), rows["ids"].map(len).to_numpy(np.float64)
            for i in range(0, len(live), AT_ONCE):
                own = live[i : i + AT_ONCE]
                s = block_scores(b.v[own], v)
                inside = (s >= b.lo[own, None]) & (s < b.hi[own, None])
                j, x = np.nonzero(inside)
                cell = j * BINS + (s[j, x] - b.lo[own][j]) // width[own][j]
                n[i : i + len(own)] += np.bincount(cell, weights=weight[x], minlength=len(own) * BINS).astype(np.int64).reshape(-1, BINS)
    down = n[:, ::-1].cumsum(axis=1)[:, ::-1]  # rows in a bin or above
    wanted = (n > 0) & (down - n < b.rest[live, None])
    j, bin_ = np.nonzero(wanted)
    yield pd.DataFrame({"q": live[j], "bin": bin_, "n": n[j, bin_]})


def take_rows(batches: Iterator[pd.DataFrame], b: Batch) -> Iterator[pd.DataFrame]:
    """(q, score, ids): a task's entries that reach the last value needed, at most as many as are needed, ties to the smaller first id."""
    held: list[pd.DataFrame] = []
    most = int(b.need.max())
    for rows in batches:
        if len(rows):
            v, cid, lists = matrix(rows["v"]), rows["cid"].to_numpy(np.int64), rows["ids"]
            for i in range(0, len(b.q), AT_ONCE):
                j, x = np.nonzero((s := block_scores(b.v[i : i + AT_ONCE], v)) >= b.lo[i : i + AT_ONCE, None])
                held.append(pd.DataFrame({"at": i + j, "score": s[j, x], "cid": cid[x], "ids": lists.iloc[x].to_numpy()}))
        if sum(map(len, held)) > 4 * most * len(b.q):
            held = [best_rows(held, b)]
    if held:
        out = best_rows(held, b)
        yield pd.DataFrame({"q": b.q[out["at"]], "score": out["score"], "ids": out["ids"]})


def best_rows(parts: list[pd.DataFrame], b: Batch) -> pd.DataFrame:
    x = pd.concat(parts).sort_values(["at", "score", "cid"], ascending=[True, False, True], kind="stable", ignore_index=True)
    return x[x.groupby("at").cumcount().to_numpy() < b.need[x["at"]]]


def search_batch(table: DataFrame, queries: pd.DataFrame, longest: float) -> DataFrame:
    """(q, score, ids) of one batch against the rows of its length."""
    b = Batch(queries, longest)
    sc = table.sparkSession.sparkContext
    while not b.done.all():  # log_BINS(range) rounds
        held = sc.broadcast(b)  # of a fixed size: QUERIES vectors
        counts = table.mapInPandas(lambda it, held=held: count_rows(it, held.value), "q long, bin long, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        counts = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("q").orderBy(F.col("bin").desc())))
        need = table.sparkSession.createDataFrame(pd.DataFrame({"q": np.arange(len(b.q)), "rest": b.rest}))
        # rest: how many rows are still to be found in the bin, after those above it
        reach = counts.join(F.broadcast(need), "q").where(F.col("upto") >= F.col("rest"))
        at = reach.groupBy("q").agg(F.max_by(F.struct("bin", (F.col("rest") - F.col("upto") + F.col("n")).alias("rest")), "bin").alias("x"))
        b.narrow(at.select("q", "x.*").toPandas())  # one row for each query of the batch
        held.unpersist()
    held = sc.broadcast(b)
    return table.mapInPandas(lambda it: take_rows(it, held.value), "q long, score long, ids array<long>")


def exact_top_k(emb: DataFrame, k: int = 20, every: int = 20, scale: float = 64.0) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows with the largest integer inner product of floor(scale * x).

    Queries: rows whose vec_id ``every`` divides; candidates: every other row with as many components. Ties go to the smaller vec_id; with fewer
    candidates all are returned. Null vectors and those with null or non-finite components take no part; zero vectors do.
    A repeated row is a candidate as often as it occurs; an id asks once, with its smallest vector, and leaves out every row of its own
    id. Sums must fit 64 bits. An empty table gives an empty table.
    """
    rows = usable(emb, nonzero=False).withColumn("v", F.transform("v", lambda x: F.floor(x * scale).cast("double")))
    table, members = classes(rows, every, k)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    sizes = table.groupBy("dim").agg(F.count_if("asked").alias("q"), F.max(norm).alias("longest")).where("q > 0").orderBy("dim").collect()  # one row a length
    found = None
    for r in sizes:
        batches = -(-r["q"] // QUERIES)
        same = table.where(F.col("dim") == r["dim"])
        batch = F.pmod(F.xxhash64("cid"), F.lit(batches))
        for i in range(batches):
            queries = same.where(F.col("asked") & (batch == i)).select("cid", "v", "need").toPandas()
            if len(queries):
                one = search_batch(same.select("cid", "v", "ids"), queries, r["longest"])
                one = written(one, "found") if batches > 1 else one
                found = one if found is None else found.unionByName(one)
    found = found if found is not None else emb.sparkSession.createDataFrame([], "q long, score long, ids array<long>")
    return ranked(found, members, k, "long")

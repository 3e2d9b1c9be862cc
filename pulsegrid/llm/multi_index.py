"""Approximate nearest neighbours by an inverted multi-index.

Both halves of a vector are quantised by codebooks of their own; a cell is a pair of centroids. A query walks over
centroid pairs in order of summed distance with a heap until the cells hold its candidate budget, and these entries are
reranked by exact cosine. The budget is a share of all entries, calibrated on the learning sample for a
wanted recall: clustered vectors need few, vectors without structure many.

Codebooks and budget are fitted on a bounded sample (``SAMPLE`` distinct vectors by hash); every row is indexed. For n
entries each codebook has about 4 n^(1/4) centroids, a power of two from 16 to 1,024.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import written
from pulsegrid.llm.vectors import classes, matrix, ranked, usable

SAMPLE, ROUNDS, TRIALS, WANTED, SEED = 20_000, 8, 200, 0.97, 11
#: Candidates of a query beyond its share, for each row that it needs.
SPARE = 8
#: Entries of one task group.
CHUNK = 4096
#: Queries of one block: a task meets a block of a centroid's queries and a chunk of its entries.
QUERIES = 4096


def unit(v: np.ndarray) -> np.ndarray:
    """Vectors of length 1; scaled first, so that no square overflows or vanishes."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1), 0)


def k_means(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(ROUNDS):
        near = distances(x, c).argmin(axis=1)
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


@dataclass
class Codebooks:
    first: np.ndarray
    second: np.ndarray
    share: float

    def halves(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = u.shape[1] // 2
        return distances(u[:, :h], self.first), distances(u[:, h:], self.second)

    def cells(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.halves(u)
        return a.argmin(axis=1), b.argmin(axis=1)


def walk(da: np.ndarray, db: np.ndarray, count: np.ndarray, budget: float) -> Iterator[tuple[int, int]]:
    """Centroid pairs by summed distance (ties by their ranks) until the cells hold ``budget`` entries. A pair enters the
    heap when both pairs before it have been taken."""
    ra, rb = np.argsort(da, kind="stable"), np.argsort(db, kind="stable")
    sa, sb = da[ra].tolist(), db[rb].tolist()
    taken = [0] * len(sa)  # of each first centroid: pairs taken, always the nearest second ones
    heap, have = [(sa[0] + sb[0], 0, 0)], 0
    while heap and have < budget:
        _, i, j = heapq.heappop(heap)
        taken[i] = j + 1
        a, b = int(ra[i]), int(rb[j])
        have += count[a, b]
        yield a, b
        if i + 1 < len(sa) and taken[i + 1] == j:
            heapq.heappush(heap, (sa[i + 1] + sb[j], i + 1, j))
        if j + 1 < len(sb) and (i == 0 or taken[i - 1] > j + 1):
            heapq.heappush(heap, (sa[i] + sb[j + 1], i, j + 1))


def centroids(n: int) -> int:
    """Of each codebook, for ``n`` entries."""
    return 1 << min(10, max(4, round(math.log2(4 * max(1, n) ** 0.25))))


def fit(v: np.ndarray, k: int, wanted: float = WANTED, n: int | None = None) -> Codebooks:
    """Codebooks of the sample for ``n`` entries, and the smallest share of entries with which its own trial queries reach ``wanted``."""
    rng = np.random.default_rng(SEED)
    u = unit(v)
    h, size = u.shape[1] // 2, centroids(n or len(v))
    books = Codebooks(k_means(u[:, :h], size, rng), k_means(u[:, h:], size, rng), 1.0)
    ca, cb = books.cells(u)
    trial = rng.choice(len(u), min(TRIALS, len(u)), replace=False)
    da, db = books.halves(u[trial])
    need = []
    for t, row in enumerate(trial):
        s = u @ u[row]
        s[row] = -2
        d = da[t][ca] + db[t][cb]
        before = np.sort(d)
        best = np.argsort(-s, kind="stable")[: min(k, len(u) - 1)]
        need += list(np.searchsorted(before, d[best], "right") / len(u))
    books.share = float(min(1.0, np.quantile(need, wanted) + 0.01)) if need else 1.0
    return books


def probe_rows(q: int, need: int, v: np.ndarray, books: Codebooks, count: np.ndarray, chunks: np.ndarray) -> Iterator[tuple]:
    """(q, need, first centroid, chunk, v, second centroids as packed bits) of one query class."""
    da, db = books.halves(unit(v[None]))
    of: dict[int, np.ndarray] = {}
    for a, b in walk(da[0], db[0], count, books.share * count.sum() + SPARE * need):
        if count[a, b]:
            of.setdefault(a, np.zeros(len(books.second), bool))[b] = True
    for a, m in of.items():
        cells = np.packbits(m).tobytes()
        for c in range(int(chunks[a])):
            yield q, need, a, c, v, cells


def rerank(key: tuple, queries: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
    """(q, score, ids): of each query the entries of its cells with the largest cosine, as many as it needs."""
    out = []
    if len(queries) and len(entries):
        q, v = matrix(queries["v"]), matrix(entries["v"])
        uq, uv = unit(q), unit(v)
        mask = np.unpackbits(np.frombuffer(b"".join(queries["cells"]), np.uint8).reshape(len(q), -1), axis=1)
        second, need = entries["second"].to_numpy(), queries["need"].to_numpy()
        ids, lists, cid = queries["q"].to_numpy(), entries["ids"].tolist(), entries["cid"].to_numpy()
        best: dict[int, list] = {}
        for b in np.unique(second):
            at, ask = np.flatnonzero(second == b), np.flatnonzero(mask[:, b])
            for i in range(0, len(ask), 256):
                s = uq[ask[i : i + 256]] @ uv[at].T
                top = np.argsort(-s, axis=1, kind="stable")[:, : need.max() + 1]
                for j, row in enumerate(top):
                    best.setdefault(int(ask[i + j]), []).extend((s[j, x], at[x]) for x in row)
        for j, found in best.items():
            # The pair's own sum, in one fixed order, whatever block it was found in.
            near = sorted(found, key=lambda x: -x[0])[: need[j] + 3]
            exact = sorted(((cosine(q[j], v[x]), cid[x], x) for _, x in near), key=lambda y: (-y[0], y[1]))[: need[j]]
            out += [(int(ids[j]), c, lists[x]) for c, _, x in exact]
    return pd.DataFrame(out, columns=["q", "score", "ids"])


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    a, b = a / np.abs(a).max(), b / np.abs(b).max()
    return float((a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())))


def nearest(emb: DataFrame, k: int = 5, every: int = 50, wanted: float = WANTED) -> DataFrame:
    """query_id, rank, vec_id, score: about the k rows of largest cosine, nearest first, ties to the smaller vec_id.

    Queries: rows whose vec_id ``every`` divides; candidates: every other row with as many components. The score is the exact cosine in double
    precision. Null and zero vectors and those with null or non-finite components take no part; vectors of another
    size than the most frequent one (ties: the larger) have a search of their own. A repeated row is a candidate as often as it occurs; an id
    asks once, with its smallest vector, and leaves out every row of its own id. The budget is a share of all entries and SPARE for each row
    needed on top, so that a query always finds k if there are as many. An empty table gives an empty table.
    """
    spark = emb.sparkSession
    table, members = classes(usable(emb, nonzero=True), every, k)
    dims = [r["dim"] for r in table.groupBy("dim").count().orderBy(F.col("count").desc(), F.col("dim").desc()).collect()]
    parts = [search(spark, table.where(F.col("dim") == d).drop("dim"), k, wanted) for d in dims]
    found = parts[0] if parts else spark.createDataFrame([], "q long, score double, ids array<long>")
    for p in parts[1:]:
        found = found.unionByName(p)
    return ranked(found, members, k, "double")


def search(spark, table: DataFrame, k: int, wanted: float) -> DataFrame:
    few = table.select("cid", "v").orderBy(F.xxhash64("cid"), "cid").limit(SAMPLE).toPandas()
    books = fit(matrix(few["v"]), k, wanted, table.count())
    held = spark.sparkContext.broadcast(books)

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x, y = held.value.cells(unit(matrix(b["v"])))
                yield b.assign(first=x.astype(np.int32), second=y.astype(np.int32))

    entries = written(table.mapInPandas(index, "v array<double>, cid long, ids array<long>, asked boolean, need int, first int, second int"), "index")
    count = np.zeros((len(books.first), len(books.second)), np.int64)
    for r in entries.groupBy("first", "second").count().collect():  # at most the pairs of centroids
        count[r["first"], r["second"]] = r["count"]
    chunks = np.maximum(1, -(-count.sum(axis=1) // CHUNK))
    told = spark.sparkContext.broadcast((books, count, chunks))

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), 64):  # a query has a row for each centroid and chunk
                part = b.iloc[i : i + 64]
                rows = [r for q, n, v in zip(part["q"], part["need"], part["v"], strict=True) for r in probe_rows(q, n, np.asarray(v, np.float64), *told.value)]
                yield pd.DataFrame(rows, columns=["q", "need", "first", "chunk", "v", "cells"])

    asked = entries.where("asked").select(F.col("cid").alias("q"), "need", "v")
    blocks = max(1, -(-asked.count() // QUERIES))
    left = asked.mapInPandas(probe, "q long, need int, first int, chunk int, v array<double>, cells binary").withColumn("block", F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int"))
    size = F.element_at(F.array(*[F.lit(int(c)) for c in chunks]), F.col("first") + 1)
    right = entries.select("cid", "v", "ids", "first", "second", F.pmod(F.xxhash64("cid"), size).cast("int").alias("chunk"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    key = ["first", "chunk", "block"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(rerank, "q long, score double, ids array<long>")

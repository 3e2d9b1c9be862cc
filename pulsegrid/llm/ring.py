"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Keys and virtual nodes lie on one ring. A key belongs to the first virtual node at or after it; if that
shard is full the key continues clockwise. With loads bounded by the exact quota (row counts at most one
apart) every shard fills to its quota. Whole arcs are placed by their row counts on the driver (a table
bounded by shards x virtual nodes); a row then needs only its rank within its arc, which comes from ranks within
2^20 cells of the ring and sums over the cells of the arc, so no task ranks a whole shard.
"""

from __future__ import annotations

from collections import deque

import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.common import copies, written

#: Virtual nodes of a shard, bits of a cell's number (the ring's resolution for virtual nodes), and of these the last, by which a coarse
#: cell is larger.
VNODES, CELL_BITS, COARSE = 128, 20, 9


def ring_nodes(shards: int, vnodes: int = VNODES) -> list[tuple[int, int]]:
    """(cell, shard) of every virtual node, in ring order. A shard's nodes don't depend on how many shards there are."""
    nodes: dict[int, int] = {}
    for shard in range(shards):
        for v in range(vnodes):
            cell, k = xxhash.xxh64_intdigest(f"{shard}/{v}") >> (64 - CELL_BITS), 0
            while cell in nodes:  # two nodes in one cell: the later shard's moves
                k += 1
                cell = xxhash.xxh64_intdigest(f"{shard}/{v}/{k}") >> (64 - CELL_BITS)
            nodes[cell] = shard
    return sorted(nodes.items())


def quotas(rows: int, shards: int) -> list[int]:
    """At most one apart; the sum is ``rows``."""
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def place_arcs(counts: list[int], nodes: list[tuple[int, int]], quota: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, from rank, to rank, shard, first slot): the rows of each arc, cut where a shard is full.

    First every arc offers its rows to its own node, in ring order; what overflows continues
    clockwise, round by round, until all rows have a place."""
    left, used, out = list(quota), [0] * len(quota), []
    waiting = deque((arc, 0, n, arc) for arc, n in enumerate(counts) if n)
    while waiting:
        arc, begin, end, at = waiting.popleft()
        shard = nodes[at][1]
        take = min(left[shard], end - begin)
        if take:
            out.append((arc, begin, begin + take, shard, used[shard]))
            left[shard] -= take
            used[shard] += take
        if begin + take < end:
            waiting.append((arc, begin + take, end, (at + 1) % len(nodes)))
    return out


def arc_table(nodes: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """(coarse, arc, low, high): the cells low to high belong to an arc; one row for each coarse cell that it touches."""
    last = [c for c, _ in nodes]
    edges = [(i, (last[i - 1] if i else -1) + 1, c) for i, c in enumerate(last)] + [(0, last[-1] + 1, (1 << CELL_BITS) - 1)]
    return [(k, *e) for e in edges if e[1] <= e[2] for k in range(e[1] >> COARSE, (e[2] >> COARSE) + 1)]


def bounded_ring(docs: DataFrame, shards: int, vnodes: int = VNODES) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row of ``docs``.

    size: UTF-8 bytes of the text plus 1; null text counts as no bytes (size 1, crc32 0). A row lies on the ring at the hash
    of its doc_id and its text's crc32; ties go by doc_id (null first), crc32 and size, and rows equal in all
    of these take neighbouring places. Null ids are placed like any other value. Shards hold row counts at most one apart, and
    slots run from 0 without a gap. An empty table gives an empty table.

    The texts are read once: what is kept of them, one row for equal rows with their number, is written to the shared folder. Ranks
    come from these numbers, and rows are spelt out last, so that the commonest row is no single task's work.
    """
    spark = docs.sparkSession
    nodes = ring_nodes(shards, vnodes)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    alike = base.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
    alike = alike.withColumn("spot", F.xxhash64("doc_id", "text_crc32")).withColumn("cell", F.shiftrightunsigned("spot", 64 - CELL_BITS).cast("int"))
    alike = written(alike, "ring")
    # The arc of each cell, from the few arcs of its coarse cell.
    arcs = spark.createDataFrame(arc_table(nodes), "coarse int, arc int, low int, high int")
    cells = alike.groupBy("cell").agg(F.sum("n").alias("n"))
    cells = cells.join(F.broadcast(arcs), (F.shiftright("cell", COARSE) == F.col("coarse")) & F.col("cell").between(F.col("low"), F.col("high")))
    # Cells after the last node belong to arc 0, behind whose own cells they come first on the ring.
    before = Window.partitionBy("arc").orderBy(F.col("low").desc(), "cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = written(cells.select("cell", "arc", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip")), "cells")
    found = {r["arc"]: r["n"] for r in cells.groupBy("arc").agg(F.sum("n").alias("n")).collect()}  # at most shards x vnodes
    counts = [found.get(i, 0) for i in range(len(nodes))]
    pieces = place_arcs(counts, nodes, quotas(sum(counts), shards))
    where = spark.createDataFrame(pieces, "arc int, begin long, end long, shard int, first long")
    inside = Window.partitionBy("cell").orderBy("spot", "doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    ranked = alike.withColumn("rank", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(cells.drop("n"), "cell").withColumn("rank", F.col("rank") + F.col("skip"))
    # Equal rows have the ranks rank to rank + n - 1, of which a piece of an arc holds a range.
    hit = (ranked["arc"] == where["arc"]) & (ranked["rank"] < where["end"]) & (ranked["rank"] + ranked["n"] > where["begin"])
    low, high = F.greatest("rank", "begin"), F.least(F.col("rank") + F.col("n"), F.col("end"))
    placed = ranked.join(F.broadcast(where), hit).select("doc_id", "size", "text_crc32", "shard", (F.col("first") + low - F.col("begin")).alias("start"), (high - low).alias("times"))
    return copies(placed, "times", "nth").select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("nth")).alias("slot"))

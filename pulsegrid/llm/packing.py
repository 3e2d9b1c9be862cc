"""Conflict-constrained best-fit packing of documents into bins of a fixed capacity.

Rows are dealt by a hash into independent groups, and each group is packed by best fit decreasing: open bins stand in order of
their residual space and carry one bitmap of sources and one of duplicate clusters (equal and near-equal texts); from the
tightest bin that the piece fits, successors are searched until a bin has neither the piece's source nor its cluster. Only
sizes and keys travel, never the texts.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm import simhash
from pulsegrid.llm.common import copies

#: Bytes of a bin, and the most rows that are expected in a packing group.
CAPACITY, PER_GROUP = 8192, 1024


class Bins:
    """Open bins ordered by (residual, number), each with its two bitmaps."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.order: list[tuple[int, int]] = []
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.used: list[int] = []

    def place(self, size: int, source_bit: int, cluster_bit: int) -> tuple[int, int]:
        """(bin, offset) of the tightest compatible bin; a new bin if there is none. A bit of 0 conflicts with nothing."""
        order = self.order
        for i in range(bisect_left(order, (size, -1)), len(order)):
            space, b = order[i]
            if not (self.sources[b] & source_bit or self.clusters[b] & cluster_bit):
                del order[i]
                break
        else:
            b, space = len(self.used), self.capacity
            self.sources.append(0)
            self.clusters.append(0)
            self.used.append(0)
        at = self.used[b]
        self.used[b] += size
        self.sources[b] |= source_bit
        self.clusters[b] |= cluster_bit
        if space > size:
            insort(order, (space - size, b))
        return b, at


def bits_of(values: np.ndarray, none: np.ndarray) -> list[int]:
    """One bit for each value that occurs more than once, 0 for values that occur once (they can't conflict) and where there is none."""
    _, codes = np.unique(values, return_inverse=True)
    many = np.flatnonzero(np.bincount(codes[~none], minlength=1) > 1)
    bit = {int(c): 1 << k for k, c in enumerate(many)}
    return [0 if no else bit.get(int(c), 0) for c, no in zip(codes, none, strict=True)]


#: Columns of a packing group: all whole numbers without nulls, as pandas would turn ids beside a null into doubles.
GROUP = ("part", "no_id", "id", "no_source", "source", "size", "cluster", "near", "copy")


def pack_group(pdf: pd.DataFrame, capacity: int = CAPACITY) -> pd.DataFrame:
    """Best fit decreasing over the pieces of one group (columns GROUP). A text over the capacity is cut into full pieces, each a
    bin of its own, and a rest, which is placed by its own size. Equal sizes go by id (null last), clusters, source, copy, piece."""
    c = {k: pdf[k].to_numpy(np.int64) for k in GROUP}
    size = c["size"]
    n = np.maximum(1, -(-size // capacity))
    row = np.repeat(np.arange(len(size)), n)
    piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    begin = piece * capacity
    length = np.minimum(capacity, size[row] - begin)
    by = [c[k][row] for k in ("no_id", "id", "cluster", "near", "no_source", "source", "copy")]
    order = np.lexsort([piece, *reversed(by), -length])
    empty = size == 0
    sources = bits_of(c["source"], c["no_source"] > 0)
    clusters = bits_of(c["cluster"], empty)
    above = max(clusters, default=0).bit_length()
    clusters = [a | b << above for a, b in zip(clusters, bits_of(c["near"], empty), strict=True)]
    bins, at, offset = Bins(capacity), np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
    for i, r, s in zip(order.tolist(), row[order].tolist(), length[order].tolist(), strict=True):
        at[i], offset[i] = bins.place(s, sources[r], clusters[r])
    out = {"no_id": c["no_id"][row] > 0, "id": c["id"][row], "piece": piece, "begin": begin, "length": length, "bin_group": c["part"][row], "bin": at, "offset": offset}
    return pd.DataFrame({k: v[order] for k, v in out.items()})


def group_bits_of(rows: int, per_group: int = PER_GROUP) -> int:
    """The fewest bits whose groups are expected to hold at most ``per_group`` rows."""
    return max(0, (max(1, rows) - 1) // per_group).bit_length()


def best_fit_pack(docs: DataFrame, capacity: int = CAPACITY, group_bits: int | None = None, near: bool = True) -> DataFrame:
    """doc_id, piece, begin, length, bin_group, bin, offset: where each piece of each document lies.

    A document's size is its UTF-8 bytes; null and empty texts have size 0 and still get a place. A text over
    the capacity is cut into pieces of the capacity and a rest (byte positions from ``begin``); all pieces
    are placed, full ones alone. No bin holds two documents of one source or of one duplicate cluster: texts that
    are equal after lower-casing and collapsing white space, none being left at the ends, or of one component of near
    duplicates (without ``near`` only the former: for tables that have one row of each component). Null sources and empty texts
    conflict with nothing. Repeated rows are placed once for each repeat. Ties go by id, null last. Ids are kept to the last digit.
    Other columns are ignored; an empty table gives an empty table.

    A row's group is the first ``group_bits`` bits of a hash of its id, its cluster and its number among equal rows. Unless
    given they follow the number of rows (``group_bits_of``): a group splits in two where the table has doubled, and stays as it is between.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    flat = F.trim(F.regexp_replace(F.lower("text"), r"\s+", " "))
    # A null source and a null id are flags of their own, as 0 and the empty text are values like any other.
    keys = {"no_id": F.col("doc_id").isNull(), "id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "no_source": F.col("source").isNull(), "source": F.xxhash64(F.col("source").cast("string")), "size": size, "cluster": F.when(size > 0, F.xxhash64(flat)).otherwise(F.lit(0))}
    by = [*keys, "near"]
    if near:
        table, by_fp = simhash.rooted(docs, more=keys)  # texts are read once
        root = by_fp.select("fp", F.xxhash64("root").alias("near"))
        alike = table.groupBy(*keys, "fp").agg(F.count("*").alias("n")).join(root, "fp")
        alike = alike.withColumn("near", F.when(F.col("size") > 0, F.col("near")).otherwise(F.lit(0)))
    else:
        table = docs.select(*[c.alias(k) for k, c in keys.items()])
        alike = table.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("near", F.col("cluster"))
    if group_bits is None:
        group_bits = group_bits_of(table.count())
    rows = copies(alike.select(*by, "n"), "n", "copy")
    spot = F.xxhash64("no_id", "id", "copy", "cluster")
    part = F.shiftrightunsigned(spot, 64 - group_bits) if group_bits else F.lit(0)
    rows = rows.select(part.cast("long").alias("part"), *[F.col(k).cast("long").alias(k) for k in GROUP[1:]])
    schema = "no_id boolean, id long, piece int, begin long, length long, bin_group long, bin int, offset long"
    out = rows.groupBy("part").applyInPandas(lambda pdf: pack_group(pdf, capacity), schema)
    return out.select(F.when(~F.col("no_id"), F.col("id")).alias("doc_id"), "piece", "begin", "length", "bin_group", "bin", "offset")

"""SimHash near-duplicates: 64-bit fingerprints, a binary-trie self-join, and their connected components.

Two fingerprints with at most ``budget`` differing bits agree in at least c of ``budget + c`` bit blocks. Each fingerprint is
therefore arranged once for each choice of c blocks, with these at the top, and dealt out by them; arrangements
that share their top blocks meet in a binary trie whose node pairs are traversed together. c follows the number of
fingerprints, so that the groups stay small; the links are the same for every c. Only distinct fingerprints travel, so a group of
exact copies is one row, and each trie emits the links of a spanning forest, so a dense group of near copies never
emits its pairs. A group that is large all the same is cut into parts, of which every two meet in a task of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import forget, fresh, quoted, small_batches, written
from pulsegrid.llm.textcode import parts
from pulsegrid.llm.xxh import hashes

BITS, SHINGLE, BUDGET, SEED = 64, 4, 4, 42
#: Of each byte its eight bits as bytes of their own, the highest first.
SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view("<u8")[:, 0]
#: Texts whose shingles are hashed at a time, and their letters (unless one text has more).
MOST_TEXTS, MOST_LETTERS = 1000, 250_000
#: Distinct fingerprints expected in one task group, and from how many on a group is cut into parts.
PER_GROUP, SPLIT = 4096, 1 << 15
#: Node pairs of a trie held at once, and leaf pairs that are compared directly.
FRONTIER, LEAF = 100_000, 16
#: Bits (a power of 2) of the map of keys that is sent to whole rows.
FILTER = 25


def fingerprints_of(texts: list[str | None], width: int = SHINGLE) -> np.ndarray:
    """The fingerprint of each text, unsigned; all shingles of the texts are hashed together. A text without a word, or null, has 0."""
    words = [(t or "").encode().lower().split() for t in texts]
    n = np.fromiter(map(len, words), np.int64, len(words))
    data = b" ".join([b" ".join(w) for w in words if w])
    end = np.append(np.flatnonzero(np.frombuffer(data, np.uint8) == 32), len(data))
    begin = np.concatenate([[0], end[:-1] + 1])
    shingles = np.where(n > 0, np.maximum(n - width + 1, 1), 0)
    first = np.cumsum(shingles) - shingles
    out = np.zeros(len(texts), np.uint64)
    has = np.flatnonzero(n > 0)
    if len(has):
        word = np.arange(int(shingles.sum())) + np.repeat(np.cumsum(n) - n - first, shingles)
        last = word + np.repeat(np.minimum(n, width), shingles) - 1
        h = hashes(data, begin[word], end[last], SEED).astype(">u8")
        # A sum holds eight counters of a byte each, so it takes 255 hashes at most.
        n_sums = -(-shingles[has] // 255)
        first_sum = np.cumsum(n_sums) - n_sums
        begin_sum = np.repeat(first[has], n_sums) + 255 * (np.arange(int(n_sums.sum())) - np.repeat(first_sum, n_sums))
        sums = np.add.reduceat(SPREAD[h.view(np.uint8).reshape(-1, 8)], begin_sum, axis=0)
        ones = np.add.reduceat(sums.view(np.uint8).reshape(-1, BITS), first_sum, axis=0, dtype=np.int64)
        out[has] = np.packbits(2 * ones > shingles[has, None], axis=1).view(">u8")[:, 0]
    return out


def fingerprints(docs: DataFrame, width: int = SHINGLE, more: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, text_hash, fp, and the columns ``more``): the whole text's fingerprint as a signed long, and its xxhash64."""

    @F.pandas_udf("long")
    def fp(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            found = [fingerprints_of([None if t is None or t != t else t for t in part], width) for part in parts(list(b), MOST_TEXTS, MOST_LETTERS)]
            yield pd.Series(np.concatenate(found or [np.zeros(0, np.uint64)]).view(np.int64))

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), fp(text).alias("fp"), *[c.alias(k) for k, c in (more or {}).items()])


class Blocks:
    """The bit blocks of a fingerprint, counted from the highest bit, and all choices of ``c`` of them."""

    def __init__(self, budget: int = BUDGET, c: int = 1):
        self.budget, m = budget, budget + c
        edge = [BITS * i // m for i in range(m + 1)]
        self.blocks = [(a, b - a) for a, b in zip(edge, edge[1:], strict=False)]
        self.choices = list(combinations(range(m), c))
        self.least = min(map(self.size, range(len(self.choices))))

    def size(self, turn: int) -> int:
        """Bits of a choice."""
        return sum(self.blocks[i][1] for i in self.choices[turn])

    def arranged(self, fp: np.ndarray, turn: int) -> np.ndarray:
        """The same bits in another order: the chosen blocks, then the others."""
        out = np.zeros(len(fp), np.uint64)
        for i in [*self.choices[turn], *(i for i in range(len(self.blocks)) if i not in self.choices[turn])]:
            first, n = self.blocks[i]
            out = out << np.uint64(n) | (fp >> np.uint64(BITS - first - n)) & np.uint64((1 << n) - 1)
        return out

    def key(self, fp: Column, turn: int, bits: int) -> Column:
        """The first ``bits`` of the chosen blocks, as a number."""
        out = F.lit(0).cast("long")
        for i in self.choices[turn]:
            first, n = self.blocks[i]
            out = F.shiftleft(out, n).bitwiseOR(F.shiftrightunsigned(fp, BITS - first - n).bitwiseAND(F.lit((1 << n) - 1)))
        return F.shiftright(out, self.size(turn) - bits)


def blocks_for(n: int, budget: int = BUDGET, per_group: int = PER_GROUP) -> tuple[Blocks, int]:
    """The blocks for ``n`` fingerprints and the bits that name a group: the smallest c of 1 to 3 whose groups are expected to be small."""
    bits = max(0, -(-n // per_group) - 1).bit_length()
    for c in (1, 2, 3):
        if (b := Blocks(budget, c)).least >= bits:
            break
    return b, min(bits, b.least)


def trie_links(values: np.ndarray, top: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All index pairs (i < j) of the sorted distinct ``values`` that share their ``top`` highest bits and
    differ in at most ``budget`` bits, in pieces of bounded size.

    A trie node is a range of the sorted values with a common prefix. Pairs of nodes go down together,
    level by level: equal bits keep the error count, unlike bits add one, and a pair over the budget is
    pruned. Pairs of small nodes are compared directly. The frontier is held in bounded pieces.
    """
    head = values >> np.uint64(BITS - top)
    first = np.flatnonzero(np.concatenate([[True], head[1:] != head[:-1]])) if len(values) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(values))
    keep = last - first > 1
    z = np.zeros(int(keep.sum()), np.int64)
    ones: dict[int, np.ndarray] = {}
    stack = [(top, np.stack([first[keep], last[keep], first[keep], last[keep], z]))]
    while stack:
        depth, f = stack.pop()
        if f.shape[1] > FRONTIER:
            half = f.shape[1] // 2
            stack += [(depth, f[:, :half]), (depth, f[:, half:])]
            continue
        small = (f[1] - f[0]) * (f[3] - f[2]) <= LEAF
        if depth == BITS:
            small[:] = True
        if small.any():
            s = f[:, small]
            f = f[:, ~small]
            na, nb = s[1] - s[0], s[3] - s[2]
            n = na * nb
            k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            b = np.repeat(nb, n)
            i, j = np.repeat(s[0], n) + k // b, np.repeat(s[2], n) + k % b
            ok = i < j
            i, j = i[ok], j[ok]
            ok = np.bitwise_count(values[i] ^ values[j]) <= budget
            yield i[ok], j[ok]
        if not f.shape[1]:
            continue
        bit = np.uint64(BITS - 1 - depth)
        if depth not in ones:  # how many values before each place have this bit
            ones[depth] = np.concatenate([[0], np.cumsum((values >> bit) & np.uint64(1), dtype=np.int32)])
        am = f[1] - (ones[depth][f[1]] - ones[depth][f[0]])
        bm = f[3] - (ones[depth][f[3]] - ones[depth][f[2]])
        same = f[0] == f[2]
        down = [np.stack([f[0], am, f[2], bm, f[4]]), np.stack([am, f[1], bm, f[3], f[4]]), np.stack([f[0], am, bm, f[3], f[4] + 1]), np.stack([am, f[1], f[2], bm, f[4] + 1])[:, ~same]]
        g = np.concatenate(down, axis=1)
        g = g[:, (g[0] < g[1]) & (g[2] < g[3]) & (g[4] <= budget)]
        g = g[:, (g[0] != g[2]) | (g[1] - g[0] > 1)]
        if g.shape[1]:
            stack.append((depth + 1, g))


def find(root: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The roots of ``x``, to which they then point directly."""
    r = root[x]
    while True:
        up = root[r]
        if (up == r).all():
            root[x] = r
            return r
        r = up


def join(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unite the components of each edge a-b in place, by way of the touched places only; a root is the smallest index of its component."""
    while len(a):
        ra, rb = find(root, a), find(root, b)
        live = ra != rb
        a, b, ra, rb = a[live], b[live], ra[live], rb[live]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))


def group_links(pdf: pd.DataFrame, choice: Blocks) -> pd.DataFrame:
    """The spanning links of one group of fingerprints: each linked value with its component's first."""
    turn = int(pdf["turn"].iloc[0])
    fp = np.unique(pdf["fp"].to_numpy().view(np.uint64))
    values = choice.arranged(fp, turn)
    order = np.argsort(values)
    fp, values = fp[order].view(np.int64), values[order]
    root = np.arange(len(values))
    for a, b in trie_links(values, choice.size(turn), choice.budget):  # links of a dense group are united as they come, never held together
        join(root, a, b)
    whole = find(root, np.arange(len(values)))
    linked = np.flatnonzero(whole != np.arange(len(values)))
    return pd.DataFrame({"a": fp[linked], "b": fp[whole[linked]]})


def links(distinct: DataFrame, n: int, budget: int = BUDGET) -> DataFrame:
    """(a, b): fingerprints of one component, enough of them to span every component of the link graph of the ``n`` rows of ``distinct`` (fp).

    A group of more than SPLIT fingerprints is cut by a hash into parts of about that size, and each pair of parts is one task."""
    choice, bits = blocks_for(n, budget)
    turns = F.array(*[F.struct(F.lit(t).alias("turn"), choice.key(F.col("fp"), t, bits).alias("part")) for t in range(len(choice.choices))])
    dealt = distinct.select("fp", F.explode(turns).alias("x")).select("fp", "x.turn", "x.part")
    large = dealt.groupBy("turn", "part").agg(F.count("*").alias("size")).where(F.col("size") > SPLIT)
    dealt = dealt.join(large, ["turn", "part"], "left")
    cut = F.coalesce(F.ceil(F.col("size") / SPLIT), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64("fp"), cut).cast("int")
    pair = dealt.select("fp", "turn", "part", own.alias("own"), F.explode(F.sequence(F.lit(0), cut - 1)).alias("other"))
    pair = pair.select("fp", "turn", "part", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    return pair.groupBy("turn", "part", "low", "high").applyInPandas(lambda pdf: group_links(pdf, choice), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge table: the smallest node it reaches.

    Rounds of min-label over both directions and a pointer jump, each reduced before its shuffle; every
    round is written to the shared folder in place of the one before. Only linked nodes take part."""
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    label = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root"))
    label = written(label.withColumn("moved", F.lit(True)), "label")
    while True:
        now = label.select("node", "root")
        near = both.join(now, both["b"] == now["node"]).groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = now.join(near, "node").select("node", "root", F.least("root", "near").alias("new"))
        jump = now.select(F.col("node").alias("new"), F.col("root").alias("far"))
        to = F.least("new", F.coalesce("far", "new"))
        label = written(step.join(jump, "new", "left").select("node", to.alias("root"), (to != F.col("root")).alias("moved")), "label", instead_of=label)
        if label.where("moved").isEmpty():
            forget(both)
            return label.select("node", "root")


def rooted(docs: DataFrame, budget: int = BUDGET, width: int = SHINGLE, more: dict[str, Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """The fingerprints of all rows (with columns ``more``), and (fp, root, component_id) of each distinct one: its component's smallest
    fingerprint and doc_id. The texts are read once."""
    with small_batches(docs.sparkSession):
        fps = written(fingerprints(docs, width, more), "fingerprints")
    own = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    root = components(links(own.select("fp"), own.count(), budget))
    named = own.join(root, own["fp"] == root["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return fps, written(named.join(smallest, "root").select("fp", "root", "component_id"), "by_fp", instead_of=own)


def near_duplicates(docs: DataFrame, budget: int = BUDGET, width: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable by links, itself
    included), text_hash (xxhash64 of the text), for every row of ``docs``.

    Null or wordless text has fingerprint zero, which links like any other. A row whose doc_id is null
    keeps null as its id and gets the smallest id of its component (null if that has none). Repeated
    rows stay. Other columns of ``docs`` are ignored. An empty table gives an empty table.
    """
    fps, by_fp = rooted(docs, budget, width)
    return fps.join(by_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "text_hash")


def place(names: list[str]) -> Column:
    """The bit of a key among 2^FILTER."""
    return F.pmod(F.xxhash64(*names), F.lit(1 << FILTER))


def perhaps_among(rows: DataFrame, keys: DataFrame, names: list[str]) -> DataFrame:
    """``rows`` with _perhaps: false if their key (columns ``names``, never null) is surely not among ``keys``. No row travels: what is sent is a
    bitmap of 2^FILTER bits at most, whatever the number of keys."""
    bits = keys.select(place(names).alias("_at")).groupBy(F.bitmap_bucket_number("_at").alias("_part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_at")).alias("_bits"))
    at = F.bitmap_bit_position(place(names))
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    found = rows.withColumn("_part", F.bitmap_bucket_number(place(names))).join(F.broadcast(bits), "_part", "left")  # 4 MB at most
    return found.withColumn("_perhaps", F.coalesce(byte.bitwiseAND(F.pow(F.lit(2), at % 8).cast("int")) > 0, F.lit(False))).drop("_part", "_bits")


def one_of_each(docs: DataFrame, budget: int = BUDGET, width: int = SHINGLE) -> DataFrame:
    """One row of each component, all columns: that of the smallest (doc_id, text_hash), nulls last; of several rows with both equal, the
    smallest by a hash of the row.

    Whole rows don't travel for their duplicates' sake: the keys of rows that go, and of those that repeat, are taken from the fingerprints and written, and
    a bitmap of fixed size of these keys is sent to the rows. A row whose bit is clear stays where it is; only the others meet the keys themselves.
    Rows of a repeated key that stays, if there are any, are reduced before their shuffle, so a group of any size stays small."""
    key = {"_none": F.col("doc_id").isNull(), "_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "_hash": F.xxhash64(F.col("text").cast("string"))}
    names = list(key)
    fps, by_fp = rooted(docs, budget, width)
    rank = F.struct(F.col("doc_id").isNull().alias("_none"), F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("text_hash").alias("_hash"))
    held = fps.groupBy(rank.alias("r"), "fp").agg(F.count("*").alias("n")).join(by_fp.select("fp", "root"), "fp")
    best = held.groupBy("root").agg(F.min(F.struct("r", "n")).alias("b")).select("root", "b.r", "b.n")
    stays = best.select(F.col("root").alias("of"), F.col("r").alias("best"))
    gone = held.join(stays, held["root"] == stays["of"]).where(F.col("r") != F.col("best")).select("r.*").distinct()
    marked = written(gone.withColumn("_goes", F.lit(True)).unionByName(best.where("n > 1").select("r.*", F.lit(False).alias("_goes"))), "marked")
    row = fresh(docs, "row")
    whole = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias(row), *[c.alias(k) for k, c in key.items()])
    whole = perhaps_among(whole, marked, names)
    apart = whole.where("NOT _perhaps").select(f"{row}.*")
    met = whole.where("_perhaps").join(marked, names, "left")
    kept = apart.union(met.where("_goes IS NULL").select(f"{row}.*"))
    if marked.where("NOT _goes").isEmpty():
        return kept
    order = F.xxhash64(*[F.col(f"{row}.{quoted(f.name)}") for f in docs.schema if "map<" not in f.dataType.simpleString()])
    first = met.where("NOT _goes").groupBy(*names).agg(F.min_by(row, order).alias(row))
    return kept.union(first.select(f"{row}.*"))

"""Benchmark decontamination: a prefix-filtered join of document words with windows of benchmark items.

A window is ``width`` consecutive words of an item (an item of fewer words is one window). Its tokens are its shingles, in the order of
their rarity among the documents. A text that holds at least a share ``containment`` of a window's m shingles at their places holds one of the
m - ceil(containment m) + 1 rarest: only these necessary prefix tokens are joined. A posting at word p whose shingle stands at word j of an item
lies on the diagonal p - j; lengths and places bound which windows of the item can lie there. What is left is verified: all shingles of the
window, each at its place, overlap in all its words.

No text is shuffled: what leaves it are postings of shingles that the benchmark has, so the work after the scan grows with what the two
share. Texts and shingles go by hashes of 128 bits; equal texts are one.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.common import fresh, quoted, with_results, written

WIDTH, SHINGLE, CONTAINMENT = 10, 5, 1.0
#: What stands between words: all of ASCII but digits and letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text whose letters A to Z are lower-cased; null has none."""
    low = F.translate(F.coalesce(text.cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(low, BETWEEN), "")


def shingles(w: Column, k: int) -> Column:
    """array<struct<gram, proof>>: two hashes of each k consecutive words, in order."""

    def hashed(i: Column) -> Column:
        run = [F.get(w, i + j) for j in range(k)]
        return F.struct(F.xxhash64(F.lit(k), *run).alias("gram"), F.xxhash64(*run, F.lit(k)).alias("proof"))

    none = F.array().cast("array<struct<gram:bigint,proof:bigint>>")
    return F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(0), F.size(w) - k), hashed)).otherwise(none)


def once(c: Column, use) -> Column:
    """``use(c)`` with ``c`` evaluated once, however often the lambda functions inside refer to it."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def item_classes(benchmark: DataFrame, width: int, shingle: int) -> DataFrame:
    """One row for each distinct sequence of words: cls, words, n, items (the distinct non-null item_ids), wide (words of a window), k (words of a shingle)."""
    w = benchmark.select("item_id", words(F.col("text")).alias("words")).where(F.size("words") > 0)
    by = w.withColumn("cls", F.sha2(F.array_join("words", " "), 256)).groupBy("cls")
    out = by.agg(F.first("words").alias("words"), F.collect_set("item_id").alias("items")).withColumn("n", F.size("words"))
    return out.withColumn("wide", F.least(F.lit(width), "n")).withColumn("k", F.least(F.lit(shingle), "wide"))


def item_shingles(classes: DataFrame, widths: list[int]) -> DataFrame:
    """cls, n, wide, m (shingles of a window), j, gram, proof: each shingle of each item class, which begins at word j."""
    of = F.array().cast("array<struct<gram:bigint,proof:bigint>>")
    for k in widths:
        of = F.when(F.col("k") == k, shingles(F.col("words"), k)).otherwise(of)
    each = classes.select("cls", "n", "wide", (F.col("wide") - F.col("k") + 1).alias("m"), F.posexplode(of).alias("j", "of"))
    return each.select("cls", "n", "wide", "m", "j", "of.gram", "of.proof")


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("string")))


#: A posting that every text has, so that its number of words is known wherever its postings are.
EVERY = 0


def postings(docs: DataFrame, known: DataFrame, widths: list[int]) -> DataFrame:
    """(key, n_words, pos, gram, proof): where a distinct text has a shingle of ``known``, and one row of EVERY for each text."""
    every = F.array(F.struct(F.lit(EVERY).cast("long").alias("gram"), F.lit(EVERY).cast("long").alias("proof")))
    of = once(words(F.col("text")), lambda w: F.struct(F.size(w).alias("n_words"), F.array(every, *[shingles(w, k) for k in widths]).alias("runs")))
    known = known.unionByName(known.sparkSession.range(1).select(F.lit(EVERY).cast("long").alias("gram"), F.lit(EVERY).cast("long").alias("proof")))
    spread = docs.where(F.col("text").isNotNull()).select(text_key(F.col("text")).alias("key"), of.alias("of")).select("key", "of.n_words", F.explode("of.runs").alias("run"))
    at = spread.select("key", "n_words", F.posexplode("run").alias("pos", "of")).select("key", "n_words", "pos", "of.gram", "of.proof")
    return at.join(known, ["gram", "proof"]).select("key", "n_words", "pos", "gram", "proof").distinct()


def starts(low: Column, high: Column) -> Column:
    return F.explode(F.when(low <= high, F.sequence(low, high)))


def prefixes(each: DataFrame, found: DataFrame, containment: float) -> DataFrame:
    """The necessary shingles of each window that any text holds: (gram, proof, cls, n, wide, m, j) and s, the window's start in the item."""
    rare = found.groupBy("gram", "proof").agg(F.count("*").alias("times"))
    ranked = each.join(rare, ["gram", "proof"], "left").withColumn("times", F.coalesce("times", F.lit(0)))
    ranked = ranked.withColumn("s", starts(F.greatest(F.lit(0), F.col("j") - F.col("m") + 1), F.least("j", F.col("n") - F.col("wide"))))
    order = F.row_number().over(Window.partitionBy("cls", "s").orderBy("times", "gram", "proof", "j"))
    return ranked.withColumn("r", order).where((F.col("r") <= F.col("m") - F.ceil(F.col("m") * F.lit(containment)) + 1) & (F.col("times") > 0)).drop("r", "times")


def occurrences(found: DataFrame, each: DataFrame, containment: float) -> DataFrame:
    """(key, cls, first, last): the windows that texts hold, by their first and last word in the text."""
    d = F.col("pos") - F.col("j")
    near = found.join(prefixes(each, found, containment), ["gram", "proof"]).withColumn("d", d)
    near = near.where((F.col("d") + F.col("s") >= 0) & (F.col("d") + F.col("s") + F.col("wide") <= F.col("n_words"))).select("key", "cls", "d", "s").distinct()
    # each candidate's shingles at their places in the text
    wanted = near.join(each, "cls").where((F.col("j") >= F.col("s")) & (F.col("j") < F.col("s") + F.col("m")))
    wanted = wanted.select("key", "cls", "d", "s", "wide", "m", (F.col("d") + F.col("j")).alias("pos"), "gram", "proof")
    held = wanted.join(found.drop("n_words"), ["key", "pos", "gram", "proof"]).groupBy("key", "cls", "d", "s", "wide", "m").count()
    whole = held.where(F.col("count") >= F.ceil(F.col("m") * F.lit(containment)))
    first = F.col("d") + F.col("s")
    return whole.select("key", "cls", first.alias("first"), (first + F.col("wide") - 1).alias("last")).distinct()


def covered(windows: Column) -> Column:
    """How many words lie in any of the ascending windows."""

    def step(a: Column, x: Column) -> Column:
        new = x["last"] - F.greatest(x["first"] - 1, a["end"])
        return F.struct((a["n"] + F.greatest(F.lit(0), new)).alias("n"), F.greatest(a["end"], x["last"]).alias("end"))

    return F.aggregate(windows, F.struct(F.lit(0).alias("n"), F.lit(-1).alias("end")), step)["n"]


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, shingle: int = SHINGLE, containment: float = CONTAINMENT) -> DataFrame:
    """The columns of ``docs`` (text among them) and n_words (int), n_hit (words inside any window's occurrence), windows (array<struct<first, last>>,
    words from 0, distinct, ascending) and items (the distinct item_ids with a window in the text, ascending); columns of these names are replaced.

    ``benchmark``: item_id, text. A null text has no words, no hits and null items no windows; an item without a word has no window; items of equal words share
    their windows. A null item_id marks words, and is in no list. Repeated rows of ``docs`` have equal results, and repeated items count once.
    An empty benchmark hits nothing, an empty table of documents gives an empty one. ``containment`` below 1 also takes windows of
    which so large a share of shingles stands at its places.
    """
    if not (1 <= shingle <= width and 0 < containment <= 1):
        raise ValueError("a shingle has no more words than a window; containment is over 0 and at most 1")
    classes = written(item_classes(benchmark, width, shingle), "items")
    widths = sorted(r[0] for r in classes.select("k").distinct().collect())  # as many as a shingle has words, at most
    each = written(item_shingles(classes, widths), "shingles")
    known = written(each.select("gram", "proof").distinct(), "known")
    held = written(postings(docs, known, widths), "postings")
    marks = (F.col("gram") == EVERY) & (F.col("proof") == EVERY)
    seen = written(occurrences(held.where(~marks), each, containment), "occurrences")
    spans = seen.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("first", "last"))).alias("windows"))
    named = seen.select("key", "cls").distinct().join(classes.select("cls", F.explode("items").alias("item")), "cls")
    told = spans.join(named.groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("items")), "key", "left")
    told = told.select("key", covered(F.col("windows")).alias("n_hit"), "windows", "items")
    told = written(held.where(marks).select("key", "n_words").join(told, "key", "left"), "told")

    key, n, hit, windows, items = (fresh(docs, x) for x in ("key", "n", "hit", "windows", "items"))
    renamed = told.select(F.col("key").alias(key), F.col("n_words").alias(n), F.col("n_hit").alias(hit), F.col("windows").alias(windows), F.col("items").alias(items))
    out = docs.withColumn(key, text_key(F.col("text"))).join(renamed, key, "left")
    nothing = {c: F.array().cast(told.schema[k].dataType) for c, k in ((windows, "windows"), (items, "items"))}
    result = F.struct(F.coalesce(n, F.lit(0)).alias("n_words"), F.coalesce(hit, F.lit(0)).alias("n_hit"), *[F.coalesce(c, x).alias(k) for (c, x), k in zip(nothing.items(), ("windows", "items"), strict=True)])
    at = fresh(docs, "told")
    kept = out.select(*[F.col(quoted(c)) for c in docs.columns], result.alias(at))
    return with_results(kept, F.col(at), ["n_words", "n_hit", "windows", "items"]).drop(at)

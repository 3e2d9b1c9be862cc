"""Job 2: do a text's signals tell its label in sources that nothing was learnt from?

    python -m jobs.score_audit --documents in/documents.parquet --labels in/labels.parquet --target out/audit [--config mine.json]

The leave-one-group-out audit of window tables, for a text table whose groups are its sources. Each text's signals become z-scores by the mean and deviation
of all *other* sources; a signal's direction is that of the labelled texts of the other sources; their mean is the score. So a source is never judged
by itself, and no fold is copied: other sources' sums are all sums less the own ones.

Two tables are written: ``scores``, partitioned by source, with doc_id, y (the label, null without one), z_<signal>, score and called (score over 0),
for every document; and ``report``, a row for each source with its rows, labelled rows, AUC and rates. A run replaces both, so it may be repeated.

A document without a source is of the source "none". Null texts have no signals and no score; a signal that doesn't vary elsewhere, or whose direction is
unknown, is left out of the score. Labels given more than once count as their largest. Sources with one class have no AUC.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import command_line, settings
from pulsegrid.operators import metrics as M
from pulsegrid.operators import tables as T

LOG = logging.getLogger("jobs.score_audit")


def signals() -> dict[str, Column]:
    """Of ``text``: log length in words, share of distinct words, share of marks and digits among signs, letters a word, share of repeated lines."""
    words = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")
    lines = F.split("text", "\n")
    n = F.size(words)
    marks = F.length("text") - F.length(F.regexp_replace("text", r"[\x21-\x40\x5B-\x60\x7B-\x7E]", ""))
    share = lambda a, b: F.when(b > 0, a / b)
    return {
        "length": F.log1p(n.cast("double")),
        "distinct": share(F.size(F.array_distinct(words)), n),
        "marks": share(marks, F.length("text")),
        "word_length": share(F.length(F.regexp_replace("text", r"[\x20\x09-\x0D]+", "")), n),
        "repeats": 1 - F.size(F.array_distinct(lines)) / F.size(lines),
    }


def directions(x: DataFrame, names: list[str]) -> DataFrame:
    """source and way_<signal>: 1 or -1 as the labelled texts of all other sources have more or less of it with label 1; null if that isn't known."""
    one, other = F.col("y") == 1, F.col("y") != 1
    sums = [f(F.when(c, F.col(n))).alias(f"{n}_{k}_{g}") for n in names for g, c in (("pos", one), ("neg", other)) for k, f in (("sum", F.sum), ("count", F.count))]
    own = x.groupBy("source").agg(*sums)
    total = own.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"all_{c}") for c in own.columns[1:]])  # one row

    def rest(n: str, g: str) -> Column:
        s, k = (F.col(f"all_{n}_{a}_{g}") - F.coalesce(f"{n}_{a}_{g}", F.lit(0)) for a in ("sum", "count"))
        return s / M.zero_null(k.cast("double"))

    return own.crossJoin(F.broadcast(total)).select("source", *[F.nullif(F.signum(rest(n, "pos") - rest(n, "neg")), F.lit(0.0)).alias(f"way_{n}") for n in names])


def score_audit(spark: SparkSession, documents: str, labels: str, target: str, config: str | None = None) -> dict:
    """One run; how many documents and labels were read, and what was written."""
    c = settings(spark, config, __file__)
    names, of = list(c["signals"]), signals()
    docs = spark.read.parquet(documents).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("none")).alias("source"), F.col("text").cast("string").alias("text"))
    x = docs.select("doc_id", "source", *[of[n].alias(n) for n in names])
    known = spark.read.parquet(labels).groupBy("doc_id").agg(F.max(c["label"]).cast("int").alias("y")).where("doc_id IS NOT NULL")
    x = x.join(known, "doc_id", "left")
    others = T.loo_means(x, "source", names).join(directions(x, names), "source")
    x = x.join(others, "source")
    z = {n: (F.col(n) - F.col(f"mean_{n}")) / M.zero_null(F.col(f"std_{n}")) for n in names}
    toward = F.array_compact(F.array(*[F.col(f"z_{n}") * F.col(f"way_{n}") for n in names]))
    total = F.aggregate(toward, F.lit(0.0), lambda a, v: a + v)
    x = x.withColumns({f"z_{n}": z[n] for n in names}).withColumn("score", F.when(F.size(toward) > 0, total / F.size(toward))).withColumn("called", F.col("score") > 0)
    out = x.select("doc_id", "y", *[f"z_{n}" for n in names], "score", "called", "source")
    # A large source is written by several tasks, a small one by one.
    out.hint("rebalance", "source").write.mode("overwrite").partitionBy("source").parquet(f"{target}/scores")
    scores = spark.read.schema(scores_schema(names)).parquet(f"{target}/scores")
    report(scores).coalesce(1).write.mode("overwrite").parquet(f"{target}/report")
    said = scores.agg(F.count("*").alias("documents"), F.count("y").alias("labelled"), F.countDistinct("source").alias("sources")).first().asDict()
    LOG.info("read %(documents)d documents of %(sources)d sources, %(labelled)d of them labelled; wrote %(target)s/scores and %(target)s/report", said | {"target": target})
    for r in spark.read.parquet(f"{target}/report").orderBy("source").limit(100).collect():
        LOG.info("%s: %s", r["source"], {k: v for k, v in r.asDict().items() if k != "source"})
    return said


def report(scores: DataFrame) -> DataFrame:
    """source, rows, labelled, auc, sens, spec, ppv: a row for each source."""
    called = scores.where("y IS NOT NULL AND score IS NOT NULL")
    rates = M.confusion(called, F.col("called"), "y", ["source"]).select("source", "sens", "spec", "ppv")
    areas = M.auc(called, "score", "y", ["source"]).select("source", "auc")
    rows = scores.groupBy("source").agg(F.count("*").alias("rows"), F.count("y").alias("labelled"))
    return rows.join(areas, "source", "left").join(rates, "source", "left")


def scores_schema(names: list[str]) -> str:
    return f"doc_id long, y int, {', '.join(f'z_{n} double' for n in names)}, score double, called boolean, source string"


def written(spark: SparkSession, target: str, config: str | None = None) -> DataFrame:
    """All that stands in ``target``: each document's row with its source's report beside it."""
    names = list(settings(spark, config, __file__)["signals"])
    return spark.read.schema(scores_schema(names)).parquet(f"{target}/scores").join(spark.read.parquet(f"{target}/report"), "source", "left")


if __name__ == "__main__":
    command_line("score_audit", __doc__, ["documents", "labels", "target"], score_audit)

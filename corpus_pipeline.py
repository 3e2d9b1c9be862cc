"""The corpus pipeline: toxicity, language, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; all but the last return the columns
of ``docs``, whatever further columns these are and however they are named. Null and empty texts, null ids and repeated rows
have a defined result in every stage (below); an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm import langid, packing, simhash, toxicity
from pulsegrid.llm.common import documents, quoted, small_batches, written

#: Least score (share of the letters in spans of the leading language, times its posterior) of a text that is kept.
LEAST_LANG = 0.3


def whole(docs: DataFrame) -> DataFrame:
    """The row as one struct beside its text: no column of a stage clashes with one of ``docs``."""
    return docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("doc"), "text")


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier, learnt from the labelled rows of ``docs``, doesn't call toxic. Null and wordless texts have the score of no
    evidence and stay; rows alike share their fate; without labels of both kinds a text's score is the share of toxic labels, 0 without any."""
    net = toxicity.fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score_toxicity(whole(docs), net).where("NOT toxic").select("doc.*")


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str, least: float = LEAST_LANG) -> DataFrame:
    """Rows whose text has a language with a score of at least ``least``; texts that are null, hold no letter, or are a jumble of languages go.
    Without a row to learn from no language is known, and all rows go."""
    found = langid.detect_languages(whole(docs), langid.fit_languages(docs))
    return found.where((F.col("lang_pred") != "und") & (F.col("lang_score") >= least)).select("doc.*")


def keep_first_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies: that of the smallest doc_id (null last, then by hashes of the text and of the row). Null and
    wordless texts are copies of one another."""
    return simhash.one_of_each(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every row, as ``packing.best_fit_pack`` states; near copies have gone before, equal texts haven't a bin in common."""
    return packing.best_fit_pack(docs, near=False)


STAGES = [("toxicity", keep_civil), ("language", keep_known_language), ("near_duplicates", keep_first_of_near_copies), ("packing", pack)]

#: Learning and near-duplicates aren't expressible in SQL; tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        with small_batches(spark):
            docs = before = written(stage(spark, docs, sf_dir), name, instead_of=before)
    return STAGES[-1][1](spark, docs, sf_dir)

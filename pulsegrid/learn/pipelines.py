"""pyspark.ml pipelines for tables that no single task holds: exact medians, population scaling, weights, and the classifiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators.metrics import quantiles


def cleaned(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Infinite and NaN to null."""
    return df.withColumns({c: F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(F.col(c)) for c in columns})


def statistics(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float, float]]:
    """(median, mean, population deviation) of each column with its median filled in; exact medians of all columns in one pass over their long
    form, then one row of sums."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select("x.*")
    med = dict.fromkeys(columns) | {r["c"]: r["value"] for r in quantiles(long, "v", [0.5], ["c"]).collect()}  # one row for each column
    filled = {c: F.coalesce(c, F.lit(med[c] if med[c] is not None else 0.0)) for c in columns}
    row = df.agg(*[F.avg(filled[c]).alias(f"m_{c}") for c in columns], *[F.stddev_pop(filled[c]).alias(f"s_{c}") for c in columns]).first()
    return {c: (med[c] if med[c] is not None else 0.0, row[f"m_{c}"] or 0.0, row[f"s_{c}"] or 1.0) for c in columns}


def scaled(df: DataFrame, stats: dict[str, tuple[float, float, float]]) -> DataFrame:
    return df.withColumns({c: (F.coalesce(c, F.lit(med)) - m) / s for c, (med, m, s) in stats.items()})


def with_weights(df: DataFrame, label: str) -> DataFrame:
    """n / (2 n_class) as ``_weight``."""
    n = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}
    total = sum(n.values())
    w = F.lit(1.0)
    for k, c in n.items():
        w = F.when(F.col(label) == k, F.lit(total / (2 * c))).otherwise(w)
    return df.withColumn("_weight", w)


def classifier(name: str, label: str, c: float = 1.0, weight_sum: float = 1.0):
    """LR takes C as 1 / (C * sum of weights), without its own standardisation."""
    common = {"featuresCol": "_x", "labelCol": label, "weightCol": "_weight"}
    makers = {
        "LR": lambda: LogisticRegression(**common, regParam=1 / (c * weight_sum), elasticNetParam=0, standardization=False),
        "RF": lambda: RandomForestClassifier(**common, numTrees=200, seed=42),
        "GB": lambda: GBTClassifier(**common, maxIter=50, seed=42),
        "SVM": lambda: LinearSVC(**common, regParam=1 / (c * weight_sum), standardization=False),
    }
    if name not in makers:
        raise ValueError(f"unknown classifier {name!r}")
    return makers[name]()


def important(df: DataFrame, columns: Sequence[str], label: str, least: float = 0.008, trees: int = 50) -> list[str]:
    """Columns whose forest importance reaches ``least``; all if none does."""
    x = VectorAssembler(inputCols=list(columns), outputCol="_x").transform(df)
    model = RandomForestClassifier(featuresCol="_x", labelCol=label, numTrees=trees, seed=42).fit(x)
    return [c for c, v in zip(columns, model.featureImportances.toArray(), strict=True) if v >= least] or list(columns)


class Fitted:
    """A fitted pipeline with its statistics: ``transform`` adds p."""

    def __init__(self, stats: dict, model: PipelineModel):
        self.stats, self.model = stats, model

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.model.transform(scaled(cleaned(df, list(self.stats)), self.stats))
        has = "probability" in out.columns
        p = vector_to_array("probability")[1] if has else 1 / (1 + F.exp(-vector_to_array("rawPrediction")[1]))
        return out.withColumn("p", p).drop("_x", "_weight", "rawPrediction", "probability", "prediction")


def fit(df: DataFrame, columns: Sequence[str], label: str, name: str = "LR", c: float = 1.0, select: bool = False) -> Fitted:
    d = cleaned(df.where(F.col(label).isNotNull()), columns)
    stats = statistics(d, columns)
    d = with_weights(scaled(d, stats), label)
    kept = important(d, columns, label) if select else list(columns)
    total = d.agg(F.sum("_weight")).first()[0] or 1.0
    model = Pipeline(stages=[VectorAssembler(inputCols=kept, outputCol="_x"), classifier(name, label, c, total)]).fit(d)
    return Fitted(stats, model)


def calibrate(df: DataFrame, score: str, label: str):
    """An isotonic model of label on score."""
    x = VectorAssembler(inputCols=[score], outputCol="_s").transform(df)
    return IsotonicRegression(featuresCol="_s", labelCol=label).fit(x)

"""Quality learnt without labels for every left-out group at once: first principal components from sums of products, their scales from counts.

A fold's correlations are those of all rows less its own, so its components are solved where its sums lie; missing values take the fold's median inside the
sums, by products with the flags of what is missing. The 5th and 95th percentile of a fold's scores over all other rows lie in a narrow band of all rows' scores
(``learn.nearby``), which alone each fold scores. The driver holds the band and the sums of all rows, nothing for each fold.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions import native
from pulsegrid.learn import nearby
from pulsegrid.learn.sums import finite


def lopo_components(df: DataFrame, groups: Mapping[str, Sequence[str]], anchors: Mapping[str, str], fold: str = "patient", shared: bool = False, beta: float = 4.0, floor: float = 0.05) -> DataFrame:
    """``df`` with quality_<group> in [0, 1] and w_<group>: for each fold the quality learnt from all other rows, and the weights of all groups from it.

    Missing and infinite values are the median of the others. A component without spread among the others gives 0.5. Rows without a fold are among the others of all
    folds and have no quality. An empty table gives an empty one.
    """
    columns = list(dict.fromkeys([c for cs in groups.values() for c in cs] + list(anchors.values())))
    t = nearby.rows_of(df.withColumn("_one", F.lit(1)), columns, "_one", fold)
    try:
        fits, _ = nearby.components(t, [[columns.index(c) for c in cs] for cs in groups.values()], [columns.index(anchors[m]) for m in groups], shared)
        fits = fits.select(F.col("_f").alias("_g"), "_theta").localCheckpoint()
    finally:
        t.release()
    u, d = t.basis.of([finite(c) for c in columns]), len(t.basis.top)
    out = df.join(fits, F.col(fold) == F.col("_g"), "left")

    def quality(k: int):
        raw = F.lit(0.0)
        for i, v in enumerate(u):
            raw = raw + F.get("_theta", F.lit(k * d + i)) * v
        low, high = (F.get("_theta", F.lit(len(groups) * d + 2 * k + j)) for j in (0, 1))
        return F.when(high > low, F.least(F.greatest((raw - low) / F.nullif(high - low, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))).when(high.isNotNull(), F.lit(0.5))

    out = out.select(*df.columns, *[quality(k).alias(f"quality_{m}") for k, m in enumerate(groups)])
    weights = native.quality_weights([f"quality_{m}" for m in groups], beta, floor)
    return out.select("*", *[w.alias(f"w_{m}") for m, w in zip(groups, weights, strict=True)])

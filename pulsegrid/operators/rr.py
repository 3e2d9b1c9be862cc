"""RR series and heart-rate-variability features as window functions and aggregates over long tables (key, i, rr in ms)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Plausible RR and the entropy bins in ms.
RR_MIN, RR_MAX, BIN = 300.0, 2000.0, 50.0
BINS = int((RR_MAX - RR_MIN) / BIN)


def gaps(beats: DataFrame, key: str, order: list[str], micros: Column) -> DataFrame:
    """``beats`` with gap_us: microseconds since the beat before, of the same key."""
    w = Window.partitionBy(key).orderBy(*order)
    return beats.withColumn("gap_us", micros - F.lag(micros).over(w)).where(F.col("gap_us").isNotNull())


def plausible(rr: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(key, i, rr) strictly inside the limits; i counts from 1."""
    w = Window.partitionBy(key).orderBy(*order)
    return rr.where((F.col("rr") > RR_MIN) & (F.col("rr") < RR_MAX)).select(key, F.row_number().over(w).alias("i"), "rr")


def differences(rr: DataFrame, key: str) -> DataFrame:
    """``rr`` with d (difference to the value before), d1 (the difference before d), before, after."""
    w = Window.partitionBy(key).orderBy("i")
    return rr.withColumns({"before": F.lag("rr").over(w), "after": F.lead("rr").over(w)}).withColumn("d", F.col("rr") - F.col("before")).withColumn("d1", F.lag("d").over(w))


def nonzero(x: Column) -> Column:
    return F.nullif(x, F.lit(0.0))


def hrv(rr: DataFrame, key: str, least: int = 4) -> DataFrame:
    """n_rr and the seven HRV measures (seconds), for keys with ``least`` values."""
    a = differences(rr, key).groupBy(key).agg(F.count("*").alias("n_rr"), F.avg("rr").alias("m"), F.stddev_samp("rr").alias("sdnn"), F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rmssd"), F.avg((F.abs("d") > 50).cast("double")).alias("pNN50"))
    a = a.where(F.col("n_rr") >= least)
    inner = 2 * F.col("sdnn") * F.col("sdnn") - F.col("rmssd") * F.col("rmssd") / 2
    sd1, sd2 = F.col("rmssd") / F.sqrt(F.lit(2.0)), F.when(inner > 0, F.sqrt(inner))
    return a.select(key, "n_rr", (F.col("m") / 1000).alias("meanRR"), (F.col("sdnn") / 1000).alias("SDNN"), (F.col("rmssd") / 1000).alias("RMSSD"), "pNN50", (sd1 / 1000).alias("SD1"), (sd2 / 1000).alias("SD2"), (sd1 / nonzero(sd2)).alias("SD1_SD2"))


def rhythm(rr: DataFrame, key: str, least: int = 5) -> DataFrame:
    """Rhythm measures in seconds: n_rr, mean_hr, rmssd, cv, pnn, shannon (entropy of the jumps in 16 bins of [-0.4, 0.4] over that of an
    even spread; 0 without a jump there), and the rule's label (1, 0)."""
    x = differences(rr.withColumn("rr", F.col("rr") / 1000), key)
    jump = F.least(F.greatest(F.floor((F.col("d") + 0.4) / 0.05), F.lit(0)), F.lit(15))
    bins = x.where(F.abs("d") <= 0.4).groupBy(key, jump.alias("b")).agg(F.count("*").alias("n"))
    bins = bins.groupBy(key).agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.ln("n")).alias("s")).select(key, ((F.ln("t") - F.col("s") / F.col("t")) / F.ln(F.lit(16.0))).alias("shannon"))
    a = x.groupBy(key).agg(F.count("*").alias("n_rr"), (60 / F.avg("rr")).alias("mean_hr"), F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rmssd"), (F.stddev_pop("rr") / nonzero(F.avg("rr"))).alias("cv"), F.avg((F.abs("d") > 0.05).cast("double")).alias("pnn"))
    a = a.where((F.col("n_rr") >= least) & F.col("mean_hr").between(30, 220)).join(bins, key, "left").withColumn("shannon", F.coalesce("shannon", F.lit(0.0)))
    return a.withColumn("label", af_rule(F.col("cv"), F.col("pnn")))


def af_rule(cv: Column, pnn: Column, cv_limit: float = 0.10, pnn_limit: float = 0.30) -> Column:
    return F.when(cv.isNull() | pnn.isNull(), F.lit(None)).otherwise(((cv >= cv_limit) | (pnn >= pnn_limit)).cast("int"))


def shannon(rr: DataFrame, key: str) -> DataFrame:
    """Entropy over the fixed bins of the plausible range, divided by that of an even spread."""
    b = F.least(F.floor((F.col("rr") - RR_MIN) / BIN), F.lit(BINS - 1)).alias("b")
    n = rr.select(key, b).groupBy(key, "b").agg(F.count("*").alias("n"))
    a = n.groupBy(key).agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.ln("n")).alias("s"))
    return a.where("t >= 2").select(key, ((F.ln("t") - F.col("s") / F.col("t")) / F.ln(F.lit(float(BINS)))).alias("rrShannon"))


def turning_points(rr: DataFrame, key: str) -> DataFrame:
    up = (F.col("rr") > F.col("before")) & (F.col("rr") > F.col("after"))
    down = (F.col("rr") < F.col("before")) & (F.col("rr") < F.col("after"))
    a = differences(rr, key).groupBy(key).agg(F.count("*").alias("n"), F.count_if(up | down).alias("t"))
    return a.where("n >= 3").select(key, (F.col("t") / (F.col("n") - 2)).alias("TPR"))


def lorenz(rr: DataFrame, key: str, cell: float = 25.0, origin: float = 80.0) -> DataFrame:
    x = differences(rr, key)
    both = F.col("d1").isNotNull()
    cells = F.when(both, F.struct(F.floor(F.col("d") / cell), F.floor(F.col("d1") / cell)))
    near = F.when(both, ((F.abs("d") <= origin) & (F.abs("d1") <= origin)).cast("double"))
    a = x.groupBy(key).agg(F.countDistinct(cells).alias("Lorenz_occ"), F.avg(near).alias("Lorenz_origin"), F.stddev_pop("d").alias("dRR_SD"), F.count("d").alias("n"))
    return a.where("n >= 2").drop("n")


def robust(rr: DataFrame, key: str) -> DataFrame:
    x = differences(rr, key)
    a = x.groupBy(key).agg(F.avg("rr").alias("m"), F.stddev_samp("rr").alias("s"), F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("r"), F.percentile("d", 0.5).alias("med"), F.count("*").alias("n"))
    mad = x.join(a.select(key, "med"), key).groupBy(key).agg(F.percentile(F.abs(F.col("d") - F.col("med")), 0.5).alias("dRR_MAD"))
    return a.where("n >= 3").join(mad, key).select(key, (F.col("s") / nonzero(F.col("m"))).alias("RR_CV"), (F.col("r") / nonzero(F.col("m"))).alias("RMSSDn"), "dRR_MAD")


def dfa(rr: DataFrame, key: str, low: int = 4, high: int = 16) -> DataFrame:
    """DFA alpha 1: box residuals from regr_syy - regr_sxy^2 / regr_sxx, then the log-log slope. A row meets at most
    high - low + 1 box sizes."""
    n = Window.partitionBy(key)
    y = rr.withColumn("n", F.count("*").over(n)).where("n >= 12").withColumn("m", F.avg("rr").over(n))
    y = y.withColumn("y", F.sum(F.col("rr") - F.col("m")).over(n.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)))
    boxes = y.select(key, "n", "i", "y", F.explode(F.sequence(F.lit(low), F.least(F.lit(high), F.floor(F.col("n") / 3).cast("int")))).alias("s"))
    boxes = boxes.withColumn("b", F.floor((F.col("i") - 1) / F.col("s"))).where(F.col("b") < F.floor(F.col("n") / F.col("s")))
    t = ((F.col("i") - 1) % F.col("s")).cast("double")
    per = boxes.groupBy(key, "s", "b").agg(F.regr_syy("y", t).alias("syy"), F.regr_sxy("y", t).alias("sxy"), F.regr_sxx("y", t).alias("sxx"))
    f = per.groupBy(key, "s").agg((F.sum(F.greatest(F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx"), F.lit(0.0))) / (F.count("*") * F.first("s"))).alias("f2")).where("f2 > 0")
    fit = f.groupBy(key).agg(F.regr_slope(F.ln("f2") / 2, F.ln("s")).alias("DFA_a1"), F.count("*").alias("k"))
    return fit.where("k >= 3").drop("k")

"""Relational operators on window tables: alignment of tables, audits, reliability, folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.operators.metrics import auc, cuts, quantiles, running, zero_null

# Key and channel names.
KEY = ("patient", "win_idx")
EXPERTS = ("cecg", "ppg", "bcg")
CHANNELS = {"cecg": ("cecg",), "ppg": ("ppg1", "ppg2"), "bcg": ("bcg1", "bcg2")}


def expert_columns(columns: Sequence[str], modality: str) -> list[str]:
    """A modality's own feature columns, without quality columns; an unknown modality is an error."""
    if modality not in CHANNELS:
        raise ValueError(f"unknown modality {modality!r}")
    return [c for c in columns if any(c.startswith(f"{s}_") for s in CHANNELS[modality])]


def gate_columns(columns: Sequence[str], kind: str = "all") -> list[str]:
    """Quality columns: the composites only, or all others and the cross-modal ones."""
    own = [c for c in columns if c.startswith("sqi_")]
    return [c for c in own if c.endswith("_composite") == (kind == "composite")]


def modality_of(column: str) -> str | None:
    """The modality that owns a quality column; none for cross-modal ones."""
    for m, channels in CHANNELS.items():
        if any(column.startswith(f"sqi_{s}_") for s in (*channels, m)):
            return m
    return None


def no_informative_gate(columns: Sequence[str], informative: Sequence[str]) -> None:
    """The gate must not see columns that tell the rhythm itself."""
    if bad := [c for c in gate_columns(columns) if any(c.endswith(f"_{x}") for x in informative)]:
        raise ValueError(f"rhythm columns in the gate: {bad}")


def with_af_flag(df: DataFrame, af_patients: DataFrame, key: str = "patient") -> DataFrame:
    """AF = 1 for patients on the list."""
    flags = af_patients.select(key).distinct().withColumn("AF", F.lit(1))
    return df.join(flags, key, "left").withColumn("AF", F.coalesce("AF", F.lit(0)))


def without_patients(df: DataFrame, excluded: DataFrame, key: str = "patient") -> DataFrame:
    return df.join(excluded.select(key).distinct(), key, "left_anti")


def aligned(features: DataFrame, other: DataFrame, settings: Sequence[str] = ("window_s", "hop_s")) -> DataFrame:
    """Left join on patient and window. If both tables carry window settings these must agree: a different grid is an error."""
    both = [c for c in settings if c in features.columns and c in other.columns]
    if both:
        a, b = (t.select(*both).distinct() for t in (features, other))
        if a.exceptAll(b).take(1) or b.exceptAll(a).take(1):
            raise ValueError("the tables have different window grids")
    return features.join(other.drop(*both), list(KEY), "left")


def joined_by_slot(windows: DataFrame, reference: DataFrame, seconds: float) -> DataFrame:
    """Overlapping windows to tumbling reference windows by floor(t_start / seconds)."""
    w = windows.withColumn("slot", F.floor(F.col("t_start_s") / seconds).cast("int"))
    return w.join(reference.withColumnRenamed("win_idx", "slot"), ["patient", "slot"], "left")


def best_channel(long: DataFrame, keys: Sequence[str], error: str) -> DataFrame:
    """Per window and modality the channel of smallest error (missing last, then by name); valid if any channel is."""
    pick = F.min_by(F.struct(F.col("channel"), F.col(error)), F.struct(F.col(error).isNull(), F.col(error), F.col("channel")))
    return long.groupBy(*keys).agg(pick.alias("b"), F.bool_or("valid").alias("valid")).select(*keys, F.col("b.channel").alias("channel"), F.col(f"b.{error}").alias(error), "valid")


def fold_values(df: DataFrame, fold: str) -> list:
    """The distinct folds, in order: one value for each group that is left out."""
    return sorted(r[0] for r in df.select(fold).where(F.col(fold).isNotNull()).distinct().collect())


def validity_coverage(df: DataFrame, modalities: Sequence[str] = EXPERTS, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, modality, coverage, n): the share of windows in which a modality is valid; a missing flag counts as invalid."""
    flags = F.explode(F.array(*[F.struct(F.lit(m).alias("modality"), F.coalesce(F.col(f"rel_{m}_valid"), F.lit(False)).alias("ok")) for m in modalities]))
    return df.select(*keys, flags.alias("x")).groupBy(*keys, "x.modality").agg(F.avg(F.col("x.ok").cast("double")).alias("coverage"), F.count("*").alias("n"))


def with_valid_target(df: DataFrame, modality: str, target: str) -> DataFrame:
    """Windows in which the modality is valid and its target error finite."""
    e = F.col(target)
    return df.where(F.coalesce(F.col(f"rel_{modality}_valid"), F.lit(False)) & e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))


#: Ranks of a bucket, by which a rank finds its value.
BUCKET = 4096


def others_quantile(df: DataFrame, column: str, fold: str, q: float) -> DataFrame:
    """(fold, value): for each fold the exact linear q-quantile of the column over the rows of all other folds; null without any.

    No row is copied to other folds. All values are ranked once; the k-th value of the others has the rank k + m, where m counts the fold's
    own values with fewer than k of the others' before them, and is read where that rank lies."""
    one = df.select(F.col(fold).alias("f"), F.col(column).alias("v"))
    own = one.where("v IS NOT NULL AND f IS NOT NULL").groupBy("f", "v").agg(F.count("*").alias("n"))
    every = running(one.where("v IS NOT NULL").groupBy("v").agg(F.count("*").alias("m")), [], "v", ["m"])
    ties = Window.partitionBy("v").orderBy("f").rowsBetween(Window.unboundedPreceding, -1)
    x = running(own, ["f"], "v", ["n"]).join(every.select("v", "m_before"), "v")
    x = x.select("f", "n", (F.col("m_before") + F.coalesce(F.sum("n").over(ties), F.lit(0)) - F.col("n_before")).alias("before"))
    total = every.agg(F.coalesce(F.sum("m"), F.lit(0)).alias("total"))  # one row
    folds = one.where("f IS NOT NULL").groupBy("f").agg(F.count("v").alias("own")).crossJoin(F.broadcast(total))
    at = F.when(F.col("total") > F.col("own"), q * (F.col("total") - F.col("own") - 1))
    folds = folds.withColumns({"w": at - F.floor(at), "low": F.floor(at) + 1, "high": F.ceil(at) + 1}).where("low IS NOT NULL")
    under = lambda k: F.sum(F.when(F.col("before") < F.col(k), F.col("n")).otherwise(F.lit(0)))
    moved = folds.join(x, "f", "left").groupBy("f", "w", "low", "high").agg((F.col("low") + F.coalesce(under("low"), F.lit(0)) - 1).alias("a"), (F.col("high") + F.coalesce(under("high"), F.lit(0)) - 1).alias("b"))
    wanted = moved.select("f", "w", F.explode(F.array(F.struct(F.lit(0).alias("end"), F.col("a").alias("rank")), F.struct(F.lit(1).alias("end"), F.col("b").alias("rank")))).alias("e")).select("f", "w", "e.*").withColumn("bucket", F.floor(F.col("rank") / BUCKET))
    spans = every.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("m_before") / BUCKET), F.floor((F.col("m_before") + F.col("m") - 1) / BUCKET))))
    got = wanted.join(spans, "bucket").where((F.col("rank") >= F.col("m_before")) & (F.col("rank") < F.col("m_before") + F.col("m")))
    ends = got.groupBy("f", "w").agg(*[F.max(F.when(F.col("end") == i, F.col("v"))).alias(k) for i, k in enumerate("ab")])
    return ends.select(F.col("f").alias(fold), (F.col("a") + (F.col("b") - F.col("a")) * F.col("w")).alias("value"))


def with_sentinel(df: DataFrame, columns: Sequence[str], fold: str | None = None, q: float = 0.95) -> DataFrame:
    """Missing errors become the q-quantile of the learning rows (of the other folds if ``fold`` names a column, else of all); 1 without any."""
    if fold is None:
        x = df.crossJoin(F.broadcast(cuts(df, {f"_{c}": (c, q) for c in columns})))  # one row
    else:
        x = df
        for c in columns:
            s = others_quantile(df, c, fold, q).select(F.col(fold).alias("_f"), F.col("value").alias(f"_{c}"))
            x = x.join(s, F.col(fold) == F.col("_f"), "left").drop("_f")
    return x.withColumns({c: F.coalesce(c, f"_{c}", F.lit(1.0)) for c in columns}).drop(*[f"_{c}" for c in columns])


def summarize_quality(quality: DataFrame, key: str = "patient") -> DataFrame:
    """Mean confidence, share under 0.8, share with fewer than two strong detectors, windows."""
    under = F.coalesce((F.col("gt_conf") < 0.8).cast("double"), F.lit(0.0))
    return quality.groupBy(key).agg(F.avg("gt_conf").alias("mean_conf"), F.avg(under).alias("frac_low"), F.avg((F.col("gt_n_strong") < 2).cast("double")).alias("frac_weak"), F.count("*").alias("n"))


def completeness(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Mean share of missing values, rows all missing, rows with any missing. One pass."""
    missing = [F.col(c).isNull().cast("int") for c in columns]
    n = missing[0]
    for m in missing[1:]:
        n = n + m
    return df.withColumn("_m", n).groupBy(*keys).agg(F.avg(F.col("_m") / len(columns)).alias("missing_share"), F.count_if(F.col("_m") == len(columns)).alias("rows_empty"), F.count_if(F.col("_m") > 0).alias("rows_partial"), F.count("*").alias("n"))


def z_over(column: Column, w) -> Column:
    """z score by the sample deviation over a window; 0 without spread."""
    s = F.stddev_samp(column).over(w)
    return F.when(s > 0, (column - F.avg(column).over(w)) / F.nullif(s, F.lit(0.0))).otherwise(F.lit(0.0))


def patient_badness(per_patient: DataFrame, parts: dict[str, Column]) -> DataFrame:
    """(patient, parts, badness): the sum of z scores over all patients. Means and deviations come from one aggregated row."""
    p = per_patient.select("patient", *[c.alias(k) for k, c in parts.items()])
    s = p.agg(*[F.avg(k).alias(f"_m_{k}") for k in parts], *[F.stddev_samp(k).alias(f"_s_{k}") for k in parts])
    x = p.crossJoin(F.broadcast(s))  # one row
    z = [F.coalesce((F.col(k) - F.col(f"_m_{k}")) / zero_null(F.col(f"_s_{k}")), F.lit(0.0)) for k in parts]
    total = z[0]
    for v in z[1:]:
        total = total + v
    return x.select("patient", *parts, total.alias("badness"))


def weight_report(df: DataFrame, weights: Sequence[str], key: str = "patient") -> DataFrame:
    """Per weight: mean, overall deviation, mean of the deviations within patients, and its ratio to the mean."""
    long = df.select(key, F.explode(F.array(*[F.struct(F.lit(w).alias("expert"), F.col(w).alias("w")) for w in weights])).alias("x")).select(key, "x.*")
    within = long.groupBy("expert", key).agg(F.stddev_samp("w").alias("s")).groupBy("expert").agg(F.avg("s").alias("std_within"))
    whole = long.groupBy("expert").agg(F.avg("w").alias("mean"), F.stddev_samp("w").alias("std"))
    return whole.join(within, "expert").withColumn("cv", F.col("std_within") / zero_null(F.col("mean")))


def exclusion_sweep(df: DataFrame, badness: DataFrame, score: str, label: str, ks: Sequence[int]) -> DataFrame:
    """(k, auc, n_pos, n_neg) without the k worst patients. Only the worst max(ks) patients are kept apart, a short list."""
    worst = badness.orderBy(F.col("badness").desc(), "patient").limit(max(ks))
    place = worst.select("patient", F.row_number().over(Window.orderBy(F.col("badness").desc(), "patient")).alias("place"))
    x = df.join(F.broadcast(place), "patient", "left").withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).where(F.coalesce(F.col("place") > F.col("k"), F.lit(True)))
    return auc(x, score, label, ["k"])


def codegradation(df: DataFrame, qualities: Sequence[str], anchor: str, q: float = 0.10) -> DataFrame:
    """Per modality: how much likelier it is bad (at most its q-quantile) where the anchor is, as a ratio to q."""
    x = df.crossJoin(F.broadcast(cuts(df, {f"_{c}": (c, q) for c in qualities})))  # one row
    bad = F.col(anchor) <= F.col(f"_{anchor}")
    share = [F.struct(F.lit(c).alias("modality"), F.avg(F.when(bad, (F.col(c) <= F.col(f"_{c}")).cast("double"))).alias("p")) for c in qualities if c != anchor]
    return x.agg(F.array(*share).alias("a")).select(F.explode("a").alias("r")).select("r.modality", F.col("r.p").alias("p_bad_given_bad"), (F.col("r.p") / q).alias("lift"))


def hard_easy(df: DataFrame, by: str, columns: Sequence[str]) -> DataFrame:
    """Per column: medians in the hardest and easiest quarter by ``by`` (high is hard), and how well it separates them (AUC)."""
    q = cuts(df, {"_low": (by, 0.25), "_high": (by, 0.75)})
    x = df.crossJoin(F.broadcast(q)).withColumn("hard", F.when(F.col(by) >= F.col("_high"), 1).when(F.col(by) <= F.col("_low"), 0)).where(F.col("hard").isNotNull())
    long = x.select("hard", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("v")) for c in columns])).alias("f")).select("hard", "f.*")
    med = quantiles(long, "v", [0.5], ["feature", "hard"])
    med = med.groupBy("feature").agg(F.max(F.when(F.col("hard") == 1, F.col("value"))).alias("median_hard"), F.max(F.when(F.col("hard") == 0, F.col("value"))).alias("median_easy"))
    return med.join(auc(long, "v", "hard", ["feature"]).select("feature", F.col("auc").alias("separation")), "feature")


def percentile_pick(df: DataFrame, column: str, ps: Sequence[float], tie: Sequence[str]) -> DataFrame:
    """For each p the row whose value is nearest to the p-quantile; ties by ``tie``."""
    x = df.crossJoin(F.broadcast(quantiles(df, column, ps).select(F.col("q").alias("p"), F.col("value").alias("_c"))))  # len(ps) rows
    best = x.groupBy("p").agg(F.min_by(F.struct(*df.columns), F.struct(F.abs(F.col(column) - F.col("_c")), *tie)).alias("b"))
    return best.select("p", "b.*")


def oracle_pick(df: DataFrame, p: Sequence[str], label: str) -> DataFrame:
    """The expert nearest to the truth (first of equals), its score, and whether a wrong mean could have been rescued."""
    err = [F.abs(F.col(c) - F.col(label)) for c in p]
    best = F.array_min(F.array(*[F.struct(e.alias("e"), F.lit(i).alias("i"), F.col(c).alias("p"), F.lit(c).alias("expert")) for i, (e, c) in enumerate(zip(err, p, strict=True))]))
    mean = sum((F.col(c) for c in p[1:]), F.col(p[0])) / len(p)
    wrong = (mean >= 0.5).cast("int") != F.col(label)
    right = F.lit(False)
    for c in p:
        right = right | ((F.col(c) >= 0.5).cast("int") == F.col(label))
    return df.withColumns({"oracle_expert": best["expert"], "oracle_p": best["p"], "rescuable": wrong & right})


def loo_means(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Per key: mean and population deviation of each column over all other keys, from totals less the key's own sums."""
    own = df.groupBy(key).agg(*[f for c in columns for f in (F.count(c).alias(f"n_{c}"), F.coalesce(F.sum(c), F.lit(0)).alias(f"s_{c}"), F.coalesce(F.sum(F.col(c) * F.col(c)), F.lit(0)).alias(f"q_{c}"))])
    tot = own.agg(*[F.sum(f"{k}_{c}").alias(f"t{k}_{c}") for c in columns for k in "nsq"])
    x = own.crossJoin(F.broadcast(tot))  # one row
    out = [key]
    for c in columns:
        n, s, q = (F.col(f"t{k}_{c}") - F.col(f"{k}_{c}") for k in "nsq")
        m = s / zero_null(n.cast("double"))
        out += [m.alias(f"mean_{c}"), F.sqrt(F.greatest(q / zero_null(n.cast("double")) - m * m, F.lit(0.0))).alias(f"std_{c}")]
    return x.select(*out)

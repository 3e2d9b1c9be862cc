"""All registered queries of the signal operators, with their SQL twins.

The driver's tables stand in for signals: consecutive events of a user give RR series, embeddings are windows of 64 samples,
and scores, errors and qualities of three experts are derived from event ids by integer arithmetic that both engines share.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions import native as N
from pulsegrid.operators import metrics as M
from pulsegrid.operators import rr as R
from pulsegrid.operators import spectral as S
from pulsegrid.operators import tables as T
from pulsegrid.operators import windows as W

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
P, ERR, QUAL = ("p_cecg", "p_ppg", "p_bcg"), ("e_cecg", "e_ppg", "e_bcg"), ("q_cecg", "q_ppg", "q_bcg")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to 6 places: sums of doubles differ in their last bits from engine to engine."""
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# Inputs


def events(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet")


def rr_table(spark: SparkSession, d: str) -> DataFrame:
    g = R.gaps(events(spark, d).select("user_id", "event_id", "ts"), "user_id", ["ts", "event_id"], W.micros("ts"))
    rr = g.withColumn("rr", (250 + F.expr("gap_us div 1000") % 1850).cast("double"))
    return R.plausible(rr, "user_id", ["event_id"])


RR_SQL = """g AS (SELECT user_id, event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events),
    raw AS (SELECT user_id, event_id, CAST(250 + (gap // 1000) % 1850 AS DOUBLE) AS rr FROM g WHERE gap IS NOT NULL),
    rr AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, rr FROM raw WHERE rr > 300 AND rr < 2000),
    e AS (SELECT *, rr - lag(rr) OVER w AS d, lag(rr) OVER w AS before, lead(rr) OVER w AS after FROM rr WINDOW w AS (PARTITION BY user_id ORDER BY i)),
    x AS (SELECT *, lag(d) OVER (PARTITION BY user_id ORDER BY i) AS d1 FROM e)"""


def samples(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))


LONG_SQL = """s AS (SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS n, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
    mom AS (SELECT vec_id, count(*) AS n, avg(v) AS m FROM s GROUP BY vec_id),
    c AS (SELECT s.vec_id, s.n, s.v, s.v - mom.m AS cv FROM s JOIN mom USING (vec_id))"""


def dft_sql(column: str, name: str) -> str:
    return f"""{name} AS (SELECT vec_id, k, (re * re + im * im) / 64 AS psd FROM (
        SELECT vec_id, k, sum({column} * cos(2 * pi() * (k * n % 64) / 64e0)) AS re, sum({column} * sin(2 * pi() * (k * n % 64) / 64e0)) AS im
        FROM c, (SELECT unnest(range(33)) AS k) GROUP BY vec_id, k))"""


def uniform(factor: int) -> Column:
    return ((F.col("event_id") + 1) * factor % 2147483647) / F.lit(2147483647.0)


def experts(spark: SparkSession, d: str) -> DataFrame:
    """patient, win_idx, y, scores p_*, errors e_* (some missing), qualities q_* (some missing), conf."""
    e = events(spark, d).select("user_id", "event_id")
    y = (F.col("user_id") % 2).cast("int")
    out = {"y": y}
    for i, (m, f) in enumerate(zip(("cecg", "ppg", "bcg"), (48271, 69621, 16807), strict=True)):
        out[f"p_{m}"] = 0.7 * uniform(f) + 0.3 * y
        out[f"e_{m}"] = F.when((F.col("event_id") + i) % 11 != 0, 5 * uniform(f + 2))
        out[f"q_{m}"] = F.when((F.col("event_id") + i) % 13 != 0, uniform(f + 4))
    out["conf"] = uniform(39373)
    return e.select(F.col("user_id").alias("patient"), F.col("event_id").alias("win_idx"), *[c.alias(k) for k, c in out.items()])


def u_sql(f: int) -> str:
    return f"(CAST((event_id + 1) * {f} % 2147483647 AS DOUBLE) / 2147483647e0)"


X_SQL = "ex AS (SELECT user_id AS patient, event_id AS win_idx, CAST(user_id % 2 AS INTEGER) AS y, " + ", ".join(
    f"0.7e0 * {u_sql(f)} + 0.3e0 * CAST(user_id % 2 AS INTEGER) AS p_{m}, CASE WHEN (event_id + {i}) % 11 <> 0 THEN 5 * {u_sql(f + 2)} END AS e_{m}, CASE WHEN (event_id + {i}) % 13 <> 0 THEN {u_sql(f + 4)} END AS q_{m}"
    for i, (m, f) in enumerate(zip(("cecg", "ppg", "bcg"), (48271, 69621, 16807), strict=True))
) + f", {u_sql(39373)} AS conf FROM events)"


# Windows


@query("""SELECT user_id, CAST(w AS TIMESTAMP) AS win_start, count(*) AS n FROM (
        SELECT user_id, ts, unnest([time_bucket(INTERVAL 12 HOUR, ts), time_bucket(INTERVAL 12 HOUR, ts) - INTERVAL 12 HOUR]) AS w FROM events)
    WHERE ts < w + INTERVAL 1 DAY GROUP BY ALL""")
def win_sliding_counts(spark, d):
    w = W.event_windows(events(spark, d).select("user_id", "ts"), ["user_id"], "1 day", "12 hours")
    return w.groupBy("user_id", F.col("win_start").cast("timestamp_ntz").alias("win_start")).agg(F.count("*").alias("n"))


@query("SELECT user_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS win_start, count(*) AS n FROM events GROUP BY ALL")
def win_tumbling_gt(spark, d):
    w = W.event_windows(events(spark, d).select("user_id", "ts"), ["user_id"], "1 day")
    return w.groupBy("user_id", F.col("win_start").cast("timestamp_ntz").alias("win_start")).agg(F.count("*").alias("n"))


@query(f"""WITH {LONG_SQL}, w AS (SELECT unnest(range(4)) AS win_idx)
    SELECT vec_id, CAST(win_idx AS INTEGER) AS win_idx, round(win_idx * 0.25e0, 6) AS t_start_s, count(*) AS n, round(sum(v), 6) AS total
    FROM s, w WHERE n >= win_idx * 16 AND n < win_idx * 16 + 16 GROUP BY ALL""")
def win_index(spark, d):
    w = W.index_windows(samples(spark, d).select("vec_id", "x"), 16, 16, "x", 64.0)
    return rounded(w.select("vec_id", "win_idx", "t_start_s", F.size("x").cast("long").alias("n"), S.added(F.col("x")).alias("total")))


@query(f"""WITH {X_SQL} SELECT patient, win_idx, round(coalesce(lag(p_cecg) OVER w, p_cecg), 6) AS p_cecg_prev1, round(coalesce(lead(p_cecg) OVER w, p_cecg), 6) AS p_cecg_next1,
    round(coalesce(lag(p_cecg, 2) OVER w, p_cecg), 6) AS p_cecg_prev2, round(coalesce(lead(p_cecg, 2) OVER w, p_cecg), 6) AS p_cecg_next2
    FROM ex WINDOW w AS (PARTITION BY patient ORDER BY win_idx)""")
def neighbor_context(spark, d):
    return rounded(W.neighbor_context(experts(spark, d).select("patient", "win_idx", "p_cecg"), ["p_cecg"], 2).drop("p_cecg"))


STREAM_SQL = f"""WITH {X_SQL}, f AS (SELECT patient, win_idx, y, win_idx * 15e0 AS t, sum(CASE WHEN (p_cecg + p_ppg + p_bcg) / 3 >= 0.5e0 THEN 1 ELSE 0 END)
        OVER (PARTITION BY patient ORDER BY win_idx ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS hits FROM ex)"""


def alarm_rows(spark: SparkSession, d: str) -> DataFrame:
    x = experts(spark, d).withColumn("t", F.col("win_idx") * 15.0)
    return W.k_of_m(x, (F.col("p_cecg") + F.col("p_ppg") + F.col("p_bcg")) / 3 >= 0.5)


@query(STREAM_SQL + " SELECT patient, max(y) AS y, min(CASE WHEN hits >= 2 THEN t END) AS first_alarm, min(CASE WHEN hits >= 2 THEN t END) IS NOT NULL AS flagged FROM f GROUP BY patient")
def stream_k_of_m(spark, d):
    return W.alarm_report(alarm_rows(spark, d), "y", "t")


@query(STREAM_SQL + """, r AS (SELECT patient, max(y) AS y, min(CASE WHEN hits >= 2 THEN t END) AS a FROM f GROUP BY patient)
    SELECT round(avg(CASE WHEN y = 1 THEN CAST(a IS NOT NULL AS INTEGER) END), 6) AS detection, round(quantile_cont(CASE WHEN y = 1 THEN a END, 0.5), 6) AS median_latency,
        count(*) FILTER (y <> 1 AND a IS NOT NULL) AS false_alarms, count(*) FILTER (y <> 1) AS controls FROM r""")
def alarm_summary(spark, d):
    return rounded(W.alarm_summary(W.alarm_report(alarm_rows(spark, d), "y", "t")))


@query(f"""WITH {X_SQL}, r AS (SELECT patient, win_idx, row_number() OVER (PARTITION BY patient ORDER BY win_idx) - 1 AS r, count(*) OVER (PARTITION BY patient) AS n FROM ex)
    SELECT DISTINCT patient, win_idx FROM r, (SELECT unnest(range(4)) AS i) WHERE r = CAST(floor(i * (n - 1) / 3e0) AS BIGINT)""")
def flagged_spread(spark, d):
    return W.evenly_spread(experts(spark, d).select("patient", "win_idx"), "patient", "win_idx", 4)


# Window features


@query(f"""WITH {LONG_SQL} SELECT vec_id, round(avg(v), 6) AS mean, round(sqrt(avg(cv * cv)), 6) AS std, round(avg(cv * cv * cv) / pow(avg(cv * cv), 1.5), 6) AS skew,
    round(avg(pow(cv, 4)) / pow(avg(cv * cv), 2) - 3, 6) AS kurtosis, round(sqrt(avg(v * v)), 6) AS rms, round(max(v) - min(v), 6) AS range FROM c GROUP BY vec_id""")
def feat_time_domain(spark, d):
    s = samples(spark, d).select("vec_id", "x", S.moments(F.col("x")).alias("m"))
    m = {k: F.col(f"m.{k}") for k in ("mean", "m2", "m3", "m4")}
    pos = F.when(m["m2"] > 0, m["m2"])
    return rounded(s.select("vec_id", m["mean"].alias("mean"), F.sqrt(m["m2"]).alias("std"), (m["m3"] / F.pow(pos, 1.5)).alias("skew"), (m["m4"] / (pos * pos) - 3).alias("kurtosis"), F.sqrt(S.mean_of(F.transform("x", lambda v: v * v))).alias("rms"), (F.array_max("x") - F.array_min("x")).alias("range")))


@query(f"""WITH {LONG_SQL} SELECT vec_id, round(avg(pow(cv, 4)) / pow(avg(cv * cv), 2) - 3, 6) AS "kSQI", round(avg(cv * cv * cv) / pow(avg(cv * cv), 1.5), 6) AS "sSQI" FROM c GROUP BY vec_id""")
def sqi_ksqi_ssqi(spark, d):
    # The long form: the same moments as aggregates.
    long = samples(spark, d).select("vec_id", F.explode("x").alias("v"))
    return rounded(long.groupBy("vec_id").agg(F.kurtosis("v").alias("kSQI"), F.skewness("v").alias("sSQI")))


@query(f"""WITH {LONG_SQL}, q AS (SELECT vec_id, quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS p75, avg(v) AS mean, stddev_pop(v) AS std, min(v) AS lo, max(v) AS hi FROM s GROUP BY vec_id),
    h AS (SELECT vec_id, least(floor((v - lo) / ((hi - lo) / 32)), 31) AS b, count(*) AS k FROM s JOIN q USING (vec_id) GROUP BY ALL),
    en AS (SELECT vec_id, -sum(k / 64e0 * ln(k / 64e0)) / ln(count(*)) AS entropy FROM h GROUP BY vec_id)
    SELECT vec_id, round(any_value(q.mean), 6) AS mean, round(any_value(median), 6) AS median, round(any_value(std), 6) AS std, round(avg(abs(cv)), 6) AS mad,
        round(any_value(p25), 6) AS p25, round(any_value(p75), 6) AS p75, round(any_value(p75 - p25), 6) AS iqr, round(any_value(entropy), 6) AS entropy
    FROM c JOIN q USING (vec_id) JOIN en USING (vec_id) GROUP BY vec_id""")
def bcg_summary_stats(spark, d):
    from pulsegrid.functions.udfs import summary

    s = samples(spark, d).select("vec_id", summary()(F.col("x")).alias("f"))
    return rounded(s.select("vec_id", *[F.col(f"f.{k}").alias(k) for k in ("mean", "median", "std", "mad", "p25", "p75", "iqr", "entropy")]))


def spectra(spark: SparkSession, d: str, centred: bool = False) -> DataFrame:
    """Periodograms by batched FFT; ``spectral.power_spectrum`` is the same by definition, inside the JVM, at some thirty times the cost."""
    from pulsegrid.functions.udfs import spectrum

    return samples(spark, d).select("vec_id", spectrum(64, centred)(F.col("x")).alias("psd"))


def band(low: float, high: float) -> Column:
    return S.band_sum(F.col("psd"), 64, 64.0, low, high)


RAW, CEN = dft_sql("v", "f"), dft_sql("cv", "f")


@query(f"""WITH {LONG_SQL}, {RAW}, b AS (SELECT vec_id, sum(psd) FILTER (k >= 0.6 AND k < 3.6) AS pulse, sum(psd) FILTER (k >= 1 AND k < 6) AS resp, sum(psd) FILTER (k < 32) AS total FROM f GROUP BY vec_id)
    SELECT vec_id, round(pulse, 6) AS freq_puls, round(pulse / total, 6) AS freq_puls_norm, round(resp / total, 6) AS freq_resp_norm, round(pulse / resp, 6) AS freq_puls_resp FROM b""")
def feat_band_power(spark, d):
    s = spectra(spark, d)
    pulse, resp, total = band(0.6, 3.6), band(1.0, 6.0), band(0.0, 32.0)
    return rounded(s.select("vec_id", pulse.alias("freq_puls"), (pulse / M.zero_null(total)).alias("freq_puls_norm"), (resp / M.zero_null(total)).alias("freq_resp_norm"), (pulse / M.zero_null(resp)).alias("freq_puls_resp")))


@query(f"WITH {LONG_SQL}, {RAW}, t AS (SELECT vec_id, psd / sum(psd) OVER (PARTITION BY vec_id) AS p FROM f WHERE psd > 0) SELECT vec_id, round(-sum(p * ln(p)) / ln(count(*)), 6) AS spec_entropy FROM t GROUP BY vec_id")
def feat_spec_entropy(spark, d):
    return rounded(spectra(spark, d).select("vec_id", S.spread(F.col("psd")).alias("spec_entropy")))


@query(f"WITH {LONG_SQL}, {RAW}, r AS (SELECT vec_id, k, row_number() OVER (PARTITION BY vec_id ORDER BY psd DESC, k) AS r FROM f) SELECT vec_id, CAST(k AS DOUBLE) AS freq_dominant FROM r WHERE r = 1")
def feat_dominant_freq(spark, d):
    return spectra(spark, d).select("vec_id", (-S.band_peak(F.col("psd"), 64, 64.0, 0.0, 33.0)["k"]).cast("double").alias("freq_dominant"))


@query(f"""WITH {LONG_SQL}, {CEN}, t AS (SELECT vec_id, sum(psd) AS total, -sum(CASE WHEN psd > 0 THEN psd * ln(psd) END) AS h, count(*) FILTER (psd > 1e-24 * total) AS n FROM (SELECT *, sum(psd) OVER (PARTITION BY vec_id) AS total FROM f) GROUP BY vec_id),
    r AS (SELECT vec_id, k, psd, row_number() OVER (PARTITION BY vec_id ORDER BY psd DESC, k) AS r FROM f WHERE k >= 0.7 AND k <= 10)
    SELECT vec_id, CAST(k AS DOUBLE) AS f_dominant, round(psd, 6) AS f_magnitude, round(psd / total, 6) AS f_share, round((h / total + ln(total)) / ln(n), 6) AS f_entropy FROM r JOIN t USING (vec_id) WHERE r = 1""")
def bcg_freq_feats(spark, d):
    s = spectra(spark, d, centred=True).withColumn("top", S.band_peak(F.col("psd"), 64, 64.0, 0.7, 10.0, closed=True))
    return rounded(s.select("vec_id", (-F.col("top.k")).cast("double").alias("f_dominant"), F.col("top.p").alias("f_magnitude"), (F.col("top.p") / M.zero_null(S.added(F.col("psd")))).alias("f_share"), S.spread(F.col("psd")).alias("f_entropy")))


@query(f"WITH {LONG_SQL}, {CEN} SELECT vec_id, round(sum(psd) FILTER (k >= 1 AND k < 4) / sum(psd), 6) AS \"pSQI\" FROM f GROUP BY vec_id")
def sqi_psqi(spark, d):
    return rounded(spectra(spark, d, True).select("vec_id", F.coalesce(band(1.0, 4.0) / M.zero_null(S.added(F.col("psd"))), F.lit(0.0)).alias("pSQI")))


@query(f"WITH {LONG_SQL}, {CEN}, r AS (SELECT vec_id, k, row_number() OVER (PARTITION BY vec_id ORDER BY psd DESC, k) AS r FROM f WHERE k >= 1 AND k < 4) SELECT vec_id, CAST(60 * k AS DOUBLE) AS hr FROM r WHERE r = 1")
def hr_fft(spark, d):
    top = S.band_peak(F.col("psd"), 64, 64.0, 1.0, 4.0)
    return spectra(spark, d, True).select("vec_id", F.when(top["p"] > 0, -60.0 * top["k"]).alias("hr"))


@query(f"""WITH {LONG_SQL}, {RAW}, b AS (SELECT vec_id, sum(psd) FILTER (k >= 1 AND k < 3) AS lf, sum(psd) FILTER (k >= 3 AND k < 8) AS hf, sum(psd) FILTER (k >= 0.5 AND k < 8) AS total FROM f GROUP BY vec_id)
    SELECT vec_id, round(lf, 6) AS "LF", round(hf, 6) AS "HF", round(lf / hf, 6) AS "LF_HF", round(total, 6) AS total_power, round(lf / total, 6) AS "LF_norm" FROM b""")
def feat_legacy_lf_hf(spark, d):
    lf, hf, total = band(1.0, 3.0), band(3.0, 8.0), band(0.5, 8.0)
    return rounded(spectra(spark, d).select("vec_id", lf.alias("LF"), hf.alias("HF"), (lf / M.zero_null(hf)).alias("LF_HF"), total.alias("total_power"), (lf / M.zero_null(total)).alias("LF_norm")))


@query(f"WITH {LONG_SQL}, {CEN} SELECT vec_id, round(least(max(psd) / avg(psd) / 20, 1), 6) AS spec_conc FROM f WHERE k >= 0.7 AND k < 8 GROUP BY vec_id")
def sqi_spec_conc(spark, d):
    inside = F.filter("psd", lambda _, k: (k >= 0.7) & (k < 8.0))
    v = F.array_max(inside) / M.zero_null(S.mean_of(inside)) / 20
    return rounded(spectra(spark, d, True).select("vec_id", F.coalesce(F.least(v, F.lit(1.0)), F.lit(0.0)).alias("spec_conc")))


@query(f"""WITH {LONG_SQL}, z AS (SELECT vec_id, sum(cv * cv) AS z FROM c GROUP BY vec_id),
    r AS (SELECT a.vec_id, b.n - a.n AS lag, sum(a.cv * b.cv) / any_value(z.z) AS r FROM c a JOIN c b ON a.vec_id = b.vec_id AND b.n - a.n BETWEEN 5 AND 30 JOIN z ON z.vec_id = a.vec_id GROUP BY ALL),
    t AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY r DESC, lag) AS k FROM r)
    SELECT vec_id, round(r, 6) AS acf_peak, round(60 * 64e0 / lag, 6) AS acf_bpm FROM t WHERE k = 1""")
def feat_autocorr(spark, d):
    s = samples(spark, d).select("vec_id", F.array_max(F.transform(S.lag_correlation(F.col("x"), 5, 30), lambda r, i: F.struct(r.alias("r"), (-(i + 5)).alias("lag")))).alias("t"))
    return rounded(s.select("vec_id", F.col("t.r").alias("acf_peak"), (60 * 64.0 / -F.col("t.lag")).alias("acf_bpm")))


@query(f"""WITH {LONG_SQL}, sd AS (SELECT vec_id, 0.2e0 * stddev_pop(v) AS r FROM s GROUP BY vec_id),
    t AS (SELECT a.vec_id, a.n, a.v AS v0, lead(a.v) OVER w AS v1, lead(a.v, 2) OVER w AS v2 FROM s a WINDOW w AS (PARTITION BY a.vec_id ORDER BY a.n)),
    m AS (SELECT a.vec_id, count(*) FILTER (a.n < 62 AND b.n < 62) AS b, count(*) FILTER (a.n < 61 AND b.n < 61 AND abs(a.v2 - b.v2) < sd.r) AS a
        FROM t a JOIN t b ON a.vec_id = b.vec_id AND a.n <> b.n JOIN sd ON sd.vec_id = a.vec_id WHERE abs(a.v0 - b.v0) < sd.r AND abs(a.v1 - b.v1) < sd.r GROUP BY a.vec_id)
    SELECT vec_id, CASE WHEN a > 0 AND b > 0 THEN round(-ln((a / (61e0 * 60)) / (b / (62e0 * 61))), 6) END AS sample_entropy FROM m""")
def feat_sampen(spark, d):
    """Quadratic in the window: blocked comparisons in an Arrow function; nested array lambdas take some hundred times as long."""
    from pulsegrid.functions.udfs import scalar

    return rounded(samples(spark, d).select("vec_id", scalar("sample_entropy", 64)(F.col("x")).alias("sample_entropy")))


@query(f"WITH {LONG_SQL} SELECT vec_id, round(max(cv * cv) / avg(cv * cv), 6) AS papr_time FROM c GROUP BY vec_id")
def papr_time(spark, d):
    return rounded(samples(spark, d).select("vec_id", S.papr_time(F.col("x")).alias("papr_time")))


@query(f"WITH {LONG_SQL}, {CEN} SELECT vec_id, round(max(psd) / avg(psd), 6) AS papr_spectrum FROM f GROUP BY vec_id")
def papr_spectrum(spark, d):
    return rounded(samples(spark, d).select("vec_id", S.papr_spectrum(F.col("x"), 64).alias("papr_spectrum")))


@query(f"""WITH {LONG_SQL}, w AS (SELECT vec_id, n, v, lag(v) OVER o AS a, lead(v) OVER o AS b FROM s WINDOW o AS (PARTITION BY vec_id ORDER BY n))
    SELECT vec_id, count(*) FILTER (v > a AND v > b) AS n_peaks, CAST(sum(n) FILTER (v > a AND v > b) AS BIGINT) AS sum_at FROM w GROUP BY vec_id""")
def peaks_local_max(spark, d):
    s = samples(spark, d).select("vec_id", S.local_maxima(F.col("x")).alias("p"))
    return s.select("vec_id", F.size("p").cast("long").alias("n_peaks"), F.aggregate("p", F.lit(0).cast("long"), lambda a, i: a + i).alias("sum_at"))


@query(f"""WITH {LONG_SQL}, p AS (SELECT vec_id, n // 16 AS part, max(abs(v)) AS top FROM s GROUP BY ALL) SELECT vec_id, round(min(top) / max(top), 6) AS "aSQI" FROM p GROUP BY vec_id""")
def sqi_asqi(spark, d):
    return rounded(samples(spark, d).select("vec_id", S.amplitude_stability(F.col("x"), 16).alias("aSQI")))


# Alignment


@query(f"""WITH {LONG_SQL} SELECT vec_id, round(sum(v * (n + 3)) FILTER (n + 3 < 64), 6) AS delayed, round(sum(v * (n - 5)) FILTER (n >= 5), 6) AS advanced FROM s GROUP BY vec_id""")
def align_shift(spark, d):
    check = lambda x: S.added(F.transform(x, lambda v, i: v * i))
    return rounded(samples(spark, d).select("vec_id", check(N.shifted(F.col("x"), 3)).alias("delayed"), check(N.shifted(F.col("x"), -5)).alias("advanced")))


@query(f"""WITH {LONG_SQL} SELECT vec_id, round(sum(CASE WHEN vec_id % 2 = 0 THEN -v ELSE v END) FILTER (n >= 4 AND n < 58), 6) AS kept_sum, count(*) FILTER (n >= 4 AND n < 58) AS kept FROM s GROUP BY vec_id""")
def align_flip_trim(spark, d):
    x = N.trimmed(N.flipped(F.col("x"), F.col("vec_id") % 2 == 0), N.trim_samples(4 / 64, 64), N.trim_samples(6 / 64, 64))
    kept = F.filter(x, lambda v: v.isNotNull())
    return rounded(samples(spark, d).select("vec_id", S.added(kept).alias("kept_sum"), F.size(kept).cast("long").alias("kept")))


@query(f"""WITH {LONG_SQL}, sh AS (SELECT a.vec_id, a.n, coalesce(b.v, 0) AS v FROM s a LEFT JOIN s b ON a.vec_id = b.vec_id AND b.n = a.n - 2),
    p AS (SELECT vec_id, n, n + n * 3e0 / 63 AS pos FROM s)
    SELECT p.vec_id, round(sum(p.n * (CASE WHEN pos > 63 THEN 0 ELSE lo.v * (1 - (pos - floor(pos))) + coalesce(hi.v, 0) * (pos - floor(pos)) END)), 6) AS moment
    FROM p LEFT JOIN sh lo ON lo.vec_id = p.vec_id AND lo.n = CAST(floor(pos) AS BIGINT) LEFT JOIN sh hi ON hi.vec_id = p.vec_id AND hi.n = CAST(floor(pos) AS BIGINT) + 1 GROUP BY p.vec_id""")
def align_drift_interp(spark, d):
    from pulsegrid.sources.alignment import drifted

    y = drifted(F.col("x"), F.lit(2), F.lit(5))
    return rounded(samples(spark, d).select("vec_id", S.added(F.transform(y, lambda v, i: v * i)).alias("moment")))


@query(f"""WITH {LONG_SQL}, q AS (SELECT vec_id, min(v) AS lo, max(v) AS hi, quantile_cont(v, 0.5) > avg(v) AS flip FROM s GROUP BY vec_id)
    SELECT vec_id, round(sum(n * (2 * (v - lo) / (hi - lo) - 1)), 6) AS unit_moment, round(sum(n * ((v - lo) / (hi - lo))), 6) AS minmax_moment, any_value(flip) AS flip FROM s JOIN q USING (vec_id) GROUP BY vec_id""")
def normalised(spark, d):
    from pulsegrid.sources.recordings import auto_flipped

    check = lambda x: S.added(F.transform(x, lambda v, i: v * i))
    s = auto_flipped(samples(spark, d).withColumn("y", F.col("x")), "y")
    return rounded(s.select("vec_id", check(N.unit_range(F.col("x"))).alias("unit_moment"), check(N.min_max_range(F.col("x"))).alias("minmax_moment"), (F.col("x")[0] != F.col("y")[0]).alias("flip")))


# Channels


CHAN_SQL = "days AS (SELECT user_id, date_trunc('day', ts) AS day, event_type, avg(value) AS v FROM events GROUP BY ALL)"


def channel_days(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).select("user_id", F.date_trunc("day", F.col("ts").cast("timestamp")).alias("day"), "event_type", "value")
    return e.groupBy("user_id", "day").pivot("event_type", ["click", "error", "purchase", "signup", "view"]).agg(F.avg("value"))


@query(f"""WITH {CHAN_SQL} SELECT a.user_id, CASE WHEN stddev_pop(a.v) > 0 AND stddev_pop(b.v) > 0 THEN round(covar_pop(a.v, b.v) / (stddev_pop(a.v) * stddev_pop(b.v)), 6) ELSE 0 END AS xcorr
    FROM days a JOIN days b ON a.user_id = b.user_id AND a.day = b.day AND a.event_type = 'purchase' AND b.event_type = 'view' GROUP BY a.user_id""")
def xcorr_channels(spark, d):
    c = channel_days(spark, d).where("purchase IS NOT NULL AND view IS NOT NULL")
    return rounded(c.groupBy("user_id").agg(N.safe_corr("purchase", "view").alias("xcorr")))


@query("""WITH r AS (SELECT user_id, event_type, avg(value) AS v FROM events GROUP BY ALL), m AS (SELECT user_id, quantile_cont(v, 0.5) AS med, count(*) AS n FROM r GROUP BY user_id)
    SELECT user_id, CASE WHEN any_value(n) < 2 THEN any_value(n) ELSE count(*) FILTER (abs(v - med) <= 10) END AS n_agree,
        CASE WHEN any_value(n) < 2 THEN 0 ELSE round(count(*) FILTER (abs(v - med) <= 10) / any_value(n), 6) END AS confidence,
        any_value(n) >= 2 AND count(*) FILTER (abs(v - med) <= 10) >= 2 AS trustworthy, CASE WHEN any_value(n) >= 2 THEN round(avg(v) FILTER (abs(v - med) <= 10), 6) END AS consensus
    FROM r JOIN m USING (user_id) GROUP BY user_id""")
def xmodal_agreement(spark, d):
    r = events(spark, d).groupBy("user_id", "event_type").agg(F.avg("value").alias("v"))
    a = r.groupBy("user_id").agg(F.collect_list("v").alias("v"), F.percentile("v", 0.5).alias("med"))
    near, n = F.filter("v", lambda v: F.abs(v - F.col("med")) <= 10), F.size("v")
    k = F.size(near)
    return rounded(a.select("user_id", F.when(n < 2, n).otherwise(k).cast("long").alias("n_agree"), F.when(n < 2, F.lit(0.0)).otherwise(k / n).alias("confidence"), ((n >= 2) & (k >= 2)).alias("trustworthy"), F.when(n >= 2, S.mean_of(near)).alias("consensus")))


# RR series


@query(f"WITH {RR_SQL} SELECT user_id, CAST(i AS INTEGER) AS i, rr FROM rr")
def rr_series(spark, d):
    return rr_table(spark, d)


HRV_SQL = """h AS (SELECT user_id, count(*) AS n_rr, avg(rr) AS m, stddev_samp(rr) AS sdnn, sqrt(avg(d * d)) AS rmssd, avg(CAST(abs(d) > 50 AS INTEGER)) FILTER (d IS NOT NULL) AS p FROM x GROUP BY user_id HAVING count(*) >= 4),
    h2 AS (SELECT *, rmssd / sqrt(2e0) AS sd1, CASE WHEN 2 * sdnn * sdnn - rmssd * rmssd / 2 > 0 THEN sqrt(2 * sdnn * sdnn - rmssd * rmssd / 2) END AS sd2 FROM h)"""


@query(f"""WITH {RR_SQL}, {HRV_SQL} SELECT user_id, n_rr, round(m / 1000, 6) AS "meanRR", round(sdnn / 1000, 6) AS "SDNN", round(rmssd / 1000, 6) AS "RMSSD", round(p, 6) AS "pNN50",
    round(sd1 / 1000, 6) AS "SD1", round(sd2 / 1000, 6) AS "SD2", round(sd1 / sd2, 6) AS "SD1_SD2" FROM h2""")
def hrv_features(spark, d):
    return rounded(R.hrv(rr_table(spark, d), "user_id"))


RHYTHM_SQL = """y AS (SELECT user_id, i, rr / 1000 AS s, rr / 1000 - lag(rr / 1000) OVER (PARTITION BY user_id ORDER BY i) AS ds FROM rr),
    ry AS (SELECT user_id, count(*) AS n_rr, 60 / avg(s) AS mean_hr, sqrt(avg(ds * ds)) AS rmssd, stddev_pop(s) / avg(s) AS cv, avg(CAST(abs(ds) > 0.05e0 AS INTEGER)) FILTER (ds IS NOT NULL) AS pnn
        FROM y GROUP BY user_id HAVING count(*) >= 5 AND 60 / avg(s) BETWEEN 30 AND 220),
    jb AS (SELECT user_id, least(greatest(floor((ds + 0.4e0) / 0.05e0), 0), 15) AS b, count(*) AS n FROM y WHERE abs(ds) <= 0.4e0 GROUP BY ALL), js AS (SELECT user_id, (ln(sum(n)) - sum(n * ln(n)) / sum(n)) / ln(16e0) AS shannon FROM jb GROUP BY user_id)"""


@query(f"WITH {RR_SQL}, {RHYTHM_SQL} SELECT user_id, n_rr, round(mean_hr, 6) AS mean_hr, round(rmssd, 6) AS rmssd, round(cv, 6) AS cv, round(pnn, 6) AS pnn, round(coalesce(shannon, 0), 6) AS shannon FROM ry LEFT JOIN js USING (user_id)")
def rr_af_basic(spark, d):
    return rounded(R.rhythm(rr_table(spark, d), "user_id").drop("label"))


@query(f"WITH {RR_SQL}, {RHYTHM_SQL} SELECT user_id, CAST(cv >= 0.10 OR pnn >= 0.30 AS INTEGER) AS label FROM ry")
def af_rule(spark, d):
    return R.rhythm(rr_table(spark, d), "user_id").select("user_id", "label")


@query(f"""WITH {RR_SQL}, b AS (SELECT user_id, least(floor((rr - 300) / 50), 33) AS b, count(*) AS n FROM rr GROUP BY ALL), t AS (SELECT user_id, n / sum(n) OVER (PARTITION BY user_id) AS p, sum(n) OVER (PARTITION BY user_id) AS tot FROM b)
    SELECT user_id, round(-sum(p * ln(p)) / ln(34), 6) AS "rrShannon" FROM t WHERE tot >= 2 GROUP BY user_id""")
def rr_shannon(spark, d):
    return rounded(R.shannon(rr_table(spark, d), "user_id"))


@query(f"""WITH {RR_SQL} SELECT user_id, round(count(*) FILTER ((rr > before AND rr > after) OR (rr < before AND rr < after)) / (count(*) - 2), 6) AS "TPR" FROM x GROUP BY user_id HAVING count(*) >= 3""")
def rr_turning_point(spark, d):
    return rounded(R.turning_points(rr_table(spark, d), "user_id"))


@query(f"""WITH {RR_SQL} SELECT user_id, count(DISTINCT CASE WHEN d1 IS NOT NULL THEN (floor(d / 25), floor(d1 / 25)) END) AS "Lorenz_occ", round(avg(CAST(abs(d) <= 80 AND abs(d1) <= 80 AS INTEGER)) FILTER (d1 IS NOT NULL), 6) AS "Lorenz_origin",
    round(stddev_pop(d), 6) AS "dRR_SD" FROM x GROUP BY user_id HAVING count(d) >= 2""")
def rr_lorenz(spark, d):
    return rounded(R.lorenz(rr_table(spark, d), "user_id"))


@query(f"""WITH {RR_SQL}, a AS (SELECT user_id, avg(rr) AS m, stddev_samp(rr) AS s, sqrt(avg(d * d)) AS r, quantile_cont(d, 0.5) AS med FROM x GROUP BY user_id HAVING count(*) >= 3)
    SELECT user_id, round(any_value(s / m), 6) AS "RR_CV", round(any_value(r / m), 6) AS "RMSSDn", round(quantile_cont(abs(d - med), 0.5), 6) AS "dRR_MAD" FROM x JOIN a USING (user_id) GROUP BY user_id""")
def rr_robust(spark, d):
    return rounded(R.robust(rr_table(spark, d), "user_id"))


@query(f"""WITH {RR_SQL}, m AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n, avg(rr) OVER (PARTITION BY user_id) AS m FROM rr),
    y AS (SELECT user_id, i, n, sum(rr - m) OVER (PARTITION BY user_id ORDER BY i) AS y FROM m WHERE n >= 12),
    b AS (SELECT user_id, s, (i - 1) // s AS b, CAST((i - 1) % s AS DOUBLE) AS t, y FROM y, (SELECT unnest(range(4, 17)) AS s) WHERE s <= least(16, n // 3) AND (i - 1) // s < n // s),
    p AS (SELECT user_id, s, b, regr_syy(y, t) - regr_sxy(y, t) * regr_sxy(y, t) / regr_sxx(y, t) AS e FROM b GROUP BY ALL),
    f AS (SELECT user_id, s, sum(greatest(e, 0)) / (count(*) * s) AS f2 FROM p GROUP BY user_id, s HAVING sum(greatest(e, 0)) > 0)
    SELECT user_id, round(regr_slope(ln(f2) / 2, ln(s)), 6) AS "DFA_a1" FROM f GROUP BY user_id HAVING count(*) >= 3""")
def rr_dfa(spark, d):
    return rounded(R.dfa(rr_table(spark, d), "user_id"))


@query()
def rr_cosen(spark, d):
    from pulsegrid.functions.udfs import af_features

    a = rr_table(spark, d).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("i", "rr"))).alias("s"))
    return rounded(a.select("user_id", af_features()(F.transform("s", lambda x: x["rr"])).alias("f")).select("user_id", "f.*"))


# Reliability and joins


@query("""WITH l AS (SELECT user_id AS patient, CAST(date_diff('day', TIMESTAMP '2024-01-01', ts) AS INTEGER) AS win_idx, event_type AS channel, avg(value) AS err, count(*) >= 2 AS valid FROM events GROUP BY ALL),
    m AS (SELECT *, CASE WHEN channel = 'click' THEN 'cecg' WHEN channel IN ('view', 'purchase') THEN 'ppg' ELSE 'bcg' END AS modality, CASE WHEN valid THEN err END AS e FROM l)
    SELECT patient, win_idx, modality, arg_min(channel, (e IS NULL, coalesce(e, 0), channel)) AS channel, round(min(e), 6) AS err, bool_or(valid) AS valid FROM m GROUP BY patient, win_idx, modality""")
def reliability_best_channel(spark, d):
    day = F.datediff(F.col("ts").cast("timestamp"), F.lit("2024-01-01").cast("date")).alias("win_idx")
    l = events(spark, d).groupBy(F.col("user_id").alias("patient"), day, F.col("event_type").alias("channel")).agg(F.avg("value").alias("v"), (F.count("*") >= 2).alias("valid"))
    l = l.withColumn("modality", F.when(F.col("channel") == "click", "cecg").when(F.col("channel").isin("view", "purchase"), "ppg").otherwise("bcg"))
    l = l.withColumn("err", F.when(F.col("valid"), F.col("v"))).drop("v")
    return rounded(T.best_channel(l, ["patient", "win_idx", "modality"], "err"))


@query(f"""WITH {X_SQL} SELECT a.patient, a.win_idx, round(b.e_cecg, 6) AS e_cecg, round(b.conf, 6) AS conf FROM ex a LEFT JOIN (SELECT * FROM ex WHERE win_idx % 3 <> 0) b ON a.patient = b.patient AND a.win_idx = b.win_idx""")
def rel_left_join(spark, d):
    x = experts(spark, d)
    grid = [F.lit(30.0).alias("window_s"), F.lit(15.0).alias("hop_s")]
    rel = x.where("win_idx % 3 <> 0").select("patient", "win_idx", "e_cecg", "conf", *grid)
    return rounded(T.aligned(x.select("patient", "win_idx", *grid), rel).select("patient", "win_idx", "e_cecg", "conf"))


@query(f"""WITH {X_SQL}, g AS (SELECT patient, win_idx AS slot, conf FROM ex) SELECT ex.patient, ex.win_idx, CAST(floor(ex.win_idx * 15 / 30e0) AS INTEGER) AS slot, round(g.conf, 6) AS gt FROM ex LEFT JOIN g ON g.patient = ex.patient AND g.slot = floor(ex.win_idx * 15 / 30e0)""")
def gt_slot_join(spark, d):
    x = experts(spark, d)
    ref = x.select("patient", "win_idx", F.col("conf").alias("gt"))
    return rounded(T.joined_by_slot(x.select("patient", "win_idx", (F.col("win_idx") * 15.0).alias("t_start_s")), ref, 30.0).select("patient", "win_idx", "slot", "gt"))


@query(f"""WITH {X_SQL}, af AS (SELECT DISTINCT patient FROM ex WHERE patient % 3 = 0) SELECT win_idx, patient, CAST(patient IN (SELECT patient FROM af) AS INTEGER) AS "AF" FROM ex WHERE patient NOT IN (SELECT patient FROM ex WHERE patient % 7 = 1)""")
def af_membership(spark, d):
    x = experts(spark, d).select("patient", "win_idx")
    return T.with_af_flag(T.without_patients(x, x.where("patient % 7 = 1")), x.where("patient % 3 = 0").select("patient")).select("patient", "win_idx", "AF")


@query(f"""WITH {X_SQL}, f AS (SELECT *, patient % 5 AS fold FROM ex), s AS (SELECT a.fold, (SELECT quantile_cont(e_cecg, 0.95) FROM f b WHERE b.fold <> a.fold) AS q FROM (SELECT DISTINCT fold FROM f) a)
    SELECT patient, win_idx, round(coalesce(e_cecg, q), 6) AS e_cecg FROM f JOIN s USING (fold)""")
def target_sentinel(spark, d):
    x = experts(spark, d).select("patient", "win_idx", "e_cecg", (F.col("patient") % 5).alias("fold"))
    return rounded(T.with_sentinel(x, ["e_cecg"], "fold").drop("fold"))


# Weights and fusion


def wide(x: DataFrame, w: list[Column], names: tuple[str, ...] = ("w_cecg", "w_ppg", "w_bcg")) -> DataFrame:
    return rounded(x.select("patient", "win_idx", *[c.alias(n) for c, n in zip(w, names, strict=True)]))


def w_sql(ctes: str, cols: list[str], names: tuple[str, ...] = ("w_cecg", "w_ppg", "w_bcg")) -> str:
    return f"WITH {X_SQL}{ctes} SELECT patient, win_idx, " + ", ".join(f"round({c}, 6) AS {n}" for c, n in zip(cols, names, strict=True)) + " FROM t"


SOFT = ", a AS (SELECT *, -e_cecg / (2e0 + 1e-9) AS a0, -e_ppg / (2e0 + 1e-9) AS a1, -e_bcg / (2e0 + 1e-9) AS a2 FROM ex), b AS (SELECT *, greatest(a0, a1, a2) AS g FROM a), t AS (SELECT *, coalesce(exp(a0 - g), 0) AS x0, coalesce(exp(a1 - g), 0) AS x1, coalesce(exp(a2 - g), 0) AS x2 FROM b)"
SOFT_W = [f"x{i} / (x0 + x1 + x2 + 1e-9)" for i in range(3)]


@query(w_sql(SOFT, SOFT_W))
def weights_softmax(spark, d):
    return wide(experts(spark, d), N.softmax_weights(ERR, 2.0))


DECAY = ", t AS (SELECT *, " + ", ".join(f"CASE WHEN e_{m} IS NULL THEN 0 WHEN greatest(e_{m}, 0) <= 0.5 THEN 1 ELSE exp(-(e_{m} - 0.5e0) / 0.25e0) END AS x{i}" for i, m in enumerate(("cecg", "ppg", "bcg"))) + " FROM ex)"


@query(w_sql(DECAY, [f"CASE WHEN x0 + x1 + x2 > 0 THEN x{i} / (x0 + x1 + x2) ELSE 1e0 / 3 END" for i in range(3)]))
def weights_exp_decay(spark, d):
    return wide(experts(spark, d), N.decay_weights(ERR, 0.5, 0.25))


BLEND = SOFT.replace(", t AS (", ", s AS (") + ", u AS (SELECT *, " + ", ".join(f"{w.replace('0.0', '0.0')} AS y{i}" for i, w in enumerate(SOFT_W)) + " FROM s), t AS (SELECT *, 0.8e0 * y0 + 0.2e0 / 3 AS z0, 0.5e0 * y1 + 0.5e0 / 3 AS z1, 0 * y2 + 1e0 / 3 AS z2 FROM u)"


@query(w_sql(BLEND, [f"z{i} / (z0 + z1 + z2)" for i in range(3)]))
def weights_blend(spark, d):
    return wide(experts(spark, d), N.blended_weights(N.softmax_weights(ERR, 2.0), [0.8, 0.5, -0.3]))


QF = ", q AS (SELECT *, coalesce(q_cecg, 0.5e0) AS c0, coalesce(q_ppg, 0.5e0) AS c1, coalesce(q_bcg, 0.5e0) AS c2 FROM ex)"


def with_quality(spark: SparkSession, d: str) -> DataFrame:
    return experts(spark, d).withColumns({q: F.coalesce(q, F.lit(0.5)) for q in QUAL})


@query(w_sql(QF + ", t AS (SELECT *, exp(4 * c0) + exp(4 * c1) + exp(4 * c2) AS z FROM q)", [f"0.85e0 * exp(4 * c{i}) / z + 0.05e0" for i in range(3)]))
def weights_quality_floor(spark, d):
    return wide(with_quality(spark, d), N.quality_weights(QUAL))


@query(w_sql(QF + ", t AS (SELECT * FROM q)", [f"(c{i} + 0.05e0) / (c0 + c1 + c2 + 0.15e0)" for i in range(3)]))
def weights_sqi_prop(spark, d):
    return wide(with_quality(spark, d), N.proportional_weights(QUAL))


@query(f"WITH {X_SQL} SELECT patient, win_idx, round((p_cecg + p_ppg + p_bcg) / 3, 6) AS fused FROM ex")
def fuse_equal(spark, d):
    return wide(experts(spark, d), [N.fused(N.equal_weights(3), P)], ("fused",))


@query(w_sql(SOFT, ["(x0 * p_cecg + x1 * p_ppg + x2 * p_bcg) / (x0 + x1 + x2 + 1e-9)"], ("fused",)))
def fuse_weighted(spark, d):
    return wide(experts(spark, d), [N.fused(N.softmax_weights(ERR, 2.0), P)], ("fused",))


@query(f"WITH {X_SQL}{SOFT}, w AS (SELECT patient % 5 AS fold, " + ", ".join(f"{x} AS w{i}" for i, x in enumerate(SOFT_W)) + " FROM t), s AS (SELECT fold, sum(w0) AS s0, sum(w1) AS s1, sum(w2) AS s2, count(*) AS n FROM w GROUP BY fold), a AS (SELECT sum(s0) AS t0, sum(s1) AS t1, sum(s2) AS t2, sum(n) AS tn FROM s) SELECT fold, round((t0 - s0) / (tn - n), 6) AS w_cecg, round((t1 - s1) / (tn - n), 6) AS w_ppg, round((t2 - s2) / (tn - n), 6) AS w_bcg FROM s, a".replace(", a AS (SELECT sum(s0)", ", tot AS (SELECT sum(s0)").replace("FROM s, a", "FROM s, tot"))
def freeze_weights(spark, d):
    """Per fold the mean weights of the other folds' rows, from totals less the fold's own sums."""
    x = experts(spark, d)
    w = N.softmax_weights(ERR, 2.0)
    rows = x.select((F.col("patient") % 5).alias("fold"), *[c.alias(n) for c, n in zip(w, ("w_cecg", "w_ppg", "w_bcg"), strict=True)])
    m = T.loo_means(rows, "fold", ["w_cecg", "w_ppg", "w_bcg"])
    return rounded(m.select("fold", *[F.col(f"mean_w_{k}").alias(f"w_{k}") for k in ("cecg", "ppg", "bcg")]))


@query(w_sql(QF + ", t AS (SELECT *, " + ", ".join(f"(c{i} + 0.05e0) / (c0 + c1 + c2 + 0.15e0) AS w{i}" for i in range(3)) + " FROM q)", ["exp(-(w0 * ln(w0) + w1 * ln(w1) + w2 * ln(w2)))"], ("n_eff",)))
def effective_experts(spark, d):
    return wide(with_quality(spark, d), [N.entropy_experts(N.proportional_weights(QUAL))], ("n_eff",))


@query(f"WITH {X_SQL}, q AS (SELECT quantile_cont(q_cecg, 0.02) AS lo, quantile_cont(q_cecg, 0.98) AS hi FROM ex) SELECT patient, win_idx, round(coalesce(least(greatest((q_cecg - lo) / (hi - lo), 0), 1), 0.5), 6) AS unit FROM ex, q")
def robust_unit(spark, d):
    x = experts(spark, d)
    cut = M.quantiles(x, "q_cecg", [0.02, 0.98]).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return wide(x.crossJoin(F.broadcast(cut)), [N.unit_clip(F.col("q_cecg"), F.col("lo"), F.col("hi"))], ("unit",))  # one row


@query(f"WITH {X_SQL}{QF} SELECT patient, win_idx, round((0.6e0 * c0 + 0.3e0 * c1) / 0.9e0, 6) AS composite FROM q")
def tunable_composite(spark, d):
    weights = {"q_cecg": 0.6, "q_ppg": 0.3, "q_bcg": -0.4}
    w = {k: max(0.0, v) for k, v in weights.items()}
    return wide(with_quality(spark, d), [N.total([F.col(k) * v for k, v in w.items()]) / sum(w.values())], ("composite",))


@query(f"WITH {X_SQL} SELECT patient, win_idx, round(CASE WHEN q_ppg IS NULL AND q_bcg IS NULL THEN 0.5 ELSE (coalesce(q_ppg, 0) + coalesce(q_bcg, 0)) / (CAST(q_ppg IS NOT NULL AS INTEGER) + CAST(q_bcg IS NOT NULL AS INTEGER)) END, 6) AS composite FROM ex")
def modality_composite(spark, d):
    two = F.filter(F.array("q_ppg", "q_bcg"), lambda v: v.isNotNull())
    return wide(experts(spark, d), [F.coalesce(S.mean_of(two), F.lit(0.5))], ("composite",))


@query(f"WITH {X_SQL} SELECT patient, win_idx, round(abs(p_cecg - (p_ppg + p_bcg) / 2), 6) AS d_cecg, round(abs(p_ppg - (p_cecg + p_bcg) / 2), 6) AS d_ppg, round(abs(p_bcg - (p_cecg + p_ppg) / 2), 6) AS d_bcg FROM ex")
def discordance(spark, d):
    return wide(experts(spark, d), N.discordance(P), ("d_cecg", "d_ppg", "d_bcg"))


@query(f"""WITH {X_SQL}, m AS (SELECT *, (p_cecg + p_ppg + p_bcg) / 3 AS mu FROM ex) SELECT patient, win_idx, round(p_cecg, 6) AS p_cecg, round(p_ppg, 6) AS p_ppg, round(p_bcg, 6) AS p_bcg, round(mu, 6) AS mean,
    round(sqrt((pow(p_cecg - mu, 2) + pow(p_ppg - mu, 2) + pow(p_bcg - mu, 2)) / 3), 6) AS std, round(greatest(p_cecg, p_ppg, p_bcg), 6) AS max, round(least(p_cecg, p_ppg, p_bcg), 6) AS min,
    round(abs(p_cecg - p_ppg), 6) AS d01, round(abs(p_cecg - p_bcg), 6) AS d02, round(abs(p_ppg - p_bcg), 6) AS d12 FROM m""")
def meta_features(spark, d):
    f = N.meta_features(P)
    return wide(experts(spark, d), list(f.values()), tuple(f))


@query(f"WITH {X_SQL} SELECT patient, win_idx, round(CASE WHEN abs(e_cecg - e_ppg) < 1 THEN 0.5 * pow(e_cecg - e_ppg, 2) ELSE abs(e_cecg - e_ppg) - 0.5 END, 6) AS loss FROM ex")
def smooth_l1(spark, d):
    return wide(experts(spark, d), [N.smooth_l1(F.col("e_cecg"), F.col("e_ppg"))], ("loss",))


# Evaluation


MEAN = "(p_cecg + p_ppg + p_bcg) / 3"


def mean_score(spark: SparkSession, d: str) -> DataFrame:
    return experts(spark, d).withColumn("p", (F.col("p_cecg") + F.col("p_ppg") + F.col("p_bcg")) / 3)


RANK_SQL = f"{X_SQL}, p AS (SELECT *, {MEAN} AS p FROM ex), k AS (SELECT *, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2e0 AS r FROM p)"


@query(f"""WITH {RANK_SQL} SELECT round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2e0) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 6) AS auc, count(*) FILTER (y = 1) AS n_pos, count(*) FILTER (y = 0) AS n_neg FROM k""")
def auc_rank(spark, d):
    return rounded(M.auc(mean_score(spark, d), "p", "y"))


ROC_SQL = f"""{X_SQL}, p AS (SELECT y, round({MEAN}, 3) AS s FROM ex), g AS (SELECT s, sum(y) AS pos, sum(1 - y) AS neg FROM p GROUP BY s),
    o AS (SELECT s AS threshold, sum(pos) OVER (ORDER BY s DESC) AS tp, sum(neg) OVER (ORDER BY s DESC) AS fp, sum(pos) OVER () AS n_pos, sum(neg) OVER () AS n_neg FROM g)"""


def coarse(spark: SparkSession, d: str) -> DataFrame:
    """Scores to three places, so that ties occur."""
    return mean_score(spark, d).withColumn("p", F.round("p", 3))


@query(f"WITH {ROC_SQL} SELECT threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(n_pos AS BIGINT) AS n_pos, CAST(n_neg AS BIGINT) AS n_neg FROM o")
def roc_points(spark, d):
    return M.roc(coarse(spark, d), "p", "y")


@query(f"""WITH {ROC_SQL}, c AS (SELECT threshold, tp / n_pos AS tpr, 1 - fp / n_neg AS spec FROM o), b AS (SELECT *, row_number() OVER (ORDER BY tpr DESC, threshold DESC) AS r FROM c WHERE spec >= 0.8 AND tpr > 0)
    SELECT threshold, round(tpr, 6) AS tpr, round(spec, 6) AS spec FROM b WHERE r = 1""")
def choose_threshold(spark, d):
    return rounded(M.choose_threshold(coarse(spark, d), "p", "y", 0.8))


CONF_SQL = """count(*) FILTER (y = 0 AND NOT c) AS tn, count(*) FILTER (y = 0 AND c) AS fp, count(*) FILTER (y = 1 AND NOT c) AS fn, count(*) FILTER (y = 1 AND c) AS tp"""
RATES_SQL = """round((tp + tn) / (tp + tn + fp + fn), 6) AS acc, coalesce(round(tp / nullif(tp + fn, 0), 6), 0) AS sens, coalesce(round(tn / nullif(tn + fp, 0), 6), 0) AS spec, round(tp / nullif(tp + fp, 0), 6) AS ppv, round(tn / nullif(tn + fn, 0), 6) AS npv, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1"""


@query(f"WITH {X_SQL}, k AS (SELECT y, {MEAN} >= 0.5 AS c FROM ex), t AS (SELECT {CONF_SQL} FROM k) SELECT tn, fp, fn, tp, {RATES_SQL} FROM t")
def confusion_metrics(spark, d):
    return rounded(M.confusion(mean_score(spark, d), F.col("p") >= 0.5, "y"))


@query(f"WITH {X_SQL} SELECT patient, max(y) AS y, round(coalesce(sum(CASE WHEN conf >= 0.2 THEN conf ELSE 0 END * {MEAN}) / nullif(sum(CASE WHEN conf >= 0.2 THEN conf ELSE 0 END), 0), avg({MEAN})), 6) AS p FROM ex GROUP BY patient")
def patient_agg_weighted(spark, d):
    return rounded(M.patient_scores(mean_score(spark, d), "p", "y", "conf", 0.2))


@query(f"WITH {X_SQL}, g AS (SELECT patient, max(y) AS y, avg({MEAN}) AS p FROM ex GROUP BY patient), k AS (SELECT y, p >= 0.5 AS c FROM g), t AS (SELECT {CONF_SQL} FROM k) SELECT tn, fp, fn, tp, {RATES_SQL} FROM t")
def patient_metrics(spark, d):
    return rounded(M.confusion(M.patient_scores(mean_score(spark, d), "p", "y"), F.col("p") >= 0.5, "y"))


@query(f"""WITH {X_SQL}, v AS (SELECT patient, e_cecg AS a, q_cecg AS b FROM ex WHERE e_cecg IS NOT NULL AND q_cecg IS NOT NULL), r AS (SELECT patient, rank() OVER (PARTITION BY patient ORDER BY a) AS ra, rank() OVER (PARTITION BY patient ORDER BY b) AS rb FROM v)
    SELECT patient, count(*) AS n, CASE WHEN stddev_pop(ra) > 0 AND stddev_pop(rb) > 0 THEN round(covar_pop(ra, rb) / (stddev_pop(ra) * stddev_pop(rb)), 6) ELSE 0 END AS rho FROM r GROUP BY patient HAVING count(*) >= 20""")
def spearman_audit(spark, d):
    return rounded(M.spearman(experts(spark, d), "e_cecg", "q_cecg", ["patient"], 20))


@query(f"""WITH {X_SQL}, o AS (SELECT *, abs(p_cecg - y) AS a, abs(p_ppg - y) AS b, abs(p_bcg - y) AS c, CAST({MEAN} >= 0.5 AS INTEGER) AS m FROM ex)
    SELECT patient, win_idx, CASE WHEN a <= b AND a <= c THEN 'p_cecg' WHEN b <= c THEN 'p_ppg' ELSE 'p_bcg' END AS oracle_expert, round(CASE WHEN a <= b AND a <= c THEN p_cecg WHEN b <= c THEN p_ppg ELSE p_bcg END, 6) AS oracle_p,
        m <> y AND (CAST(p_cecg >= 0.5 AS INTEGER) = y OR CAST(p_ppg >= 0.5 AS INTEGER) = y OR CAST(p_bcg >= 0.5 AS INTEGER) = y) AS rescuable FROM o""")
def oracle_pick(spark, d):
    return rounded(T.oracle_pick(experts(spark, d), list(P), "y").select("patient", "win_idx", "oracle_expert", "oracle_p", "rescuable"))


@query(f"WITH {X_SQL} SELECT round(corr(q_cecg, 1 - abs(p_cecg - y)), 6) AS cecg, round(corr(q_ppg, 1 - abs(p_ppg - y)), 6) AS ppg, round(corr(q_bcg, 1 - abs(p_bcg - y)), 6) AS bcg FROM ex")
def routing_signal(spark, d):
    x = experts(spark, d)
    for m in ("cecg", "ppg", "bcg"):
        both = F.col(f"q_{m}").isNotNull()
        x = x.withColumns({f"a_{m}": F.when(both, F.col(f"q_{m}")), f"b_{m}": F.when(both, 1 - F.abs(F.col(f"p_{m}") - F.col("y")))})
    return rounded(x.agg(*[N.safe_corr(f"a_{m}", f"b_{m}").alias(m) for m in ("cecg", "ppg", "bcg")]))


@query(f"WITH {X_SQL} SELECT patient, win_idx, round(greatest(p_cecg, p_ppg, p_bcg) - least(p_cecg, p_ppg, p_bcg), 6) AS disagreement FROM ex ORDER BY greatest(p_cecg, p_ppg, p_bcg) - least(p_cecg, p_ppg, p_bcg) DESC, win_idx LIMIT 20")
def disagreement_topk(spark, d):
    x = experts(spark, d).select("patient", "win_idx", (F.greatest(*P) - F.least(*P)).alias("disagreement"))
    return rounded(x.orderBy(F.col("disagreement").desc(), "win_idx").limit(20))


@query(f"""WITH {X_SQL}, o AS (SELECT *, {MEAN} AS p FROM ex) SELECT patient, win_idx, round(p, 6) AS p, y FROM o WHERE CAST(p >= 0.5 AS INTEGER) <> y
    AND (CAST(p_cecg >= 0.5 AS INTEGER) = y OR CAST(p_ppg >= 0.5 AS INTEGER) = y OR CAST(p_bcg >= 0.5 AS INTEGER) = y) ORDER BY abs(p - y) DESC, win_idx LIMIT 15""")
def routing_targets(spark, d):
    x = T.oracle_pick(mean_score(spark, d), list(P), "y").where("rescuable")
    return rounded(x.orderBy(F.abs(F.col("p") - F.col("y")).desc(), "win_idx").limit(15).select("patient", "win_idx", "p", "y"))


@query(f"""WITH {X_SQL}, o AS (SELECT *, q_cecg <= (SELECT quantile_cont(q_cecg, 0.1) FROM ex) AS bad FROM ex)
    SELECT patient, win_idx, coalesce(q_bcg > 0.8, false) AS clean_bcg FROM o WHERE bad AND CAST(p_cecg >= 0.5 AS INTEGER) <> y AND CAST(p_ppg >= 0.5 AS INTEGER) <> y AND CAST(p_bcg >= 0.5 AS INTEGER) <> y""")
def failing_windows(spark, d):
    x = experts(spark, d)
    cut = M.quantiles(x, "q_cecg", [0.1]).select(F.col("value").alias("cut"))
    wrong = F.lit(True)
    for p in P:
        wrong = wrong & ((F.col(p) >= 0.5).cast("int") != F.col("y"))
    x = x.join(F.broadcast(cut), F.col("q_cecg") <= F.col("cut")).where(wrong)
    return x.select("patient", "win_idx", F.coalesce(F.col("q_bcg") > 0.8, F.lit(False)).alias("clean_bcg"))


@query(f"""WITH {X_SQL}, p AS (SELECT *, {MEAN} AS p FROM ex), c AS (SELECT u AS coverage, quantile_cont(conf, 1 - u) AS cut FROM p, (SELECT unnest([1e0, 0.75e0, 0.5e0]) AS u) GROUP BY u),
    k AS (SELECT c.coverage, c.cut, p.p, p.y, p.e_cecg > 4 AS bad FROM p JOIN c ON p.conf >= c.cut), r AS (SELECT *, rank() OVER (PARTITION BY coverage ORDER BY p) + (count(*) OVER (PARTITION BY coverage, p) - 1) / 2e0 AS r FROM k)
    SELECT coverage, round(any_value(cut), 6) AS cut, count(*) AS n, count(*) FILTER (bad) AS bad_kept, round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2e0) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 6) AS auc FROM r GROUP BY coverage""".replace("quantile_cont(conf, 1 - u) AS cut FROM p, (SELECT unnest([1e0, 0.75e0, 0.5e0]) AS u) GROUP BY u", "CASE u WHEN 1 THEN quantile_cont(conf, 0.0) WHEN 0.75 THEN quantile_cont(conf, 0.25) ELSE quantile_cont(conf, 0.5) END AS cut FROM p, (SELECT unnest([1e0, 0.75e0, 0.5e0]) AS u) GROUP BY u"))
def risk_coverage(spark, d):
    x = mean_score(spark, d)
    return rounded(M.risk_coverage(x, "conf", "p", "y", [1.0, 0.75, 0.5], F.coalesce(F.col("e_cecg") > 4, F.lit(False))))


@query(f"""WITH {X_SQL}, b AS (SELECT q_cecg <= (SELECT quantile_cont(q_cecg, 0.1) FROM ex) AS a, q_ppg <= (SELECT quantile_cont(q_ppg, 0.1) FROM ex) AS b, q_bcg <= (SELECT quantile_cont(q_bcg, 0.1) FROM ex) AS c FROM ex)
    SELECT 'q_ppg' AS modality, round(avg(CAST(b AS INTEGER)) FILTER (a), 6) AS p_bad_given_bad, round(avg(CAST(b AS INTEGER)) FILTER (a) / 0.1e0, 6) AS lift FROM b
    UNION ALL SELECT 'q_bcg', round(avg(CAST(c AS INTEGER)) FILTER (a), 6), round(avg(CAST(c AS INTEGER)) FILTER (a) / 0.1e0, 6) FROM b""")
def codegradation(spark, d):
    return rounded(T.codegradation(experts(spark, d), list(QUAL), "q_cecg"))


BAD_SQL = f"""{X_SQL}, pp AS (SELECT patient, avg(e_cecg) AS err, avg(1 - conf) AS noise, avg(1 - q_cecg) AS rough FROM ex GROUP BY patient),
    bd AS (SELECT patient, (err - avg(err) OVER ()) / stddev_samp(err) OVER () + (noise - avg(noise) OVER ()) / stddev_samp(noise) OVER () + (rough - avg(rough) OVER ()) / stddev_samp(rough) OVER () AS badness, err, noise, rough FROM pp)"""


def badness(spark: SparkSession, d: str) -> DataFrame:
    pp = experts(spark, d).groupBy("patient").agg(F.avg("e_cecg").alias("err"), F.avg(1 - F.col("conf")).alias("noise"), F.avg(1 - F.col("q_cecg")).alias("rough"))
    return T.patient_badness(pp, {c: F.col(c) for c in ("err", "noise", "rough")})


@query(f"WITH {BAD_SQL} SELECT patient, round(err, 6) AS err, round(noise, 6) AS noise, round(rough, 6) AS rough, round(badness, 6) AS badness FROM bd")
def patient_badness(spark, d):
    return rounded(badness(spark, d))


@query(f"""WITH {BAD_SQL}, o AS (SELECT patient, row_number() OVER (ORDER BY badness DESC, patient) AS place FROM bd), k AS (SELECT unnest([0, 2, 3, 4, 5]) AS k),
    s AS (SELECT k.k, ex.y, {MEAN} AS p FROM ex JOIN o USING (patient), k WHERE place > k.k), r AS (SELECT *, rank() OVER (PARTITION BY k ORDER BY p) + (count(*) OVER (PARTITION BY k, p) - 1) / 2e0 AS r FROM s)
    SELECT k, round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2e0) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 6) AS auc, count(*) FILTER (y = 1) AS n_pos, count(*) FILTER (y = 0) AS n_neg FROM r GROUP BY k""")
def exclusion_sweep(spark, d):
    return rounded(T.exclusion_sweep(mean_score(spark, d), badness(spark, d), "p", "y", [0, 2, 3, 4, 5]))


@query(f"""WITH {X_SQL}, c AS (SELECT quantile_cont(e_ppg, 0.25) AS lo, quantile_cont(e_ppg, 0.75) AS hi FROM ex), h AS (SELECT *, CASE WHEN e_ppg >= hi THEN 1 WHEN e_ppg <= lo THEN 0 END AS hard FROM ex, c),
    l AS (SELECT hard, f, v FROM (SELECT hard, unnest(['q_ppg', 'conf']) AS f, unnest([q_ppg, conf]) AS v FROM h WHERE hard IS NOT NULL)), m AS (SELECT f, quantile_cont(v, 0.5) FILTER (hard = 1) AS a, quantile_cont(v, 0.5) FILTER (hard = 0) AS b FROM l GROUP BY f),
    r AS (SELECT f, hard, rank() OVER (PARTITION BY f ORDER BY v) + (count(*) OVER (PARTITION BY f, v) - 1) / 2e0 AS r FROM l WHERE v IS NOT NULL)
    SELECT f AS feature, round(any_value(a), 6) AS median_hard, round(any_value(b), 6) AS median_easy, round((sum(r) FILTER (hard = 1) - count(*) FILTER (hard = 1) * (count(*) FILTER (hard = 1) + 1) / 2e0) / (count(*) FILTER (hard = 1) * count(*) FILTER (hard = 0)), 6) AS separation FROM r JOIN m USING (f) GROUP BY f""")
def hard_easy(spark, d):
    return rounded(T.hard_easy(experts(spark, d), "e_ppg", ["q_ppg", "conf"]))


@query(f"""WITH {X_SQL}, c AS (SELECT unnest([0e0, 0.25e0, 0.5e0, 0.75e0]) AS c), s AS (SELECT c, y, CASE WHEN win_idx % 4 = 0 THEN (1 - c) * p_cecg + c * conf ELSE p_cecg END AS pc, p_ppg, p_bcg FROM ex, c),
    p AS (SELECT c, y, (pc + p_ppg + p_bcg) / 3 AS p FROM s), r AS (SELECT *, rank() OVER (PARTITION BY c ORDER BY p) + (count(*) OVER (PARTITION BY c, p) - 1) / 2e0 AS r FROM p),
    a AS (SELECT c, (sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2e0) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)) AS auc FROM r GROUP BY c),
    z AS (SELECT (lead(c) OVER (ORDER BY c) - c) * (lead(auc) OVER (ORDER BY c) + auc) / 2 AS z FROM a) SELECT round(sum(z), 6) AS area FROM z""")
def corrupt_sweep_area(spark, d):
    """A quarter of the rows lose their first expert to noise by a share c; area under AUC over c."""
    x = experts(spark, d).withColumn("c", F.explode(F.array(*[F.lit(c) for c in (0.0, 0.25, 0.5, 0.75)])))
    hit = F.when(F.col("win_idx") % 4 == 0, (1 - F.col("c")) * F.col("p_cecg") + F.col("c") * F.col("conf")).otherwise(F.col("p_cecg"))
    a = M.auc(x.withColumn("p", (hit + F.col("p_ppg") + F.col("p_bcg")) / 3), "p", "y", ["c"])
    return rounded(M.trapezoid(a.withColumn("all", F.lit(1)), "c", "auc", ["all"]).select("area"))


# Audits


@query(f"WITH {X_SQL}, m AS (SELECT CAST(e_cecg IS NULL AS INTEGER) + CAST(e_ppg IS NULL AS INTEGER) + CAST(q_cecg IS NULL AS INTEGER) AS m FROM ex) SELECT round(avg(m / 3e0), 6) AS missing_share, count(*) FILTER (m = 3) AS rows_empty, count(*) FILTER (m > 0) AS rows_partial, count(*) AS n FROM m")
def completeness_audit(spark, d):
    return rounded(T.completeness(experts(spark, d), ["e_cecg", "e_ppg", "q_cecg"]))


@query(f"WITH {X_SQL} SELECT patient, round(avg(conf), 6) AS mean_conf, round(avg(CAST(conf < 0.8 AS INTEGER)), 6) AS frac_low, round(avg(CAST(win_idx % 4 < 2 AS INTEGER)), 6) AS frac_weak, count(*) AS n FROM ex GROUP BY patient")
def gt_quality_summary(spark, d):
    q = experts(spark, d).select("patient", F.col("conf").alias("gt_conf"), (F.col("win_idx") % 4).alias("gt_n_strong"))
    return rounded(T.summarize_quality(q))


@query(f"WITH {X_SQL} SELECT y, count(*) AS windows, count(DISTINCT patient) AS patients FROM ex GROUP BY y")
def class_balance(spark, d):
    return experts(spark, d).groupBy("y").agg(F.count("*").alias("windows"), F.countDistinct("patient").alias("patients"))


@query(f"WITH {X_SQL}, n AS (SELECT CAST(e_cecg IS NOT NULL AS INTEGER) + CAST(e_ppg IS NOT NULL AS INTEGER) + CAST(e_bcg IS NOT NULL AS INTEGER) AS n_valid FROM ex) SELECT n_valid, count(*) AS windows FROM n GROUP BY n_valid")
def valid_histogram(spark, d):
    n = F.lit(0)
    for e in ERR:
        n = n + F.col(e).isNotNull().cast("int")
    return experts(spark, d).groupBy(n.alias("n_valid")).agg(F.count("*").alias("windows"))


@query(f"""WITH {X_SQL}{SOFT}, w AS (SELECT patient, unnest(['w_cecg', 'w_ppg', 'w_bcg']) AS expert, unnest([{', '.join(SOFT_W)}]) AS w FROM t),
    i AS (SELECT expert, avg(s) AS s FROM (SELECT expert, patient, stddev_samp(w) AS s FROM w GROUP BY ALL) GROUP BY expert)
    SELECT expert, round(avg(w), 6) AS mean, round(stddev_samp(w), 6) AS std, round(any_value(i.s), 6) AS std_within, round(any_value(i.s) / avg(w), 6) AS cv FROM w JOIN i USING (expert) GROUP BY expert""")
def gate_weight_report(spark, d):
    x = experts(spark, d)
    x = x.withColumns(dict(zip(("w_cecg", "w_ppg", "w_bcg"), N.softmax_weights(ERR, 2.0), strict=True)))
    return rounded(T.weight_report(x, ["w_cecg", "w_ppg", "w_bcg"]))


@query(f"""WITH {X_SQL}, v AS (SELECT y, e_cecg, e_ppg, CASE WHEN p_cecg < 0.5 THEN e_cecg END AS pred FROM ex WHERE e_cecg IS NOT NULL AND e_ppg IS NOT NULL) SELECT count(*) AS n, round(covar_pop(e_cecg, e_ppg) / (stddev_pop(e_cecg) * stddev_pop(e_ppg)), 6) AS pearson, round(1 - sum(pow(e_cecg - e_ppg, 2)) / sum(pow(e_cecg - 2.5, 2)), 6) AS r2 FROM v""")
def gate_validity(spark, d):
    """A predicted error against the true one over valid rows: Pearson, and 1 - residual over the spread about a given mean."""
    v = experts(spark, d).where("e_cecg IS NOT NULL AND e_ppg IS NOT NULL")
    sq = lambda a: a * a
    return rounded(v.agg(F.count("*").alias("n"), N.safe_corr("e_cecg", "e_ppg").alias("pearson"), (1 - F.sum(sq(F.col("e_cecg") - F.col("e_ppg"))) / M.zero_null(F.sum(sq(F.col("e_cecg") - 2.5)))).alias("r2")))


@query(f"""WITH {X_SQL}, c AS (SELECT unnest([0.05e0, 0.5e0, 0.95e0]) AS p, unnest([(SELECT quantile_cont(conf, 0.05) FROM ex), (SELECT quantile_cont(conf, 0.5) FROM ex), (SELECT quantile_cont(conf, 0.95) FROM ex)]) AS v),
    r AS (SELECT p, patient, win_idx, conf, row_number() OVER (PARTITION BY p ORDER BY abs(conf - v), win_idx) AS r FROM ex, c) SELECT p, patient, win_idx, round(conf, 6) AS conf FROM r WHERE r = 1""")
def percentile_pick(spark, d):
    return rounded(T.percentile_pick(experts(spark, d).select("patient", "win_idx", "conf"), "conf", [0.05, 0.5, 0.95], ["win_idx"]))


@query(f"WITH {X_SQL} SELECT round(quantile_cont(conf, 0.1), 6) AS p10, round(quantile_cont(conf, 0.25), 6) AS p25, round(quantile_cont(conf, 0.5), 6) AS p50, round(quantile_cont(conf, 0.75), 6) AS p75, round(quantile_cont(conf, 0.9), 6) AS p90 FROM ex")
def describe_conf(spark, d):
    qs = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9}
    v = M.quantiles(experts(spark, d), "conf", list(qs.values()))
    return rounded(v.agg(*[F.max(F.when(F.col("q") == q, F.col("value"))).alias(k) for k, q in qs.items()]))


@query("""WITH s AS (SELECT c_nationkey AS nation, count(c_acctbal) AS n, sum(c_acctbal) AS s, sum(c_acctbal * c_acctbal) AS q FROM customer GROUP BY 1), t AS (SELECT sum(n) AS n, sum(s) AS s, sum(q) AS q FROM s),
    m AS (SELECT nation, (t.s - s.s) / (t.n - s.n) AS mean, sqrt((t.q - s.q) / (t.n - s.n) - pow((t.s - s.s) / (t.n - s.n), 2)) AS std FROM s, t)
    SELECT c_custkey, round((c_acctbal - mean) / std, 6) AS z FROM customer JOIN m ON m.nation = c_nationkey""")
def lopo_zscore_quality(spark, d):
    """Each customer against the mean and deviation of all other nations' customers: closed form, no fold is copied."""
    c = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_nationkey", "c_acctbal")
    m = T.loo_means(c, "c_nationkey", ["c_acctbal"])
    return rounded(c.join(m, "c_nationkey").select("c_custkey", ((F.col("c_acctbal") - F.col("mean_c_acctbal")) / M.zero_null(F.col("std_c_acctbal"))).alias("z")))


# Reports


def auc_sql(keys: str, score: str = "v", label: str = "ok", source: str = "l") -> str:
    return f"""(SELECT {keys}, (sum(r) FILTER (ok = 1) - count(*) FILTER (ok = 1) * (count(*) FILTER (ok = 1) + 1) / 2e0) / nullif(count(*) FILTER (ok = 1) * count(*) FILTER (ok <> 1), 0) AS auc, count(*) FILTER (ok = 1) AS n_pos, count(*) FILTER (ok <> 1) AS n_neg
        FROM (SELECT {keys}, {label} AS ok, rank() OVER (PARTITION BY {keys} ORDER BY {score}) + (count(*) OVER (PARTITION BY {keys}, {score}) - 1) / 2e0 AS r FROM {source} WHERE {score} IS NOT NULL) GROUP BY {keys})"""


@query(f"""WITH {X_SQL}, w AS (SELECT *, coalesce(q_cecg <= (SELECT quantile_cont(q_cecg, 0.1) FROM ex), false) AS bad FROM ex),
    l AS (SELECT bad, unnest(['q_cecg', 'q_ppg', 'q_bcg']) AS feature, unnest([q_cecg, q_ppg, q_bcg]) AS v, unnest([CAST(CAST(p_cecg >= 0.5 AS INTEGER) = y AS INTEGER), CAST(CAST(p_ppg >= 0.5 AS INTEGER) = y AS INTEGER), CAST(CAST(p_bcg >= 0.5 AS INTEGER) = y AS INTEGER)]) AS ok, unnest([1 - abs(p_cecg - y), 1 - abs(p_ppg - y), 1 - abs(p_bcg - y)]) AS near FROM w),
    r AS (SELECT feature, count(*) AS n, covar_pop(v, near) / (stddev_pop(v) * stddev_pop(near)) AS rho FROM l WHERE v IS NOT NULL GROUP BY feature), b AS (SELECT * FROM l WHERE bad)
    SELECT feature, n, round(rho, 6) AS rho, round(a.auc, 6) AS auc, round(c.auc, 6) AS auc_bad FROM r JOIN {auc_sql("feature")} a USING (feature) LEFT JOIN {auc_sql("feature", source="b")} c USING (feature)""")
def quality_scores(spark, d):
    from pulsegrid.operators.reports import quality_scores as report

    x = experts(spark, d)
    cut = M.quantiles(x, "q_cecg", [0.1]).select(F.col("value").alias("cut"))
    return rounded(report(x.crossJoin(F.broadcast(cut)), dict(zip(QUAL, P, strict=True)), "y", F.coalesce(F.col("q_cecg") <= F.col("cut"), F.lit(False))))  # one row


@query(f"""WITH {X_SQL}, s AS (SELECT *, {MEAN} AS mean, sqrt((pow(p_cecg - {MEAN}, 2) + pow(p_ppg - {MEAN}, 2) + pow(p_bcg - {MEAN}, 2)) / 3) AS sd FROM ex), t AS (SELECT * FROM s WHERE sd >= (SELECT quantile_cont(sd, 0.7) FROM s)),
    l AS (SELECT y AS ok, unnest(['p_cecg', 'p_ppg', 'p_bcg', 'mean']) AS expert, unnest([p_cecg, p_ppg, p_bcg, mean]) AS v FROM t) SELECT expert, round(auc, 6) AS auc, n_pos, n_neg FROM {auc_sql("expert")}""")
def disagreement_gain(spark, d):
    from pulsegrid.operators.reports import disagreement_gain as report

    return rounded(report(mean_score(spark, d).withColumnRenamed("p", "mean"), P, "mean", "y"))


@query(f"""WITH {X_SQL}, a AS (SELECT patient, unnest(['q_cecg', 'q_ppg', 'conf']) AS feature, unnest([q_cecg, q_ppg, conf]) AS v, e_cecg, e_ppg FROM ex), b AS (SELECT feature, v, unnest(['e_cecg', 'e_ppg']) AS target, unnest([e_cecg, e_ppg]) AS t FROM a),
    r AS (SELECT feature, target, rank() OVER (PARTITION BY feature, target ORDER BY v) AS a, rank() OVER (PARTITION BY feature, target ORDER BY t) AS b FROM b WHERE v IS NOT NULL AND t IS NOT NULL),
    c AS (SELECT feature, target, count(*) AS n, covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)) AS rho FROM r GROUP BY ALL HAVING count(*) >= 50) SELECT feature, max(n) AS n, round(max(abs(rho)), 6) AS max_rho, max(abs(rho)) < 0.05 AS noise FROM c GROUP BY feature""")
def noise_columns(spark, d):
    from pulsegrid.operators.reports import noise_columns as report

    return rounded(report(experts(spark, d), ["q_cecg", "q_ppg", "conf"], ["e_cecg", "e_ppg"]))


@query(f"""WITH {X_SQL}{QF}, b AS (SELECT unnest([0e0, 1e0, 4e0]) AS value), e AS (SELECT value, y, exp(value * c0) AS a0, exp(value * c1) AS a1, exp(value * c2) AS a2, p_cecg, p_ppg, p_bcg FROM q, b),
    l AS (SELECT value, y AS ok, (0.85e0 * a0 / (a0 + a1 + a2) + 0.05e0) * p_cecg + (0.85e0 * a1 / (a0 + a1 + a2) + 0.05e0) * p_ppg + (0.85e0 * a2 / (a0 + a1 + a2) + 0.05e0) * p_bcg AS v FROM e) SELECT value, round(auc, 5) AS auc, n_pos, n_neg FROM {auc_sql("value")}""")
def beta_sweep(spark, d):
    from pulsegrid.operators.reports import parameter_sweep

    def score(beta: Column) -> Column:
        e = [F.exp(beta * F.col(q)) for q in QUAL]
        return N.fused([0.85 * x / N.total(e) + 0.05 for x in e], P)

    return parameter_sweep(with_quality(spark, d), [0.0, 1.0, 4.0], score, "y").withColumn("auc", F.round("auc", 5))


@query(f"WITH {X_SQL}, k AS (SELECT patient % 3 AS grp, y, e_bcg < 2.5 AS c FROM ex WHERE e_bcg IS NOT NULL), t AS (SELECT grp, {CONF_SQL} FROM k GROUP BY grp) SELECT grp, tn, fp, fn, tp, {RATES_SQL} FROM t")
def gt_detector_report(spark, d):
    from pulsegrid.operators.reports import detector_report

    x = experts(spark, d).select((F.col("patient") % 3).alias("grp"), "y", F.when(F.col("e_bcg").isNotNull(), (F.col("e_bcg") < 2.5).cast("int")).alias("called"))
    return rounded(detector_report(x, "called", "y", ["grp"]))


@query(f"WITH {X_SQL} SELECT patient, count(*) AS n_win, count(q_ppg) AS n_decided, round(avg(CAST(q_ppg > 0.5 AS INTEGER)), 6) AS af_frac, round(quantile_cont(e_cecg, 0.5), 6) AS median_hr FROM ex GROUP BY patient")
def gt_summary(spark, d):
    from pulsegrid.operators.reports import reference_summary

    x = experts(spark, d).select("patient", (F.col("q_ppg") > 0.5).cast("int").alias("label"), F.col("e_cecg").alias("mean_hr"))
    return rounded(reference_summary(x))


@query()
def expert_oof(spark, d):
    from pulsegrid.learn.folds import expert_oof as oof

    return rounded(oof(folded(spark, d), {"a": ["p_cecg", "q_cecg"], "b": ["p_ppg", "q_ppg"], "c": ["p_bcg", "q_bcg"]}, "y", "LR", "fold"))


@query()
def compare_gates(spark, d):
    from pulsegrid.learn.folds import compare

    return rounded(compare(folded(spark, d), EX3, QUAL, {"equal": ("equal", {}), "ridge": ("ridge", {}), "frozen": ("ridge", {"freeze": True}), "gb": ("gb", {}), "mlp": ("mlp", {})}, "fold"))


@query()
def tune_expert(spark, d):
    from pulsegrid.learn.folds import tune

    return rounded(tune(with_quality(spark, d), ["p_cecg", "q_cecg"], "y", lambda rng: ("LR", {"c": float(10 ** rng.uniform(-3, 2))})))


# Kernels behind Arrow functions, on windows of 64 samples


def kernel_rows(spark: SparkSession, d: str, column: Column) -> DataFrame:
    return samples(spark, d).select("vec_id", column.alias("f")).select("vec_id", "f.*")


DB4 = "[" + ", ".join(f"{v!r}e0" for v in (-0.010597401785069032, 0.0328830116668852, 0.030841381835560764, -0.18703481171909309, -0.027983769416859854, 0.6308807679298589, 0.7148465705529157, 0.2303778133088965)) + "]"


@query()
def bcg_block(spark, d):
    from pulsegrid.functions.udfs import bcg_features

    return rounded(kernel_rows(spark, d, bcg_features(64)(F.col("x"))))


@query()
def sqi_block(spark, d):
    """kSQI, sSQI, pSQI, bSQI, tSQI and the composite."""
    from pulsegrid.functions.udfs import sqi

    return rounded(kernel_rows(spark, d, sqi(64, "ppg")(F.col("x"))))


@query()
def signal_block(spark, d):
    """All features of a signal with a prominence detector behind HRV and AF features."""
    from pulsegrid.functions.udfs import signal_features

    return rounded(kernel_rows(spark, d, signal_features(64, "prominence")(F.col("x"))))


@query()
def window_scalars(spark, d):
    """tSQI, corSQI, peak SNR, RR plausibility, beat count, acceptability."""
    from pulsegrid.functions.udfs import scalar

    names = ("t_sqi", "cor_sqi", "peak_snr", "rr_plausibility", "beat_count_ok", "acceptable", "sample_entropy")
    return rounded(samples(spark, d).select("vec_id", *[scalar(n, 64)(F.col("x")).alias(n) for n in names]))


@query()
def band_pass_filter(spark, d):
    """Deviation before and after a zero-phase band-pass of 2 to 10 Hz at 64 Hz."""
    from pulsegrid.functions.udfs import band_passed

    y = samples(spark, d).select("vec_id", S.moments(F.col("x"))["m2"].alias("before"), band_passed(2.0, 10.0, 64.0)(F.col("x")).alias("y"))
    return rounded(y.select("vec_id", F.sqrt("before").alias("std_before"), F.sqrt(S.moments(F.col("y"))["m2"]).alias("std_after")))


# Packets: frames made from events by a fixture, decoded by the source


def event_blobs(spark: SparkSession, d: str, realtime: bool) -> DataFrame:
    """One blob for each user: a frame for each event, escaped, with delimiters or fixed in size. Real-time frames hold no bytes to escape, as these
    would move the later ones."""
    import struct

    import pandas as pd

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        out = bytearray()
        for i in pdf["event_id"].sort_values():
            b = bytearray(81 if realtime else 77)
            b[0:8] = struct.pack("<Q", 1 + i % 100 if realtime else 1_000_000 + i)
            b[8:24] = struct.pack("<4i", *([i % 100] * 4 if realtime else [(i * 7919 * k) % 2**31 - 2**30 for k in range(1, 5)]))
            b[28:30] = struct.pack("<H", i % 100 if realtime else i % 65536)
            if not realtime:
                b[30:32] = struct.pack("<H", i * 3 % 65536)
                b[40:48] = struct.pack("<4H", *[i * k % 60000 for k in range(1, 5)])
                b[74] = i % 200
            motion = [i % 30000, -(i % 30000), 5, *[i * (j + 1) % 20000 - 10000 for j in range(3, 12)]]
            b[48:72] = struct.pack("<12h", *([i % 100] * 3 + [0] * 9 if realtime else motion))
            b[72:74] = struct.pack("<H", i % 100)
            raw = bytes(b)
            out += raw if realtime else b"\x7e" + raw.replace(b"\x7d", b"\x7d\x5d").replace(b"\x7e", b"\x7d\x5e")
        return pd.DataFrame({"path": [str(pdf["user_id"].iloc[0])], "content": [bytes(out)]})

    return events(spark, d).select("user_id", "event_id").groupBy("user_id").applyInPandas(build, "path string, content binary")


@query("""SELECT CAST(user_id AS VARCHAR) AS path, round(1000000 + event_id + (event_id % 100) / 1000e0, 6) AS time, round(((event_id * 7919) % 2147483648 - 1073741824) / 16777216e0 * 4800, 6) AS ecg1,
    CAST(event_id % 65536 AS DOUBLE) AS ppg1, CAST(event_id % 30000 AS INTEGER) AS x, CAST(-(event_id % 30000) AS INTEGER) AS y FROM events""")
def packet_decode(spark, d):
    from pulsegrid.sources.packets import decoded

    p = decoded(event_blobs(spark, d, False))
    return rounded(p.select("path", "time", "ecg1", "ppg1", F.col("scg1.x").cast("int").alias("x"), F.col("scg1.y").cast("int").alias("y")))


@query("""SELECT CAST(user_id AS VARCHAR) AS path, round(1 + event_id % 100 + (event_id % 100) / 1000e0, 6) AS time, CAST(event_id % 100 AS DOUBLE) AS ppg1, CAST(event_id % 100 AS INTEGER) AS z FROM events""")
def packet_decode_rt(spark, d):
    from pulsegrid.sources.packets import read_realtime

    p = read_realtime(event_blobs(spark, d, True))
    return rounded(p.select("path", "time", "ppg1", F.col("scg1").cast("int").alias("z")))


@query("""WITH u AS (SELECT DISTINCT user_id FROM events) SELECT user_id AS patient, CASE WHEN user_id % 4 = 0 THEN 'alignment.json' WHEN user_id % 4 = 1 THEN 'polarity.json' WHEN user_id % 4 = 2 THEN 'offsets.json' ELSE 'offsets.txt' END AS source,
    CAST(CASE user_id % 4 WHEN 0 THEN user_id % 50 WHEN 3 THEN user_id % 30 ELSE 0 END AS INTEGER) AS initial_offset, CAST(CASE user_id % 4 WHEN 0 THEN user_id % 70 WHEN 2 THEN user_id % 90 WHEN 3 THEN user_id % 40 ELSE 0 END AS INTEGER) AS final_offset,
    user_id % 4 IN (0, 1) AND user_id % 3 = 0 AS flip_cecg, round(CASE WHEN user_id % 4 = 2 THEN user_id % 256 / 128e0 ELSE 0 END, 6) AS trim_start_s FROM u""")
def alignment_config(spark, d):
    """Settings files of four kinds, a corrupt one of higher priority among them, resolved for each user."""
    from pulsegrid.sources.alignment import resolve

    u = events(spark, d).select("user_id").distinct()
    k, t = F.col("user_id") % 4, lambda n: (F.col("user_id") % n).cast("string")
    flip = F.when(F.col("user_id") % 3 == 0, F.lit("true")).otherwise(F.lit("false"))
    sign = F.when(F.col("user_id") % 3 == 0, F.lit("-1")).otherwise(F.lit("1"))
    a = F.concat(F.lit('{"invert": {"cecg": '), flip, F.lit('}, "initial_offset": '), t(50), F.lit(', "final_offset": '), t(70), F.lit("}"))
    b = F.concat(F.lit('{"cecg": '), sign, F.lit("}"))
    c = F.concat(F.lit('{"global": {"start_sample": '), t(256), F.lit(', "time_offset_samples": '), t(90), F.lit("}}"))
    e = F.concat(t(30), F.lit("\n"), t(40), F.lit("\n"))
    own = F.when(k == 0, F.struct(F.lit("alignment.json").alias("name"), a.alias("content"))).when(k == 1, F.struct(F.lit("polarity.json").alias("name"), b.alias("content"))).when(k == 2, F.struct(F.lit("offsets.json").alias("name"), c.alias("content"))).otherwise(F.struct(F.lit("offsets.txt").alias("name"), e.alias("content")))
    bad = F.when(k != 0, F.struct(F.lit("alignment.json").alias("name"), F.lit("{broken").alias("content")))
    files = u.select(F.col("user_id").alias("patient"), F.explode(F.array_compact(F.array(own, bad))).alias("f")).select("patient", "f.*")
    s = resolve(files)
    return rounded(s.select("patient", "source", "initial_offset", "final_offset", F.col("invert")["cecg"].alias("flip_cecg"), "trim_start_s"))


# Learning: each patient is left out once


def folded(spark: SparkSession, d: str, folds: int | None = None) -> DataFrame:
    """Experts' table with complete qualities; the fold is the patient, or one of ``folds`` groups of patients."""
    p = F.col("patient")
    return with_quality(spark, d).withColumn("fold", p % folds if folds else p)


EX3 = ("cecg", "ppg", "bcg")


def moe(kind: str, folds: int | None = None, **options) -> Query:
    def run(spark, d):
        from pulsegrid.learn.folds import evaluate_moe

        return rounded(evaluate_moe(folded(spark, d, folds), EX3, QUAL, kind, options, fold="fold"))

    return run


for _name, _kind, _options in (
    ("error_gate", "ridge", {"map": "decay", "e0": 0.5, "tau": 1.0}),
    ("class_gate", "class_lr", {}),
    ("stacked_meta", "stack_lr", {"discordance": True}),
    ("unsup_pca_gate", "unsup_pca", {"groups": [[0], [1], [2]], "anchors": [0, 1, 2]}),
    ("gmm_gate", "unsup_gmm", {"groups": [[0], [1], [2]], "anchors": [0, 1, 2]}),
):
    QUERIES[_name] = moe(_kind, **_options)

# Nets take minutes to be fitted for each of a hundred patients: five groups of patients, as the names say.
for _name, _kind in (("gating_net_5_folds", "net"), ("reliability_gate_5_folds", "reliability"), ("errpred_fusion_5_folds", "errpred")):
    QUERIES[_name] = moe(_kind, 5)


@query()
def moe_from_fold_cache(spark, d):
    """Feature table to fused decisions in one call, experts' scores from a signed cache that is written and then found again."""
    from pulsegrid.learn.folds import run_moe
    from pulsegrid.sources.cache import scratch

    x, folder = folded(spark, d), scratch(spark)
    x = x.drop(*P).withColumns({f"x_{m}": F.col(f"q_{m}") * (1 + F.col("conf")) for m in EX3})
    run_moe(x, {m: [f"x_{m}", f"q_{m}"] for m in EX3}, QUAL, "y", "equal", folder, fold="fold")
    return rounded(run_moe(x, {m: [f"x_{m}", f"q_{m}"] for m in EX3}, QUAL, "y", "ridge", folder, fold="fold"))


@query()
def lopo_logreg(spark, d):
    from pulsegrid.learn.folds import lopo_predictions

    return rounded(lopo_predictions(folded(spark, d), list(QUAL), "y", "LR", "fold"))


ISOTONIC_SQL = f"""WITH {X_SQL}, x AS (SELECT patient, win_idx, y, patient % 5 AS fold, floor(p_cecg * 1000) / 1000e0 AS s FROM ex),
    d AS (SELECT g, s, count(*) AS n, sum(y) AS k FROM x, (SELECT DISTINCT fold AS g FROM x) WHERE fold <> g GROUP BY ALL),
    c AS (SELECT *, row_number() OVER w AS i, sum(n) OVER w AS cn, sum(k) OVER w AS ck FROM d WINDOW w AS (PARTITION BY g ORDER BY s)),
    low AS (SELECT a.g, b.i, b.s, min((b.ck - a.ck + a.k) / CAST(b.cn - a.cn + a.n AS DOUBLE)) OVER (PARTITION BY a.g, a.i ORDER BY b.i DESC) AS v FROM c a JOIN c b ON a.g = b.g AND b.i >= a.i),
    fit AS (SELECT g, s, max(v) AS v FROM low GROUP BY g, s),
    r AS (SELECT x.*, a.s AS s0, a.v AS v0 FROM x ASOF LEFT JOIN fit a ON a.g = x.fold AND x.s >= a.s),
    q AS (SELECT r.*, b.s AS s1, b.v AS v1 FROM r ASOF LEFT JOIN fit b ON b.g = r.fold AND r.s <= b.s)
    SELECT patient, win_idx, y, round(CASE WHEN s0 IS NULL THEN v1 WHEN s1 IS NULL OR s1 = s0 THEN v0 ELSE v0 + (v1 - v0) * (s - s0) / (s1 - s0) END, 6) AS p FROM q"""


@query(ISOTONIC_SQL)
def isotonic_fit(spark, d):
    """One expert's scores, calibrated for each fifth of the patients by the isotonic regression of all others; twin by its max-min formula."""
    from pulsegrid.operators.isotonic import calibrated_apart

    x = experts(spark, d).select("patient", "win_idx", "y", (F.col("patient") % 5).alias("fold"), (F.floor(F.col("p_cecg") * 1000) / 1000).alias("s"))
    return rounded(calibrated_apart(x, "s", "y", "fold", "p").drop("fold", "s"))


@query()
def calibrated_logreg(spark, d):
    from pulsegrid.learn.folds import lopo_predictions

    return rounded(lopo_predictions(folded(spark, d), ["p_cecg"], "y", "LR+cal", "fold"))


@query()
def nested_patient_threshold(spark, d):
    from pulsegrid.learn.folds import nested_evaluation

    return rounded(nested_evaluation(folded(spark, d), ["p_cecg", "p_ppg"], "y", mode="patient_nested", fold="fold"))


@query()
def bootstrap_ci(spark, d):
    x = folded(spark, d).withColumn("p", (F.col("p_cecg") + F.col("p_ppg") + F.col("p_bcg")) / 3)
    return rounded(M.bootstrap(x, "p", "y", "patient", seed=1))


@query()
def compare_models(spark, d):
    from pulsegrid.learn.reports import compare_models as report

    return rounded(report(folded(spark, d), list(P), "y", {k: k for k in ("LR", "LR+cal", "SVM", "RF", "GB", "XGB")}, ["window", "window_nested", "patient_pooled", "patient_nested"], "fold"))


@query()
def column_ablation(spark, d):
    from pulsegrid.learn.reports import ablation

    return rounded(ablation(folded(spark, d), {"all": list(P), "without cecg": ["p_ppg", "p_bcg"], "ppg": ["p_ppg"]}, "y", "LR", "fold"))


@query()
def correctness_probe(spark, d):
    from pulsegrid.learn.reports import correctness_probe as report

    return rounded(report(folded(spark, d), {m: f"p_{m}" for m in EX3}, list(QUAL), "y", "fold"))


@query()
def tune_gate(spark, d):
    from pulsegrid.learn.reports import tune_gate as report

    return rounded(report(with_quality(spark, d), EX3, QUAL, lambda rng: ("ridge", {"alpha": float(10 ** rng.uniform(-2, 2))})))


@query()
def learned_quality(spark, d):
    from pulsegrid.learn.reports import recombined_quality

    return rounded(recombined_quality(folded(spark, d), list(QUAL), "p_cecg", "y", "fold"))


@query(w_sql(QF + ", w AS (SELECT *, " + ", ".join(f"(c{i} + 0.05e0) / (c0 + c1 + c2 + 0.15e0) AS w{i}" for i in range(3)) + " FROM q), t AS (SELECT exp(-(w0 * ln(w0) + w1 * ln(w1) + w2 * ln(w2))) AS n FROM w)", ["n"], ("n",)).split(" SELECT patient, win_idx,")[0] + " SELECT round(avg(n), 6) AS mean, round(quantile_cont(n, 0.1), 6) AS p10, round(count(*) FILTER (n < 1.5) / count(*), 6) AS one_expert FROM t")
def effective_summary(spark, d):
    from pulsegrid.learn.reports import effective_summary as report

    x = with_quality(spark, d).select(N.entropy_experts(N.proportional_weights(QUAL)).alias("n_eff"))
    return rounded(report(x))


@query(f"WITH {X_SQL} SELECT patient, win_idx, y, round(p_cecg, 6) AS p_cecg, round(q_cecg, 6) AS q_cecg FROM ex WHERE patient = 3 AND win_idx = (SELECT min(win_idx) FROM ex WHERE patient = 3)")
def inspect_window(spark, d):
    from pulsegrid.learn.reports import inspect_window as look

    x = experts(spark, d).select("patient", "win_idx", "y", "p_cecg", "q_cecg")
    first = x.where("patient = 3").agg(F.min("win_idx")).first()[0]
    return rounded(look(x, 3, first))


@query(f"WITH {X_SQL} (SELECT patient, 'both' AS kind FROM ex WHERE patient % 2 = 0 INTERSECT SELECT patient, 'both' FROM ex WHERE patient % 3 = 0) UNION ALL (SELECT patient, 'first only' FROM ex WHERE patient % 2 = 0 EXCEPT SELECT patient, 'first only' FROM ex WHERE patient % 3 = 0)")
def patient_sets(spark, d):
    x = experts(spark, d).select("patient")
    a, b = x.where("patient % 2 = 0"), x.where("patient % 3 = 0")
    return a.intersect(b).withColumn("kind", F.lit("both")).unionByName(a.subtract(b).withColumn("kind", F.lit("first only")))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events to RR series, HRV and rhythm rule, fusion of three experts by softmax weights, and each user's K-of-M alarm."""
    rr = rr_table(spark, sf_dir)
    per_user = R.hrv(rr, "user_id").join(R.rhythm(rr, "user_id").select("user_id", "cv", "pnn", "label"), "user_id", "left")
    x = experts(spark, sf_dir)
    x = x.withColumn("fused", N.fused(N.softmax_weights(ERR, 2.0), P))
    alarm = W.alarm_report(W.k_of_m(x.withColumn("t", F.col("win_idx") * 15.0), F.col("fused") >= 0.5), "y", "t")
    scores = M.patient_scores(x, "fused", "y", "conf", 0.2).drop("y")
    return rounded(per_user.join(alarm.withColumnRenamed("patient", "user_id"), "user_id").join(scores.withColumnRenamed("patient", "user_id"), "user_id"))


def queries() -> dict[str, Query]:
    from pulsegrid.plans import files, kernels, learned, scheduled  # noqa: F401  these add theirs

    return QUERIES


def oracle_sql() -> dict[str, str]:
    queries()
    return ORACLES


#: Queries without a twin: learnt models, resampling, and whole chains of kernels. Tests hold them against kernels.
WITHOUT_TWIN = {
    "extract_windows", "reliability_table", "reference_confidence", "reference_rhythm",
    "gating_net_5_folds", "reliability_gate_5_folds", "errpred_fusion_5_folds", "error_gate", "class_gate", "stacked_meta", "moe_from_fold_cache", "unsup_pca_gate", "gmm_gate",
    "calibrated_logreg", "nested_patient_threshold", "bootstrap_ci", "compare_gates", "tune_expert", "compare_models", "tune_gate",
}

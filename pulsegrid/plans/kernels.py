"""Queries of the window kernels, detectors and quality indices on windows of 64 samples at 64 Hz, with SQL twins that find peaks,
match beats and build templates by joins.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions import native as N
from pulsegrid.functions import udfs
from pulsegrid.operators import spectral as S
from pulsegrid.plans import catalog as C
from pulsegrid.plans.catalog import DB4, LONG_SQL, ORACLES, query, rounded, samples

# SQL: s (vec_id, label, n, v), mom (n, m), c (vec_id, n, v, cv) come from LONG_SQL.


def top_sql(name: str, source: str) -> str:
    """The highest row of each window, the later of equals."""
    return f"{name} AS (SELECT vec_id, n, v FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, n DESC) AS r FROM {source}) WHERE r = 1)"


def peaks_sql(name: str, source: str, gap: int, factor: float | None = None, height: str | None = None, rounds: int = 4) -> str:
    """Peaks of ``source`` (vec_id, n, v): local maxima, at least ``height`` (an aggregate over the window), the highest first, others ``gap``
    apart, then a prominence of ``factor`` deviations. A window holds at most ``rounds``."""
    p = f"{name}_"
    least = f"WHERE v >= (SELECT q FROM {p}q WHERE {p}q.vec_id = {p}w.vec_id)" if height is not None else "WHERE true"
    out = [f"{p}w AS (SELECT vec_id, n, v, lag(v) OVER o AS a, lead(v) OVER o AS b FROM {source} WINDOW o AS (PARTITION BY vec_id ORDER BY n))"]
    if height is not None:
        out.append(f"{p}q AS (SELECT vec_id, {height} AS q FROM {source} GROUP BY vec_id)")
    out.append(f"{p}c1 AS (SELECT vec_id, n, v FROM {p}w {least} AND v > a AND v > b)")
    for i in range(1, rounds + 1):
        out.append(top_sql(f"{p}k{i}", f"{p}c{i}"))
        out.append(f"{p}c{i + 1} AS (SELECT c.* FROM {p}c{i} c JOIN {p}k{i} k USING (vec_id) WHERE abs(c.n - k.n) >= {gap})")
    out.append(f"{p}all AS (" + " UNION ALL ".join(f"SELECT * FROM {p}k{i}" for i in range(1, rounds + 1)) + ")")
    if factor is None:
        return ", ".join([*out, f"{name} AS (SELECT * FROM {p}all)"])
    out.append(f"{p}b AS (SELECT k.vec_id, k.n, k.v, coalesce(max(s.n) FILTER (s.n < k.n AND s.v > k.v), -1) AS a, coalesce(min(s.n) FILTER (s.n > k.n AND s.v > k.v), 64) AS b FROM {p}all k JOIN {source} s USING (vec_id) GROUP BY k.vec_id, k.n, k.v)")
    out.append(f"{p}p AS (SELECT k.vec_id, k.n, k.v, k.v - greatest(min(s.v) FILTER (s.n > k.a AND s.n <= k.n), min(s.v) FILTER (s.n >= k.n AND s.n < k.b)) AS prom FROM {p}b k JOIN {source} s USING (vec_id) GROUP BY k.vec_id, k.n, k.v, k.a, k.b)")
    out.append(f"{name} AS (SELECT p.vec_id, p.n, p.v FROM {p}p p JOIN (SELECT vec_id, stddev_pop(v) AS sd FROM {source} GROUP BY vec_id) USING (vec_id) WHERE prom >= {factor} * sd)")
    return ", ".join(out)


def mean_sql(name: str, source: str, size: int) -> str:
    """The centred mean of ``size`` samples with reflection, an even size taking one more before."""
    left, right = size // 2, size - size // 2 - 1
    return f"{name} AS (SELECT a.vec_id, a.n, avg(b.v) AS v FROM {source} a, (SELECT unnest(range({-left}, {right + 1})) AS j) JOIN {source} b ON b.vec_id = a.vec_id AND b.n = CASE WHEN a.n + j < 0 THEN -a.n - j - 1 WHEN a.n + j > 63 THEN 127 - a.n - j ELSE a.n + j END GROUP BY a.vec_id, a.n)"


def template_sql(name: str, peaks: str, half: str, source: str = "s") -> str:
    """(vec_id, rows, r): whole beats around the peaks, and their mean correlation with their mean. ``half``: (vec_id, half)."""
    return f"""{name}_r AS (SELECT p.vec_id, p.n AS p, s.n - p.n AS k, s.v FROM {peaks} p JOIN {half} h USING (vec_id) JOIN {source} s ON s.vec_id = p.vec_id AND abs(s.n - p.n) <= h.half WHERE p.n >= h.half AND p.n + h.half < 64),
    {name}_m AS (SELECT vec_id, k, avg(v) AS m FROM {name}_r GROUP BY ALL),
    {name}_c AS (SELECT vec_id, p, CASE WHEN var_pop(v) * var_pop(m) > 0 THEN covar_pop(v, m) / sqrt(var_pop(v) * var_pop(m)) ELSE 0 END AS r FROM {name}_r JOIN {name}_m USING (vec_id, k) GROUP BY ALL),
    {name} AS (SELECT vec_id, count(*) AS n_rows, avg(r) AS r FROM {name}_c GROUP BY vec_id)"""


DIFF2 = "d2 AS (SELECT vec_id, n, pow(v - coalesce(lag(v) OVER (PARTITION BY vec_id ORDER BY n), v), 2) AS v FROM s)"
ORIENTED = """md AS (SELECT vec_id, quantile_cont(v, 0.5) AS med FROM s GROUP BY vec_id), oc AS (SELECT vec_id, max(v - med) >= max(med - v) AS up FROM s JOIN md USING (vec_id) GROUP BY vec_id),
    o AS (SELECT vec_id, n, CASE WHEN up THEN v - med ELSE med - v END AS v FROM s JOIN md USING (vec_id) JOIN oc USING (vec_id))"""
FOUND = " SELECT DISTINCT s.vec_id, CAST(coalesce(k, 0) AS INTEGER) AS n_peaks, coalesce(pos, '') AS pos FROM s LEFT JOIN (SELECT vec_id, count(*) AS k, string_agg(CAST({at} AS VARCHAR), ',' ORDER BY n) AS pos FROM pk GROUP BY vec_id) USING (vec_id)"


def found(spark: SparkSession, d: str, name: str) -> DataFrame:
    p = samples(spark, d).select("vec_id", udfs.peaks(name, 64)(F.col("x")).alias("p"))
    return p.select("vec_id", F.size("p").alias("n_peaks"), F.array_join("p", ",").alias("pos"))


def energy_sql(scales: np.ndarray, wave: str, reach: int) -> str:
    """Summed squares of the correlations with each scaled wavelet; ``reach``: half widths in scales."""
    listed = ", ".join(f"{float(x)!r}e0" for x in scales)
    return f"""sc AS (SELECT unnest([{listed}]) AS a), wv AS (SELECT a, j, {wave} AS w FROM (SELECT a, unnest(range(-CAST(ceil({reach} * a) AS INTEGER), CAST(ceil({reach} * a) AS INTEGER) + 1)) AS j FROM sc)),
    cf AS (SELECT x.vec_id, x.n, wv.a, sum(y.v * wv.w) AS c FROM s x JOIN s y ON y.vec_id = x.vec_id JOIN wv ON wv.j = y.n - x.n GROUP BY ALL), e AS (SELECT vec_id, n, sum(c * c) AS v FROM cf GROUP BY ALL)"""


GAUS2 = "pow(2 / pi(), 0.25) * (2 / sqrt(3e0)) * (1 - 2 * pow(j / a, 2)) * exp(-pow(j / a, 2)) / sqrt(a)"
MORLET = "exp(-pow(j / a, 2) / 2) * cos(5 * j / a) / sqrt(a)"


# Detectors


@query(f"WITH {LONG_SQL}, {peaks_sql('pk', 's', 25, 0.3)}" + FOUND.format(at="n"))
def peaks_distance_prominence(spark, d):
    return found(spark, d, "prominence")


@query(f"WITH {LONG_SQL}, {peaks_sql('pk', 's', 25, 0.3)}" + FOUND.format(at="n"))
def peaks_amplitude(spark, d):
    return found(spark, d, "amplitude")


@query(f"WITH {LONG_SQL}, {mean_sql('mm', 's', 6)}, {peaks_sql('pk', 'mm', 25, 0.3)}" + FOUND.format(at="n"))
def peaks_smoothed(spark, d):
    return found(spark, d, "smoothed")


@query(f"WITH {LONG_SQL}, {DIFF2}, {mean_sql('mm', 'd2', 6)}, {peaks_sql('pk', 'mm', 25, 0.3)}" + FOUND.format(at="n"))
def peaks_energy(spark, d):
    return found(spark, d, "energy")


@query(f"WITH {LONG_SQL}, {ORIENTED}, {peaks_sql('pk', 'o', 19, 0.5)}" + FOUND.format(at="n"))
def peaks_oriented(spark, d):
    return found(spark, d, "oriented")


RESAMPLED = """f AS (SELECT vec_id, k, sum(v * cos(2 * pi() * (k * n % 64) / 64e0)) AS re, -sum(v * sin(2 * pi() * (k * n % 64) / 64e0)) AS im FROM s, (SELECT unnest(range(33)) AS k) GROUP BY vec_id, k),
    y AS (SELECT vec_id, j AS n, sum(CASE WHEN k = 0 THEN re WHEN 2 * k = {m} THEN 2 * re * cos(pi() * j) ELSE 2 * (re * cos(2 * pi() * (k * j % {m}) / {m}e0) - im * sin(2 * pi() * (k * j % {m}) / {m}e0)) END) / 64 AS v
        FROM f, (SELECT unnest(range({m})) AS j) WHERE 2 * k <= {m} GROUP BY vec_id, j)"""


@query(f"""WITH {LONG_SQL}, {RESAMPLED.format(m=50)}, wv AS (SELECT j, {GAUS2} AS w FROM (SELECT 20e0 AS a, unnest(range(-100, 101)) AS j)),
    g AS (SELECT a.vec_id, a.n, sum(b.v * w) AS v FROM y a JOIN y b USING (vec_id) JOIN wv ON wv.j = b.n - a.n GROUP BY a.vec_id, a.n), {peaks_sql('pk', 'g', 15)}""" + FOUND.format(at="n * 64 // 50"))
def peaks_bcg_wavelet(spark, d):
    return found(spark, d, "bcg_wavelet")


@query(f"""WITH {LONG_SQL}, {energy_sql(np.geomspace(2, 64, 80)[(19.2 / np.geomspace(2, 64, 80) >= 1.5) & (19.2 / np.geomspace(2, 64, 80) <= 12)], GAUS2, 5)},
    {peaks_sql('hi', 'e', 25, height='quantile_cont(v, 0.7)')}, {peaks_sql('lo', 'e', 25, height='quantile_cont(v, 0.5)')}, nh AS (SELECT vec_id FROM hi GROUP BY vec_id HAVING count(*) >= 4),
    pk AS (SELECT * FROM hi WHERE vec_id IN (SELECT vec_id FROM nh) UNION ALL SELECT * FROM lo WHERE vec_id NOT IN (SELECT vec_id FROM nh))""" + FOUND.format(at="n"))
def peaks_bcg_band(spark, d):
    return found(spark, d, "bcg_band")


@query(f"WITH {LONG_SQL}, {energy_sql(np.geomspace(2, 60, 100)[(52 / np.geomspace(2, 60, 100) >= 5) & (52 / np.geomspace(2, 60, 100) <= 15)], MORLET, 4)}, {peaks_sql('pk', 'e', 25, height='quantile_cont(v, 0.8)')}" + FOUND.format(at="n"))
def peaks_cecg_band(spark, d):
    return found(spark, d, "cecg_band")


#: Butterworth band-passes at 64 Hz by order and band, each section b0, b1, b2, a0, a1, a2. A test holds them against the magnitude that defines them.
SECTIONS = {
    (2, 0.5, 28.8): [[2.0332046839594824, 0.0, -2.0332046839594824, 1.0, 1.5604791694987517, 0.6414255032093856], [0.3802522361707601, 0.0, -0.3802522361707601, 1.0, -1.9305925904180488, 0.9329389926581774]],
    (2, 5, 15): [[0.4733174123294103, 0.0, -0.4733174123294103, 1.0, -0.31331679053355754, 0.41067264428998185], [0.2956563253782418, 0.0, -0.2956563253782418, 1.0, -1.3873952186818863, 0.6318784057053939]],
    (2, 8, 16): [[0.34718398342428164, 0.0, -0.34718398342428164, 1.0, -0.1665239573358221, 0.5348424251148556], [0.2812084589124204, 0.0, -0.2812084589124204, 1.0, -1.0524274591616383, 0.6232365229099974]],
    (4, 2, 10): [
        [0.4253819252923047, 0.0, -0.4253819252923047, 1.0, -0.9636433026126888, 0.3154181665485631],
        [0.6373087247952421, 0.0, -0.6373087247952421, 1.0, -0.942530749120051, 0.6394841751623183],
        [0.20823488488486674, 0.0, -0.20823488488486674, 1.0, -1.6061469444778382, 0.6648804032163005],
        [0.1808511491305603, 0.0, -0.1808511491305603, 1.0, -1.8591221015407862, 0.8976952634335985],
    ],
}


def filter_sql(order: int, low: float, high: float, source: str = "s") -> str:
    """y (vec_id, n, v): the windows of ``source``, extended oddly at both ends, through each section forward and then backward by recursion, from
    the state that a long input of the first sample leaves behind."""
    sections = SECTIONS[order, low, high]
    pad = 3 * (2 * len(sections) + 1)
    last = 63 + 2 * pad
    out = [f"""x0 AS MATERIALIZED (SELECT a.vec_id, t, CASE WHEN t < {pad} THEN 2 * f.v - a.v WHEN t > {pad + 63} THEN 2 * l.v - a.v ELSE a.v END AS v FROM (SELECT unnest(range({last + 1})) AS t) JOIN {source} a ON a.n = CASE WHEN t < {pad} THEN {pad} - t WHEN t > {pad + 63} THEN 126 - (t - {pad}) ELSE t - {pad} END
        JOIN {source} f ON f.vec_id = a.vec_id AND f.n = 0 JOIN {source} l ON l.vec_id = a.vec_id AND l.n = 63)"""]
    now = "x0"
    for way in ("f", "b"):
        if way == "b":
            out.append(f"xb AS MATERIALIZED (SELECT vec_id, {last} - t AS t, v FROM {now})")
            now = "xb"
        begin, gain = now, 1.0
        for j, (b0, b1, b2, _, a1, a2) in enumerate(sections):
            name, dc = f"{way}{j}", (b0 + b1 + b2) / (1 + a1 + a2)
            z0, z1 = b1 - a1 * dc + b2 - a2 * dc, b2 - a2 * dc
            b0, b1, b2, a1, a2, z0, z1 = (f"({x!r}e0)" if "e" not in repr(x) else f"({x!r})" for x in (b0, b1, b2, a1, a2, z0 * gain, z1 * gain))
            out.append(f"""{name}_r AS (SELECT x.vec_id, 0 AS t, {b0} * x.v + {z0} * g.v AS o, {b1} * x.v - {a1} * ({b0} * x.v + {z0} * g.v) + {z1} * g.v AS z0, {b2} * x.v - {a2} * ({b0} * x.v + {z0} * g.v) AS z1 FROM {now} x JOIN {begin} g ON g.vec_id = x.vec_id AND g.t = 0 WHERE x.t = 0
                UNION ALL SELECT r.vec_id, x.t, {b0} * x.v + r.z0, {b1} * x.v - {a1} * ({b0} * x.v + r.z0) + r.z1, {b2} * x.v - {a2} * ({b0} * x.v + r.z0) FROM {name}_r r JOIN {now} x ON x.vec_id = r.vec_id AND x.t = r.t + 1),
                {name} AS MATERIALIZED (SELECT vec_id, t, o AS v FROM {name}_r)""")
            now, gain = name, gain * dc
    out.append(f"y AS (SELECT vec_id, {last} - t - {pad} AS n, v FROM {now} WHERE {last} - t BETWEEN {pad} AND {pad + 63})")
    return ", ".join(out)


@query(f"WITH RECURSIVE {LONG_SQL}, {filter_sql(2, 5, 15)}, e AS (SELECT vec_id, n, v * v AS v FROM y), {peaks_sql('pk', 'e', 19, height='avg(v) + 0.5e0 * stddev_pop(v)')}" + FOUND.format(at="n"))
def peaks_r(spark, d):
    return found(spark, d, "r_peaks")


NEAR_TOP = "pk AS (SELECT DISTINCT h.vec_id, arg_max(s.n, (s.v, -s.n)) AS n FROM hits h JOIN s ON s.vec_id = h.vec_id AND s.n BETWEEN h.n - 6 AND h.n + 6 GROUP BY h.vec_id, h.n)"
INTEGRATED = "dy AS (SELECT vec_id, n, pow(v - coalesce(lag(v) OVER (PARTITION BY vec_id ORDER BY n), v), 2) AS v FROM y), be AS (SELECT a.vec_id, a.n, sum(b.v) / 9 AS v FROM dy a JOIN dy b ON a.vec_id = b.vec_id AND abs(a.n - b.n) <= 4 GROUP BY a.vec_id, a.n)"


@query(f"""WITH RECURSIVE {LONG_SQL}, {filter_sql(2, 5, 15)}, {INTEGRATED}, {peaks_sql('cand', 'be', 16)}, seq AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY n) AS i FROM cand),
    st AS (SELECT vec_id, 0 AS i, 0.25e0 * max(v) AS sig, 0.5e0 * avg(v) AS noise, CAST(NULL AS BIGINT) AS n FROM be GROUP BY vec_id
        UNION ALL SELECT st.vec_id, q.i, CASE WHEN q.v > noise + 0.25e0 * (sig - noise) THEN sig + 0.125e0 * (q.v - sig) ELSE sig END, CASE WHEN q.v > noise + 0.25e0 * (sig - noise) THEN noise ELSE noise + 0.125e0 * (q.v - noise) END, CASE WHEN q.v > noise + 0.25e0 * (sig - noise) THEN q.n END FROM st JOIN seq q ON q.vec_id = st.vec_id AND q.i = st.i + 1),
    hits AS (SELECT vec_id, n FROM st WHERE n IS NOT NULL), {NEAR_TOP}""" + FOUND.format(at="n"))
def peaks_r_integrated(spark, d):
    return found(spark, d, "integrated")


@query(f"""WITH RECURSIVE {LONG_SQL}, {filter_sql(2, 8, 16)}, dy AS (SELECT vec_id, n, abs(v - coalesce(lag(v) OVER (PARTITION BY vec_id ORDER BY n), 0)) AS v FROM y), {mean_sql('sl', 'dy', 5)}, {peaks_sql('cand', 'sl', 12, rounds=6)}, seq AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY n) AS i FROM cand),
    st AS (SELECT vec_id, 0 AS i, [0.5e0 * max(v)] AS beats, [0e0] AS noises, CAST(NULL AS BIGINT) AS n FROM sl GROUP BY vec_id
        UNION ALL SELECT st.vec_id, q.i, CASE WHEN q.v > list_median(noises) + 0.45e0 * (list_median(beats) - list_median(noises)) THEN list_append(beats, q.v) ELSE beats END, CASE WHEN q.v > list_median(noises) + 0.45e0 * (list_median(beats) - list_median(noises)) THEN noises ELSE list_append(noises, q.v) END,
            CASE WHEN q.v > list_median(noises) + 0.45e0 * (list_median(beats) - list_median(noises)) THEN q.n END FROM st JOIN seq q ON q.vec_id = st.vec_id AND q.i = st.i + 1),
    hits AS (SELECT vec_id, n FROM st WHERE n IS NOT NULL), {NEAR_TOP}""" + FOUND.format(at="n"))
def peaks_r_slopes(spark, d):
    return found(spark, d, "slopes")


GRADIENT = f"""{filter_sql(2, 0.5, 28.8)}, gr AS (SELECT vec_id, n, abs(CASE WHEN n = 0 THEN b - v WHEN n = 63 THEN v - a ELSE (b - a) / 2 END) AS v FROM (SELECT *, lag(v) OVER w AS a, lead(v) OVER w AS b FROM y WINDOW w AS (PARTITION BY vec_id ORDER BY n))),
    {mean_sql('ms', 'gr', 6)}, {mean_sql('ml', 'gr', 48)}, ab AS (SELECT ms.vec_id, ms.n, ms.v > 1.5e0 * ml.v AS up FROM ms JOIN ml ON ml.vec_id = ms.vec_id AND ml.n = ms.n),
    rg AS (SELECT vec_id, n, sum(CAST(NOT up AS INTEGER)) OVER (PARTITION BY vec_id ORDER BY n) AS g, up FROM ab), rz AS (SELECT vec_id, g, min(n) AS a, max(n) + 1 AS b FROM rg WHERE up GROUP BY vec_id, g), rw AS (SELECT *, avg(b - a) OVER (PARTITION BY vec_id) AS mean FROM rz),
    tp AS (SELECT w.vec_id, w.a, arg_max(s.n, (s.v, -s.n)) AS n FROM rw w JOIN s ON s.vec_id = w.vec_id AND s.n >= w.a AND s.n < w.b WHERE w.b - w.a >= 0.4e0 * w.mean GROUP BY w.vec_id, w.a), seq AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY a) AS i FROM tp),
    st AS (SELECT DISTINCT vec_id, 0 AS i, CAST(-1000 AS BIGINT) AS last, CAST(NULL AS BIGINT) AS n FROM s UNION ALL SELECT st.vec_id, q.i, CASE WHEN q.n - last >= 19.2e0 THEN q.n ELSE last END, CASE WHEN q.n - last >= 19.2e0 THEN q.n END FROM st JOIN seq q ON q.vec_id = st.vec_id AND q.i = st.i + 1),
    gp AS (SELECT vec_id, n FROM st WHERE n IS NOT NULL)"""


@query(f"WITH RECURSIVE {LONG_SQL}, {GRADIENT}, pk AS (SELECT * FROM gp)" + FOUND.format(at="n"))
def peaks_r_gradient(spark, d):
    return found(spark, d, "gradient")


@query(f"""WITH RECURSIVE {LONG_SQL}, {GRADIENT}, few AS (SELECT s.vec_id FROM s LEFT JOIN gp ON gp.vec_id = s.vec_id AND gp.n = s.n GROUP BY s.vec_id HAVING count(gp.n) < 2),
    {INTEGRATED.replace("FROM y)", "FROM s)")}, {peaks_sql('fb', 'be', 12, height='0.3e0 * (avg(v) + stddev_pop(v))', rounds=6)}, pk AS (SELECT vec_id, n FROM gp WHERE vec_id NOT IN (SELECT vec_id FROM few) UNION ALL SELECT vec_id, n FROM fb WHERE vec_id IN (SELECT vec_id FROM few))""" + FOUND.format(at="n"))
def peaks_recording(spark, d):
    """The gradient detector, and integrated energy where it finds fewer than two beats."""
    return found(spark, d, "recording")


ORACLES["band_pass_filter"] = f"WITH RECURSIVE {LONG_SQL}, {filter_sql(4, 2, 10)} SELECT y.vec_id, round(any_value(b.sd), 6) AS std_before, round(stddev_pop(y.v), 6) AS std_after FROM y JOIN (SELECT vec_id, stddev_pop(v) AS sd FROM s GROUP BY vec_id) b USING (vec_id) GROUP BY y.vec_id"


# Transforms, told by moments of their result


def moment(x) -> object:
    return S.added(F.transform(x, lambda v, i: v * (i + 1)))


def transformed(spark: SparkSession, d: str, **columns) -> DataFrame:
    y = samples(spark, d).select("vec_id", *[c.alias(k) for k, c in columns.items()])
    return rounded(y.select("vec_id", *[moment(F.col(k)).alias(k) for k in columns], *[F.size(k).cast("long").alias(f"n_{k}") for k in columns]))


@query(f"WITH {LONG_SQL}, {mean_sql('mm', 's', 6)} SELECT vec_id, round(sum(v * (n + 1)), 6) AS y, count(*) AS n_y FROM mm GROUP BY vec_id")
def moving_average(spark, d):
    return transformed(spark, d, y=udfs.moving_mean(6)(F.col("x")))


@query(f"WITH {LONG_SQL}, {DIFF2} SELECT a.vec_id, round(sum(b.v * (a.n + 1)) / 9, 6) AS y, 64 AS n_y FROM d2 a JOIN d2 b ON a.vec_id = b.vec_id AND abs(a.n - b.n) <= 4 GROUP BY a.vec_id")
def boxcar_energy(spark, d):
    from pulsegrid.functions import dsp

    return transformed(spark, d, y=udfs.array_function(lambda x: dsp.boxcar_energy(x, 64))(F.col("x")))


@query(f"""WITH {LONG_SQL}, wg AS (SELECT j, {GAUS2} AS w FROM (SELECT 4e0 AS a, unnest(range(-20, 21)) AS j)), wm AS (SELECT j, {MORLET} AS w FROM (SELECT 6e0 AS a, unnest(range(-24, 25)) AS j)),
    g AS (SELECT a.vec_id, sum(b.v * w * (a.n + 1)) AS y FROM s a JOIN s b USING (vec_id) JOIN wg ON wg.j = b.n - a.n GROUP BY a.vec_id), m AS (SELECT a.vec_id, sum(b.v * w * (a.n + 1)) AS z FROM s a JOIN s b USING (vec_id) JOIN wm ON wm.j = b.n - a.n GROUP BY a.vec_id)
    SELECT vec_id, round(y, 6) AS gaus, round(z, 6) AS morlet, 64 AS n_gaus, 64 AS n_morlet FROM g JOIN m USING (vec_id)""")
def cwt_scales(spark, d):
    from pulsegrid.functions import dsp

    one = lambda name, a: udfs.array_function(lambda x: dsp.cwt(x, name, np.array([a]))[0])(F.col("x"))
    return transformed(spark, d, gaus=one("gaus2", 4.0), morlet=one("morlet", 6.0))


@query(f"WITH {LONG_SQL}, {RESAMPLED.format(m=32)} SELECT vec_id, round(sum(v * (n + 1)), 6) AS y, count(*) AS n_y FROM y GROUP BY vec_id")
def fft_resampled(spark, d):
    return transformed(spark, d, y=udfs.resampled(32)(F.col("x")))


@query(f"WITH {LONG_SQL} SELECT vec_id, round(sum(v * (n // 3 + 1)), 6) AS y, count(*) AS n_y FROM s WHERE n % 3 = 0 GROUP BY vec_id")
def downsampled(spark, d):
    return transformed(spark, d, y=N.thinned(F.col("x"), 20))


# Feature blocks


ACF = """z AS (SELECT vec_id, sum(cv * cv) AS z FROM c GROUP BY vec_id),
    ac AS (SELECT a.vec_id, b.n - a.n AS lag, sum(a.cv * b.cv) / any_value(z.z) AS r FROM c a JOIN c b ON a.vec_id = b.vec_id AND b.n >= a.n JOIN z ON z.vec_id = a.vec_id GROUP BY ALL),
    pk AS (SELECT vec_id, lag AS k, r AS top FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY r DESC, lag) AS i FROM ac WHERE lag >= 21 AND lag < 63) WHERE i = 1),
    af AS (SELECT vec_id, top AS acf_peak, 60 * 64e0 / k AS acf_bpm, CAST(coalesce(min(lag) FILTER (lag >= k AND lag <= 63 AND r <= top / 2), 63) - coalesce(max(lag) FILTER (lag >= 21 AND lag <= k AND r <= top / 2), 21) AS DOUBLE) AS acf_width
        FROM pk JOIN ac USING (vec_id) GROUP BY vec_id, top, k)"""


@query(f"WITH {LONG_SQL}, {ACF} SELECT vec_id, round(acf_peak, 6) AS acf_peak, round(acf_bpm, 6) AS acf_bpm, acf_width FROM af")
def feat_acf_regularity(spark, d):
    from pulsegrid.functions import window_features as W

    acf = udfs.struct_function(lambda x: W.acf_regularity(x, 64), W.ACF_KEYS)
    return rounded(samples(spark, d).select("vec_id", acf(F.col("x")).alias("f")).select("vec_id", "f.*"))


def swt_sql(level: int = 6) -> str:
    """u: the window in [0, 1]; l1, l2, ...: approximation c and detail d of each level; PAPR of both, in time and in the spectrum."""
    out = ["u AS (SELECT s.vec_id, n, (v - lo) / (hi - lo) AS c FROM s JOIN (SELECT vec_id, min(v) AS lo, max(v) AS hi FROM s GROUP BY vec_id) USING (vec_id))", "t AS (SELECT unnest(range(8)) AS k)"]
    for i in range(1, level + 1):
        before, step = f"l{i - 1}" if i > 1 else "u", 1 << (i - 1)
        out.append(f"l{i} AS MATERIALIZED (SELECT a.vec_id, a.n, sum(b.c * {DB4}[8 - k]) AS c, sum(b.c * {DB4}[k + 1] * (CASE WHEN k % 2 = 0 THEN -1 ELSE 1 END)) AS d FROM {before} a, t JOIN {before} b ON b.vec_id = a.vec_id AND b.n = (a.n + {step} * (k - 4) + 512) % 64 GROUP BY a.vec_id, a.n)")
        out.append(f"pd{i} AS (SELECT vec_id, CASE WHEN avg(pow(d - m, 2)) > 1e-24 * avg(d * d) THEN max(pow(d - m, 2)) / avg(pow(d - m, 2)) END AS d FROM (SELECT *, avg(d) OVER (PARTITION BY vec_id) AS m FROM l{i}) GROUP BY vec_id)")
        out.append(f"fc{i} AS (SELECT vec_id, k, pow(sum((c - m) * cos(2 * pi() * (k * n % 64) / 64e0)), 2) + pow(sum((c - m) * sin(2 * pi() * (k * n % 64) / 64e0)), 2) AS p, any_value(e) AS e FROM (SELECT *, avg(c) OVER (PARTITION BY vec_id) AS m, sum(c * c) OVER (PARTITION BY vec_id) AS e FROM l{i}), (SELECT unnest(range(33)) AS k) GROUP BY vec_id, k)")
        out.append(f"pc{i} AS (SELECT vec_id, CASE WHEN avg(p) > 1e-24 * any_value(e) THEN max(p) / avg(p) END AS c FROM fc{i} GROUP BY vec_id)")
    return ", ".join(out)


LEVELS = range(1, 7)
PAPR = ", ".join([f'round(pd{i}.d, 6) AS "PAPR_d{i}"' for i in LEVELS] + [f'round(pc{i}.c, 6) AS "PAPR_c{i}"' for i in LEVELS])
PAPR_FROM = "pd1 " + " ".join([f"JOIN pd{i} USING (vec_id)" for i in LEVELS if i > 1] + [f"JOIN pc{i} USING (vec_id)" for i in LEVELS])
UNIT = """q AS (SELECT vec_id, quantile_cont(c, 0.25) AS p25, quantile_cont(c, 0.5) AS median, quantile_cont(c, 0.75) AS p75, avg(c) AS mean, stddev_pop(c) AS std FROM u GROUP BY vec_id),
    h AS (SELECT vec_id, least(floor(c * 32), 31) AS b, count(*) AS k FROM u GROUP BY ALL), en AS (SELECT vec_id, -sum(k / 64e0 * ln(k / 64e0)) / ln(count(*)) AS entropy FROM h GROUP BY vec_id),
    mt AS (SELECT vec_id, avg(abs(c - mean)) AS mad, avg(pow(c - mean, 3)) / pow(avg(pow(c - mean, 2)), 1.5) AS skew, avg(pow(c - mean, 4)) / pow(avg(pow(c - mean, 2)), 2) - 3 AS kurtosis FROM u JOIN q USING (vec_id) GROUP BY vec_id),
    fu AS (SELECT vec_id, k, (pow(sum((c - mean) * cos(2 * pi() * (k * n % 64) / 64e0)), 2) + pow(sum((c - mean) * sin(2 * pi() * (k * n % 64) / 64e0)), 2)) / 64 AS psd FROM u JOIN q USING (vec_id), (SELECT unnest(range(33)) AS k) GROUP BY vec_id, k),
    ft AS (SELECT vec_id, sum(psd) AS total, -sum(CASE WHEN psd > 0 THEN psd * ln(psd) END) AS hh, count(*) FILTER (psd > 1e-24 * total) AS nn FROM (SELECT *, sum(psd) OVER (PARTITION BY vec_id) AS total FROM fu) GROUP BY vec_id),
    fr AS (SELECT vec_id, k, psd FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY psd DESC, k) AS r FROM fu WHERE k >= 0.7 AND k <= 10) WHERE r = 1)"""

ORACLES["bcg_block"] = f"""WITH {LONG_SQL}, {swt_sql()}, {UNIT}
    SELECT vec_id, {PAPR}, round(mean, 6) AS mean, round(median, 6) AS median, round(std, 6) AS std, round(mad, 6) AS mad, round(p25, 6) AS p25, round(p75, 6) AS p75, round(p75 - p25, 6) AS iqr, round(entropy, 6) AS entropy,
        round(skew, 6) AS skew, round(kurtosis, 6) AS kurtosis, CAST(fr.k AS DOUBLE) AS f_dominant, round(psd, 6) AS f_magnitude, round(psd / total, 6) AS f_share, round((hh / total + ln(total)) / ln(nn), 6) AS f_entropy
    FROM {PAPR_FROM} JOIN q USING (vec_id) JOIN en USING (vec_id) JOIN mt USING (vec_id) JOIN ft USING (vec_id) JOIN fr USING (vec_id)"""


@query(f"WITH {LONG_SQL}, {swt_sql()} SELECT vec_id, {PAPR} FROM {PAPR_FROM}")
def swt_db4_papr(spark, d):
    from pulsegrid.functions import window_features as W

    return rounded(C.kernel_rows(spark, d, udfs.bcg_features(64)(F.col("x"))).select("vec_id", *W.papr_keys()))


NO_RR = ", ".join(f'CAST(NULL AS DOUBLE) AS "{k}"' for k in ("meanRR", "SDNN", "RMSSD", "pNN50", "SD1", "SD2", "SD1_SD2", "CoSEn", "rrShannon", "TPR", "DFA_a1", "Lorenz_occ", "Lorenz_origin", "dRR_SD", "RR_CV", "RMSSDn", "dRR_MAD"))

# A window of one second holds fewer than five beats: no RR features.
ORACLES["signal_block"] = f"""WITH {LONG_SQL}, {C.RAW}, {ACF},
    td AS (SELECT vec_id, avg(v) AS mean, sqrt(avg(cv * cv)) AS std, avg(cv * cv * cv) / pow(avg(cv * cv), 1.5) AS skew, avg(pow(cv, 4)) / pow(avg(cv * cv), 2) - 3 AS kurtosis, sqrt(avg(v * v)) AS rms, max(v) - min(v) AS rng FROM c GROUP BY vec_id),
    fd AS (SELECT vec_id, sum(psd) FILTER (k >= 0.6 AND k < 3.6) AS pulse, sum(psd) FILTER (k < 32) AS total, arg_max(k, psd) AS dominant, sum(psd) AS s0, -sum(psd * ln(psd)) FILTER (psd > 0) AS h, count(*) FILTER (psd > 0) AS nn FROM f GROUP BY vec_id),
    sd AS (SELECT vec_id, 0.2e0 * stddev_pop(v) AS r FROM s GROUP BY vec_id),
    t3 AS (SELECT a.vec_id, a.n, a.v AS v0, lead(a.v) OVER w AS v1, lead(a.v, 2) OVER w AS v2 FROM s a WINDOW w AS (PARTITION BY a.vec_id ORDER BY a.n)),
    se AS (SELECT a.vec_id, count(*) FILTER (a.n < 62 AND b.n < 62) AS b, count(*) FILTER (a.n < 61 AND b.n < 61 AND abs(a.v2 - b.v2) < sd.r) AS a
        FROM t3 a JOIN t3 b ON a.vec_id = b.vec_id AND a.n <> b.n JOIN sd ON sd.vec_id = a.vec_id WHERE abs(a.v0 - b.v0) < sd.r AND abs(a.v1 - b.v1) < sd.r GROUP BY a.vec_id)
    SELECT vec_id, round(mean, 6) AS mean, round(std, 6) AS std, round(skew, 6) AS skew, round(kurtosis, 6) AS kurtosis, round(rms, 6) AS rms, round(rng, 6) AS "range", round(pulse, 6) AS freq_puls, round(pulse / total, 6) AS freq_puls_norm,
        0e0 AS freq_resp_norm, CAST(NULL AS DOUBLE) AS freq_puls_resp, CAST(dominant AS DOUBLE) AS freq_dominant, round((h / s0 + ln(s0)) / ln(nn), 6) AS spec_entropy,
        CASE WHEN a > 0 AND b > 0 THEN round(-ln((a / (61e0 * 60)) / (b / (62e0 * 61))), 6) END AS sample_entropy, round(acf_peak, 6) AS acf_peak, round(acf_bpm, 6) AS acf_bpm, acf_width, {NO_RR}
    FROM td JOIN fd USING (vec_id) JOIN af USING (vec_id) LEFT JOIN se USING (vec_id)"""

# Quality indices

AMPLITUDE = f"{peaks_sql('pa', 's', 25, 0.3)}, pr AS (SELECT vec_id, n, n - lag(n) OVER (PARTITION BY vec_id ORDER BY n) AS rr FROM pa), pn AS (SELECT vec_id, count(*) AS k, quantile_cont(rr, 0.5) AS med, avg(rr) AS mean, max(rr) AS hi, min(rr) AS lo FROM pr GROUP BY vec_id), ph AS (SELECT vec_id, greatest(2, CAST(floor(0.33e0 * med) AS INTEGER)) AS half FROM pn WHERE k >= 3), {template_sql('tp', 'pa', 'ph')}, ts AS (SELECT DISTINCT s.vec_id, CASE WHEN n_rows >= 3 THEN greatest(r, 0) ELSE 0 END AS t FROM s LEFT JOIN tp USING (vec_id))"

ORACLES["sqi_block"] = f"""WITH {LONG_SQL}, {C.CEN}, {AMPLITUDE}, {mean_sql('mm', 's', 6)}, {peaks_sql('ps', 'mm', 25, 0.3)},
    ks AS (SELECT vec_id, avg(pow(cv, 4)) / pow(avg(cv * cv), 2) - 3 AS k, avg(cv * cv * cv) / pow(avg(cv * cv), 1.5) AS sk FROM c GROUP BY vec_id), pw AS (SELECT vec_id, sum(psd) FILTER (k >= 0.6 AND k < 3.6) / sum(psd) AS p FROM f GROUP BY vec_id),
    nr AS (SELECT a.vec_id, a.n, arg_min(b.n, (abs(a.n - b.n), b.n)) AS b, min(abs(a.n - b.n)) AS gap FROM pa a JOIN ps b USING (vec_id) GROUP BY a.vec_id, a.n),
    hit AS (SELECT vec_id, count(DISTINCT b) FILTER (gap <= 9.6) AS hits FROM nr GROUP BY vec_id), na AS (SELECT vec_id, count(*) AS na FROM pa GROUP BY vec_id), nb AS (SELECT vec_id, count(*) AS nb FROM ps GROUP BY vec_id)
    SELECT vec_id, round(k, 6) AS "kSQI", round(sk, 6) AS "sSQI", round(p, 6) AS "pSQI", round(coalesce(2 * hits / (na + nb), 0), 6) AS "bSQI", round(t, 6) AS "tSQI",
        round(0.5e0 * t + 0.3e0 * p + 0.2e0 * least(greatest(1 - greatest(k - 3, 0) / 10, 0), 1), 6) AS composite
    FROM ks JOIN pw USING (vec_id) JOIN ts USING (vec_id) LEFT JOIN hit USING (vec_id) LEFT JOIN na USING (vec_id) LEFT JOIN nb USING (vec_id)"""

SAMPEN = ORACLES["feat_sampen"].split("SELECT vec_id, CASE")[0].split(LONG_SQL)[1].strip().removeprefix(",")

ORACLES["window_scalars"] = f"""WITH {LONG_SQL}, {AMPLITUDE}, {ORIENTED}, {peaks_sql('po', 'o', 19, 0.5)}, {SAMPEN},
    oh AS (SELECT DISTINCT vec_id, 3 AS half FROM s), {template_sql('tc', 'po', 'oh')}, on_ AS (SELECT vec_id, count(*) AS k FROM po GROUP BY vec_id),
    og AS (SELECT vec_id, n - lag(n) OVER (PARTITION BY vec_id ORDER BY n) AS rr FROM po), pl AS (SELECT vec_id, avg(CAST(rr / 64e0 >= 0.3e0 AND rr / 64e0 <= 2 AS INTEGER)) FILTER (rr IS NOT NULL) AS pl FROM og GROUP BY vec_id),
    ab AS (SELECT vec_id, n, abs(v - med) AS c FROM s JOIN md USING (vec_id)), mad AS (SELECT vec_id, quantile_cont(c, 0.5) AS mad FROM ab GROUP BY vec_id), sn AS (SELECT ab.vec_id, quantile_cont(c, 0.5) AS top FROM ab JOIN po ON po.vec_id = ab.vec_id AND po.n = ab.n GROUP BY ab.vec_id)
    SELECT i.vec_id, round(ts.t, 6) AS t_sqi, round(CASE WHEN tc.n_rows >= 3 THEN tc.r ELSE 0 END, 6) AS cor_sqi, round(CASE WHEN on_.k >= 3 AND mad > 0 THEN least(greatest(top / (8 * mad), 0), 1) ELSE 0 END, 6) AS peak_snr,
        round(CASE WHEN on_.k >= 4 THEN pl ELSE 0 END, 6) AS rr_plausibility, CAST(coalesce(on_.k, 0) * 60 BETWEEN 30 AND 220 AS INTEGER) * 1e0 AS beat_count_ok,
        CASE WHEN pn.k >= 3 AND 60 * 64 / pn.mean BETWEEN 40 AND 180 AND pn.hi / pn.lo <= 2.2e0 AND ts.t >= 0.66e0 THEN 1e0 ELSE 0e0 END AS acceptable,
        CASE WHEN m.a > 0 AND m.b > 0 THEN round(-ln((m.a / (61e0 * 60)) / (m.b / (62e0 * 61))), 6) END AS sample_entropy
    FROM (SELECT DISTINCT vec_id FROM s) i LEFT JOIN ts USING (vec_id) LEFT JOIN tc USING (vec_id) LEFT JOIN on_ USING (vec_id) LEFT JOIN pl USING (vec_id) LEFT JOIN mad USING (vec_id) LEFT JOIN sn USING (vec_id) LEFT JOIN pn USING (vec_id) LEFT JOIN m USING (vec_id)"""


@query(f"WITH {LONG_SQL}, {peaks_sql('pk', 's', 25, 0.3)}, g AS (SELECT vec_id, n - lag(n) OVER (PARTITION BY vec_id ORDER BY n) AS rr FROM pk), h AS (SELECT vec_id, 60 / (quantile_cont(rr, 0.5) / 64e0) AS hr FROM g WHERE rr > 0 GROUP BY vec_id) SELECT DISTINCT s.vec_id, round(CASE WHEN hr BETWEEN 40 AND 180 THEN hr END, 6) AS hr FROM s LEFT JOIN h USING (vec_id)")
def hr_peaks(spark, d):
    from pulsegrid.functions import window_features as W
    from pulsegrid.functions.detectors import by_amplitude

    rate = udfs.scalar_function(lambda x: W.hr_peaks(by_amplitude(x, 64), 64))
    return rounded(samples(spark, d).select("vec_id", rate(F.col("x")).alias("hr")))


@query(f"""WITH {C.X_SQL} SELECT patient, win_idx, round(least(greatest(1 - greatest(8 * p_cecg - 3, 0) / 10, 0), 1), 6) AS kq,
    round(0.5e0 * p_ppg + 0.3e0 * p_bcg + 0.2e0 * least(greatest(1 - greatest(8 * p_cecg - 3, 0) / 10, 0), 1), 6) AS composite FROM ex""")
def sqi_composite(spark, d):
    """The composite from stored parts: template quality, share of power in the band, kurtosis."""
    k = N.kurtosis_quality(8 * F.col("p_cecg"))
    return rounded(C.experts(spark, d).select("patient", "win_idx", k.alias("kq"), (0.5 * F.col("p_ppg") + 0.3 * F.col("p_bcg") + 0.2 * k).alias("composite")))


@query(f"WITH {C.X_SQL} SELECT patient, win_idx, abs(60 + 10 * e_cecg - 60 - 10 * e_ppg) <= 10 AS agrees FROM ex")
def rate_agreement(spark, d):
    return C.experts(spark, d).select("patient", "win_idx", N.rate_agrees(60 + 10 * F.col("e_cecg"), 60 + 10 * F.col("e_ppg")).alias("agrees"))


# RR series


COSEN = """m0 AS (SELECT user_id, count(*) AS n, avg(rr) AS m, greatest(0.01e0 * stddev_pop(rr), 1) AS r0 FROM rr GROUP BY user_id),
    tp AS (SELECT user_id, i, rr AS a, lead(rr) OVER (PARTITION BY user_id ORDER BY i) AS b FROM rr), pq AS (SELECT x.user_id, abs(x.a - y.a) AS d0, greatest(abs(x.a - y.a), abs(x.b - y.b)) AS d1 FROM tp x JOIN tp y ON x.user_id = y.user_id AND x.i < y.i AND x.b IS NOT NULL AND y.b IS NOT NULL),
    gr AS (SELECT user_id, k, any_value(m0.m) AS m, any_value(r0 * pow(1.6e0, k)) AS r, count(*) FILTER (d0 <= r0 * pow(1.6e0, k)) AS b, count(*) FILTER (d1 <= r0 * pow(1.6e0, k)) AS a FROM pq JOIN m0 USING (user_id), (SELECT unnest(range(40)) AS k) WHERE m0.n >= 4 GROUP BY user_id, k),
    cs AS (SELECT user_id, arg_min(-ln(a / b) + ln(2 * r) - ln(m), k) AS cosen FROM gr WHERE b >= 5 AND a >= 1 GROUP BY user_id)"""


def part_of(name: str, alias: str) -> str:
    """A query's twin as a table, behind the shared CTEs of RR_SQL."""
    return f"{alias} AS (WITH " + ORACLES[name].split("WITH ", 1)[1] + ")"


ORACLES["rr_cosen"] = f"""WITH {C.RR_SQL}, {COSEN}, {part_of('rr_shannon', 'sh')}, {part_of('rr_turning_point', 'tu')}, {part_of('rr_dfa', 'df')}, {part_of('rr_lorenz', 'lo')}, {part_of('rr_robust', 'ro')}
    SELECT u.user_id, round(cosen, 6) AS "CoSEn", "rrShannon", "TPR", "DFA_a1", CAST("Lorenz_occ" AS DOUBLE) AS "Lorenz_occ", "Lorenz_origin", "dRR_SD", "RR_CV", "RMSSDn", "dRR_MAD"
    FROM (SELECT DISTINCT user_id FROM rr) u LEFT JOIN cs USING (user_id) LEFT JOIN sh USING (user_id) LEFT JOIN tu USING (user_id) LEFT JOIN df USING (user_id) LEFT JOIN lo USING (user_id) LEFT JOIN ro USING (user_id)"""


@query(f"""WITH {C.RR_SQL}, {COSEN}, st AS (SELECT user_id, count(*) AS n, 60000 / quantile_cont(rr, 0.5) AS hr, stddev_pop(d) AS sd FROM x GROUP BY user_id), al AS (SELECT * FROM st LEFT JOIN cs USING (user_id)),
    pr AS (SELECT a.user_id, a.n >= 4 AND b.n >= 4 AS valid, abs(a.hr - b.hr) AS hr_err, abs(a.cosen - b.cosen) AS cosen_err, abs(a.sd - b.sd) AS drr_sd_err FROM al a JOIN al b ON b.user_id = a.user_id + 1)
    SELECT user_id, valid, round(CASE WHEN valid THEN hr_err END, 6) AS hr_err, round(CASE WHEN valid THEN cosen_err END, 6) AS cosen_err, round(CASE WHEN valid THEN drr_sd_err END, 6) AS drr_sd_err FROM pr""")
def rr_error_metrics(spark, d):
    """Each user's RR series against the next user's."""
    a = C.rr_table(spark, d).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("i", "rr"))).alias("s")).select("user_id", F.transform("s", lambda x: x["rr"]).alias("rr"))
    ref = a.select((F.col("user_id") - 1).alias("user_id"), F.col("rr").alias("ref"))
    return rounded(a.join(ref, "user_id").select("user_id", udfs.rr_errors()("rr", "ref").alias("e")).select("user_id", "e.*"))


# Alignment and windows


@query(f"""WITH {LONG_SQL}, fl AS (SELECT vec_id, n, CASE WHEN vec_id % 3 = 0 THEN -v ELSE v END AS v FROM s), sh AS (SELECT a.vec_id, a.n, coalesce(b.v, 0) AS v FROM fl a LEFT JOIN fl b ON a.vec_id = b.vec_id AND b.n = a.n - 2),
    p AS (SELECT vec_id, n, n + n * 3e0 / 63 AS pos FROM s), y AS (SELECT p.vec_id, p.n, CASE WHEN pos > 63 THEN 0 ELSE lo.v * (1 - (pos - floor(pos))) + coalesce(hi.v, 0) * (pos - floor(pos)) END AS v
        FROM p LEFT JOIN sh lo ON lo.vec_id = p.vec_id AND lo.n = CAST(floor(pos) AS BIGINT) LEFT JOIN sh hi ON hi.vec_id = p.vec_id AND hi.n = CAST(floor(pos) AS BIGINT) + 1)
    SELECT vec_id AS patient, round(sum(v * (n + 1)) FILTER (n >= 4 AND n < 58), 6) AS moment, count(*) FILTER (n >= 4 AND n < 58) AS kept, round((SELECT sum(CASE WHEN vec_id % 2 = 0 THEN -v ELSE v END * (n + 1)) FROM s WHERE s.vec_id = y.vec_id), 6) AS reference FROM y GROUP BY vec_id""")
def align_offset_corrected(spark, d):
    """Flip, drift and trim by settings, together; the reference is only flipped."""
    from pulsegrid.sources import alignment

    recs = samples(spark, d).select(F.col("vec_id").alias("patient"), F.col("x").alias("cecg"), F.col("x").alias("gt"))
    flip = F.create_map(*[y for s in alignment.SIGNALS for y in (F.lit(s), F.col("patient") % 3 == 0 if s == "cecg" else F.lit(False))])
    settings = recs.select("patient", flip.alias("invert"), (F.col("patient") % 2 == 0).alias("invert_gt"), F.lit(2).alias("initial_offset"), F.lit(5).alias("final_offset"), F.lit(4 / 64).alias("trim_start_s"), F.lit(6 / 64).alias("trim_end_s"), F.lit("x").alias("source"))
    y = alignment.offset_corrected(recs, settings, 64)
    kept = F.filter(F.transform("cecg", lambda v, i: v * (i + 1)), lambda v: v.isNotNull())
    return rounded(y.select("patient", S.added(kept).alias("moment"), F.size(kept).cast("long").alias("kept"), moment(F.col("gt")).alias("reference")))


@query(f"""WITH {LONG_SQL}, w AS (SELECT unnest(range(7)) AS w), r AS (SELECT vec_id, n + 64 * k AS n, v FROM s, (SELECT unnest(range(2)) AS k)), a AS (SELECT vec_id, w, sum(v * (n - w * 8 + 1)) AS own FROM s, w WHERE n >= w * 8 AND n < w * 8 + 16 GROUP BY ALL),
    b AS (SELECT vec_id, w, sum(v * (n - w * 800 // 64 + 1)) AS ref, count(*) AS k FROM r, w WHERE n >= w * 800 // 64 AND n < w * 800 // 64 + 25 GROUP BY ALL)
    SELECT vec_id, CAST(w AS INTEGER) AS win_idx, round(w / 8e0, 6) AS t_start_s, round(own, 6) AS own, round(ref, 6) AS ref, k AS n_ref FROM a JOIN b USING (vec_id, w) WHERE w * 800 // 64 + 25 <= 128""")
def win_aligned_reference(spark, d):
    """Windows of a quarter second at 64 Hz beside their slices of a reference at 100 Hz."""
    from pulsegrid.operators import windows as W

    recs = samples(spark, d).select("vec_id", "x", F.concat("x", "x").alias("gt"))
    w = W.aligned_windows(recs, 64, 100, 0.25, 0.125, ["x"], "gt")
    return rounded(w.select("vec_id", "win_idx", "t_start_s", moment(F.col("x")).alias("own"), moment(F.col("gt")).alias("ref"), F.size("gt").cast("long").alias("n_ref")))


# Window tables


@query(f"""WITH {C.X_SQL}, l AS (SELECT patient % 4 AS grp, unnest(['cecg', 'ppg', 'bcg']) AS modality, unnest([e_cecg IS NOT NULL, e_ppg IS NOT NULL, e_bcg IS NOT NULL]) AS ok FROM ex)
    SELECT grp, modality, round(avg(CAST(ok AS INTEGER)), 6) AS coverage, count(*) AS n FROM l GROUP BY ALL""")
def validity_coverage(spark, d):
    from pulsegrid.operators.tables import validity_coverage as report

    x = C.experts(spark, d).select((F.col("patient") % 4).alias("grp"), *[F.col(e).isNotNull().alias(f"rel_{e[2:]}_valid") for e in C.ERR])
    return rounded(report(x, keys=["grp"]))


@query(f"WITH {C.X_SQL} SELECT patient, win_idx, round(e_ppg, 6) AS e_ppg FROM ex WHERE win_idx % 5 <> 0 AND win_idx % 3 <> 0 AND e_ppg IS NOT NULL")
def valid_targets(spark, d):
    from pulsegrid.operators.tables import with_valid_target

    x = C.experts(spark, d).withColumn("rel_ppg_valid", F.when(F.col("win_idx") % 5 != 0, F.col("win_idx") % 3 != 0))
    return rounded(with_valid_target(x, "ppg", "e_ppg").select("patient", "win_idx", "e_ppg"))


@query(f"WITH {C.X_SQL} SELECT patient, win_idx, round(greatest(q_cecg, q_ppg, q_bcg), 6) AS best, round((coalesce(q_cecg, 0) + coalesce(q_ppg, 0) + coalesce(q_bcg, 0)) / nullif(CAST(q_cecg IS NOT NULL AS INTEGER) + CAST(q_ppg IS NOT NULL AS INTEGER) + CAST(q_bcg IS NOT NULL AS INTEGER), 0), 6) AS mean FROM ex")
def channel_best_and_mean(spark, d):
    return rounded(C.experts(spark, d).select("patient", "win_idx", N.best_of(C.QUAL).alias("best"), N.mean_of_present(C.QUAL).alias("mean")))


@query(f"WITH {C.X_SQL} SELECT round(p_cecg, 6) AS p_cecg, round(q_ppg, 6) AS q_ppg, y, patient AS \"group\" FROM ex WHERE e_bcg IS NOT NULL")
def split_xy_groups(spark, d):
    from pulsegrid.operators.reports import split_xy_groups as split
    from pulsegrid.operators.reports import without_suffixes

    x = C.experts(spark, d).withColumn("AF", F.when(F.col("e_bcg").isNotNull(), F.col("y")))
    return rounded(split(x, without_suffixes(["p_cecg", "q_ppg", "e_bcg", "q_bcg"], ["bcg"])))


@query(f"WITH {C.X_SQL} SELECT y, round(count(*) / (2e0 * any_value(k)), 6) AS weight, any_value(k) AS n FROM (SELECT y, count(*) OVER () AS nn, count(*) OVER (PARTITION BY y) AS k FROM ex) GROUP BY y".replace("count(*) / (2e0", "any_value(nn) / (2e0"))
def class_weights(spark, d):
    from pulsegrid.learn.pipelines import with_weights

    return rounded(with_weights(C.experts(spark, d), "y").groupBy("y").agg(F.max("_weight").alias("weight"), F.count("*").alias("n")))


@query(f"WITH {C.X_SQL}, w AS (SELECT patient, win_idx, " + ", ".join(f"CASE WHEN e_{m} IS NULL THEN 0 WHEN e_{m} <= 1.5e0 THEN 1 WHEN e_{m} > 4.5e0 THEN 0 ELSE exp(-(e_{m} - 1.5e0) / 0.5e0) END AS w{i}" for i, m in enumerate(("cecg", "ppg", "bcg"))) + " FROM ex) SELECT patient, win_idx, " + ", ".join(f"round(w{i} / CASE WHEN w0 + w1 + w2 = 0 THEN 1 ELSE w0 + w1 + w2 END, 6) AS w{i}" for i in range(3)) + " FROM w")
def weights_decay_keep_zero(spark, d):
    """A row without weight keeps zeros: errors over 4.5 count as missing here, so that there are such rows."""
    x = C.experts(spark, d).withColumns({e: F.when(F.col(e) <= 4.5, F.col(e)) for e in C.ERR})
    w = N.decay_weights(C.ERR, 1.5, 0.5, zero="keep")
    return rounded(x.select("patient", "win_idx", *[c.alias(f"w{i}") for i, c in enumerate(w)]))


# Artefacts of raw windows


def noise_sql(kind: str) -> str:
    md5 = "md5(s.vec_id || ':' || {} || ':7')"
    u = "((CAST('0x' || substr({}, {}, 8) AS BIGINT) + 0.5e0) / 4294967296e0)"
    gauss = lambda d: f"(sqrt(-2 * ln({u.format(d, 1)})) * cos(2 * pi() * {u.format(d, 9)}))"
    if kind == "white":
        return gauss(md5.format("CAST(s.n AS VARCHAR)"))
    out = f"sin(2 * pi() * (0.1e0 + 0.4e0 * {u.format(md5.format(chr(39) + 'sine' + chr(39)), 1)}) * s.n / 64e0 + 2 * pi() * {u.format(md5.format(chr(39) + 'sine' + chr(39)), 9)})"
    for b in range(3):
        start = f"floor({u.format(md5.format(f'{chr(39)}burst {b}{chr(39)}'), 1)} * greatest(len_ - 64, 1))"
        out += f" + CASE WHEN s.n >= {start} AND s.n < {start} + 64 THEN 2e0 * {gauss(md5.format(f'{chr(39)}burst {b}:{chr(39)} || s.n'))} ELSE 0 END"
    return out


def corrupt_sql() -> str:
    parts = [f"SELECT '{k}' AS kind, s.vec_id, s.n, s.v, {noise_sql(k)} AS e FROM (SELECT *, count(*) OVER (PARTITION BY vec_id) AS len_ FROM long_s) s" for k in ("white", "motion")]
    return f"""WITH long_s AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS n, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), x AS ({' UNION ALL '.join(parts)}),
        c AS (SELECT *, v + e * sqrt(var_pop(v) OVER w / pow(10, 0.5e0) / avg(e * e) OVER w) AS y FROM x WINDOW w AS (PARTITION BY kind, vec_id))
        SELECT kind, vec_id, round(10 * log10(var_pop(v) / avg((y - v) * (y - v))), 6) AS snr_db, round(sum(y), 6) AS total, round(max(y), 6) AS top, round(arg_min(y, n), 6) AS first FROM c GROUP BY kind, vec_id"""


@query(corrupt_sql())
def corrupt_raw_window(spark, d):
    """Every window with white noise and with a motion artefact at 5 dB: the measured ratio, and the window's sum, top and first sample."""
    from pulsegrid.functions import noise

    x = samples(spark, d).select("vec_id", "x")
    out = None
    for kind in ("white", "motion"):
        y = x.select(F.lit(kind).alias("kind"), "vec_id", "x", noise.corrupted(F.col("x"), F.col("vec_id"), 64.0, kind, 5.0, 7).alias("y"))
        out = y if out is None else out.unionByName(y)
    gap = F.zip_with("y", "x", lambda a, b: a - b)
    ratio = 10 * F.log10(S.moments(F.col("x"))["m2"] / S.mean_of(F.transform(gap, lambda v: v * v)))
    return rounded(out.select("kind", "vec_id", ratio.alias("snr_db"), S.added(F.col("y")).alias("total"), F.array_max("y").alias("top"), F.get("y", F.lit(0)).alias("first")))

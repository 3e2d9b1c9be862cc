"""The runnable jobs as queries: each runs its job twice into one new folder and returns what stands there afterwards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.plans.catalog import query, rounded
from pulsegrid.sources import cache


def without_zone(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(c) for c, t in df.dtypes])


@query("""WITH e AS (SELECT user_id, ts, value FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
    w AS (SELECT user_id AS patient, date_trunc('day', ts) AS win_start, avg(value) AS score FROM e GROUP BY ALL),
    closed AS (SELECT *, lag(win_start) OVER (PARTITION BY patient ORDER BY win_start) AS former FROM w WHERE win_start + INTERVAL 1 DAY <= (SELECT date_trunc('milliseconds', max(ts)) FROM e) - INTERVAL 1 DAY),
    s AS (SELECT *, sum(CASE WHEN former IS NULL OR win_start - former > INTERVAL 3 DAY THEN 1 ELSE 0 END) OVER (PARTITION BY patient ORDER BY win_start) AS episode FROM closed),
    h AS (SELECT *, sum(CASE WHEN score >= 50 THEN 1 ELSE 0 END) OVER (PARTITION BY patient, episode ORDER BY win_start ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS hits FROM s)
    SELECT patient, CAST(win_start AS TIMESTAMP) AS win_start, round(score, 6) AS score, CAST(hits AS INTEGER) AS hits, hits >= 2 AS alarm,
        CAST(min(win_start) OVER (PARTITION BY patient, episode) AS TIMESTAMP) AS episode_start,
        CAST(min(CASE WHEN hits >= 2 THEN win_start END) OVER (PARTITION BY patient, episode ORDER BY win_start) AS TIMESTAMP) AS first_alarm, CAST(win_start AS DATE) AS day FROM h""")
def job1_alarm_feed(spark, d):
    """Closed windows of the event table with their alarms; the second run finds nothing new."""
    from jobs import alarm_feed

    root = cache.folder(spark)
    for _ in range(2):
        alarm_feed.alarm_feed(spark, f"{d}/events.parquet", f"{root}/alarms", f"{root}/state")
    return rounded(without_zone(alarm_feed.published(spark, f"{root}/alarms")))


SIGNALS = ("length", "distinct", "marks", "word_length", "repeats")


def audit_sql() -> str:
    def each(text: str, sep: str = ", ") -> str:
        return sep.join(text.format(n=n) for n in SIGNALS)

    return rf"""
        WITH d AS (SELECT doc_id, coalesce(source, 'none') AS source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, string_split(text, chr(10)) AS lines FROM documents),
        f AS (
            SELECT doc_id, source, ln(1e0 + len(w)) AS length, len(list_distinct(w)) / nullif(CAST(len(w) AS DOUBLE), 0) AS distinct_,
                (length(text) - length(regexp_replace(text, '[\x21-\x40\x5B-\x60\x7B-\x7E]', '', 'g'))) / nullif(CAST(length(text) AS DOUBLE), 0) AS marks,
                length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) / nullif(CAST(len(w) AS DOUBLE), 0) AS word_length, 1 - len(list_distinct(lines)) / CAST(len(lines) AS DOUBLE) AS repeats FROM d),
        x AS (SELECT f.* RENAME (distinct_ AS "distinct"), y FROM f LEFT JOIN (SELECT doc_id, CAST(max(quality) AS INTEGER) AS y FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id) USING (doc_id)),
        own AS (SELECT source, {each('count("{n}") AS n_{n}, coalesce(sum("{n}"), 0) AS s_{n}, coalesce(sum("{n}" * "{n}"), 0) AS q_{n}, coalesce(sum("{n}") FILTER (y = 1), 0) AS s1_{n}, count("{n}") FILTER (y = 1) AS n1_{n}, coalesce(sum("{n}") FILTER (y <> 1), 0) AS s0_{n}, count("{n}") FILTER (y <> 1) AS n0_{n}')} FROM x GROUP BY source),
        o AS (SELECT source, {each('(sum(s_{n}) OVER () - s_{n}) / nullif(sum(n_{n}) OVER () - n_{n}, 0) AS m_{n}, (sum(q_{n}) OVER () - q_{n}) / nullif(sum(n_{n}) OVER () - n_{n}, 0) AS r_{n}, nullif(sign((sum(s1_{n}) OVER () - s1_{n}) / nullif(sum(n1_{n}) OVER () - n1_{n}, 0) - (sum(s0_{n}) OVER () - s0_{n}) / nullif(sum(n0_{n}) OVER () - n0_{n}, 0)), 0) AS way_{n}')} FROM own),
        z AS (SELECT x.*, {each('("{n}" - m_{n}) / nullif(sqrt(greatest(r_{n} - m_{n} * m_{n}, 0)), 0) AS z_{n}')}, {each('way_{n}')} FROM x JOIN o USING (source)),
        scored AS (SELECT *, list_aggregate(list_filter([{each('z_{n} * way_{n}')}], lambda v: v IS NOT NULL), 'avg') AS score FROM z),
        rk AS (SELECT source, y, score, rank() OVER (PARTITION BY source ORDER BY score) + (count(*) OVER (PARTITION BY source, score) - 1) / 2e0 AS r FROM scored WHERE y IS NOT NULL AND score IS NOT NULL),
        a AS (
            SELECT source, (sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2e0) / nullif(count(*) FILTER (y = 1) * count(*) FILTER (y <> 1), 0) AS auc,
                coalesce(count(*) FILTER (y = 1 AND score > 0) / nullif(CAST(count(*) FILTER (y = 1) AS DOUBLE), 0), 0) AS sens, coalesce(count(*) FILTER (y <> 1 AND NOT score > 0) / nullif(CAST(count(*) FILTER (y <> 1) AS DOUBLE), 0), 0) AS spec,
                count(*) FILTER (y = 1 AND score > 0) / nullif(CAST(count(*) FILTER (score > 0) AS DOUBLE), 0) AS ppv FROM rk GROUP BY source),
        n AS (SELECT source, count(*) AS rows, count(y) AS labelled FROM x GROUP BY source)
        SELECT doc_id, y, {each('round(z_{n}, 6) AS z_{n}')}, round(score, 6) AS score, score > 0 AS called, source, rows, labelled, round(auc, 6) AS auc, round(sens, 6) AS sens, round(spec, 6) AS spec, round(ppv, 6) AS ppv
        FROM scored JOIN n USING (source) LEFT JOIN a USING (source)"""


@query(audit_sql())
def job2_score_audit(spark, d):
    """Every document's score by signals whose scale and direction come from other sources, and each source's report."""
    from jobs import score_audit

    root = cache.folder(spark)
    for _ in range(2):
        score_audit.score_audit(spark, f"{d}/documents.parquet", f"{d}/labels.parquet", f"{root}/audit")
    return rounded(score_audit.written(spark, f"{root}/audit"))

"""The runnable jobs on copies of the event and text tables: growing input, reruns, odd rows, a run that was cut off."""

from __future__ import annotations

import ast
import datetime as dt
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from jobs import alarm_feed as A
from jobs import score_audit as S
from jobs.common import settings
from pulsegrid.streaming import jobs as streams

DAY = dt.timedelta(days=1)
START = dt.datetime(2024, 3, 1)
EVENT = "event_id long, ts timestamp_ntz, user_id long, value double"


def put(spark, folder, rows, name):
    spark.createDataFrame(rows, EVENT).coalesce(1).write.parquet(f"{folder}/{name}.tmp")
    (part,) = Path(f"{folder}/{name}.tmp").glob("*.parquet")
    Path(f"{folder}/in").mkdir(exist_ok=True)
    part.rename(f"{folder}/in/{name}.parquet")


def expected(rows, threshold=50.0, k=2, m=3, horizon=3 * DAY):
    """Closed windows of all rows, by plain loops."""
    rows = [r for r in rows if r[1] is not None and r[2] is not None]
    watermark = max(r[1] for r in rows) - DAY
    days: dict = {}
    for _, ts, user, value in rows:
        days.setdefault((user, dt.datetime(ts.year, ts.month, ts.day)), []).append(value)
    out, state = [], {}
    for (user, day), values in sorted(days.items()):
        if day + DAY > watermark:
            continue
        known = [v for v in values if v is not None]
        score = sum(known) / len(known) if known else None
        past, start, first, last = state.get(user, ([], None, None, None))
        if last is None or day - last > horizon:
            past, start, first = [], day, None
        past = [*past, int(score is not None and score >= threshold)][-m:]
        alarm = sum(past) >= k
        first = day if alarm and first is None else first
        state[user] = (past, start, first, day)
        out.append((user, day, score, sum(past), alarm, start, first))
    return sorted(out)


def published(spark, target):
    rows = A.published(spark, target).select("patient", *[F.col(c).cast("timestamp_ntz").alias(c) if c != "score" else F.col(c) for c in ("win_start", "score")], "hits", "alarm", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("episode_start", "first_alarm")])
    return sorted(tuple(r) for r in rows.collect())


def month(first, days, users=4):
    return [(1000 * d + u, START + d * DAY + dt.timedelta(hours=3 * u, minutes=d), u, float((37 * d * (u + 1)) % 101)) for d in range(first, first + days) for u in range(users) if (d + u) % 5 or u == 0]


def test_alarm_feed_over_growing_input(spark, tmp_path):
    """Two runs over growing input give what one run over all gives; runs over nothing new change nothing."""
    one, two = month(0, 9), month(9, 8)
    one += [(1, None, 1, 3.0), (2, START, None, 4.0), (3, START + 2 * DAY, 9, None), (4, START + 3 * DAY, 9, 90.0), (5, START + 4 * DAY, 9, 90.0)]
    two += [(6, START + 10 * DAY, 9, 99.0), (7, START + 11 * DAY, 9, 99.0)]  # six days later: a new episode
    put(spark, tmp_path, one, "a")
    source, target, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    store = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    said = A.alarm_feed(spark, source, target, state)
    assert said["read"] == len(one) and published(spark, target) == expected(one)
    assert A.alarm_feed(spark, source, target, state)["read"] == 0 and published(spark, target) == expected(one)
    put(spark, tmp_path, two, "b")
    said = A.alarm_feed(spark, source, target, state)
    assert said["read"] == len(two) and said["windows"] == len(expected(one + two)) > said["alarms"] > 0
    got = published(spark, target)
    assert got == expected(one + two)
    nine = [r for r in got if r[0] == 9]
    assert [r[2] for r in nine] == [None, 90.0, 90.0, 99.0, 99.0][: len(nine)] and nine[0][5] != nine[-1][5]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == store
    assert {p.name for p in (tmp_path / "out").glob("day=*")} == {f"day={r[1]:%Y-%m-%d}" for r in got}


def test_late_events_are_dropped_and_counted(spark, tmp_path):
    put(spark, tmp_path, month(0, 9), "a")
    source, target, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    A.alarm_feed(spark, source, target, state)
    before = published(spark, target)
    put(spark, tmp_path, [(1, START, 0, 1000.0), (2, START + DAY, 77, 1000.0)], "b")
    said = A.alarm_feed(spark, source, target, state)
    assert said["late"] == 2 and published(spark, target) == before


def test_alarm_feed_is_taken_up_again_after_a_stop(spark, tmp_path):
    """A run that dies in its second batch leaves the first batch's windows; the next run ends with the whole result."""
    put(spark, tmp_path, month(0, 9), "a")
    put(spark, tmp_path, month(9, 8), "b")
    source, target, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    slow = tmp_path / "slow.json"
    slow.write_text(json.dumps({"files_per_batch": 1}))
    stream = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", 1).parquet(f"{source[:-1]}[{source[-1]}]")
    boom = F.when(F.col("ts") >= F.lit(START + 10 * DAY), F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("value"))
    w = streams.windowed(stream.select("user_id", F.col("ts").cast("timestamp").alias("ts"), boom.alias("value")).where("user_id IS NOT NULL AND ts IS NOT NULL"))
    with streams.state_store(spark), pytest.raises(Exception, match="lost"):
        out = streams.alarm_episodes(w.select("patient", "win_start", F.col("mean_value").alias("score")), 50.0, 2, 3, 3 * 86400).withColumn("day", F.to_date("win_start"))
        streams.into_files(out, target, state, ["day"])
    A.alarm_feed(spark, source, target, state, str(slow))
    assert published(spark, target) == expected(month(0, 17))


DOC = "doc_id long, text string, lang string, source string, n_chars long"


def audit(spark, folder, docs, labels, config=None):
    spark.createDataFrame(docs, DOC).write.mode("overwrite").parquet(f"{folder}/documents")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{folder}/labels")
    said = S.score_audit(spark, f"{folder}/documents", f"{folder}/labels", f"{folder}/audit", config)
    return said, S.written(spark, f"{folder}/audit")


def test_score_audit_of_odd_rows_and_reruns(spark, tmp_path):
    docs = [(i, "word " * (1 + i % 7), "en", "abc"[i % 3], 1) for i in range(60)]
    docs += [(60, None, None, None, None), (61, "", "en", "a", 0), (62, "lone", "en", "d", 4), (None, "no id", "en", "a", 5)]
    labels = [(i, int(i % 7 > 3), 0) for i in range(50)] + [(7, 1, 0), (None, 1, 1)]
    said, out = audit(spark, tmp_path, docs, labels)
    rows = {r.doc_id: r for r in out.collect()}
    assert said == {"documents": 64, "labelled": 50, "sources": 5} and len(rows) == 64
    assert rows[60].score is None and rows[60].source == "none" and rows[62].auc is None and rows[62].score is not None
    assert rows[7].y == 1 and rows[55].y is None and rows[55].score is not None
    assert {r.source: r.auc > 0.9 for r in rows.values() if r.source in "abc"} == {"a": True, "b": False, "c": True}  # of b, 7 has a label unlike its text
    # no source is judged by itself: other labels of source a leave its own scores alone
    again, flipped = audit(spark, tmp_path, docs, [(d, q if d is None or d % 3 else 1 - q, t) for d, q, t in labels])
    new = {r.doc_id: r for r in flipped.collect()}
    assert all(new[i].score == pytest.approx(rows[i].score) for i in range(0, 60, 3)) and new[0].auc < 0.1
    third = {r.doc_id: r for r in audit(spark, tmp_path, docs, labels)[1].collect()}
    assert {i: (r.score and round(r.score, 9), r.auc, r.called) for i, r in third.items()} == {i: (r.score and round(r.score, 9), r.auc, r.called) for i, r in rows.items()}


def test_score_audit_of_empty_tables(spark, tmp_path):
    said, out = audit(spark, tmp_path, [], [])
    assert said == {"documents": 0, "labelled": 0, "sources": 0}


def test_settings_are_those_beside_the_job_unless_given(spark, tmp_path):
    assert settings(spark, None, A.__file__)["m"] == 3
    (tmp_path / "c.json").write_text('{"m": 5}')
    assert settings(spark, str(tmp_path / "c.json"), A.__file__) == settings(spark, None, A.__file__) | {"m": 5}
    (tmp_path / "d.json").write_text('{"n": 5}')
    with pytest.raises(ValueError, match="unknown settings: n"):
        settings(spark, str(tmp_path / "d.json"), A.__file__)


def test_jobs_import_nothing_of_the_text_operators():
    for p in [*Path(A.__file__).parent.glob("*.py"), Path(__file__)]:
        tree = ast.parse(p.read_text())
        names = [a.name for n in ast.walk(tree) if isinstance(n, ast.Import) for a in n.names] + [n.module or "" for n in ast.walk(tree) if isinstance(n, ast.ImportFrom)]
        assert not [n for n in names if "llm" in n or "corpus_pipeline" in n]

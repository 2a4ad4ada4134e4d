"""The job poller over files that arrive one after another, and against a plain loop."""

import random
from datetime import datetime, timedelta

import duckdb
from pyspark.sql import functions as F

from lithos import catalog
from lithos.streaming import poller

SCHEMA = "document_id long, ts timestamp, event_id long, kind string, message string"
DIR = "/root/testdata/sf0.001"
T0 = datetime(2024, 1, 1)


def arrive(spark, folder, events):
    rows = [(d, T0 + timedelta(minutes=m), i, kind, msg) for d, m, i, kind, msg in events]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def plain(events, limit):
    """events(document, minute, id, kind, message), none of a time more than the limit after the last one."""
    out, jobs = [], {}
    for d, m, i, kind, msg in sorted(events, key=lambda e: (e[0], e[1], e[2])):
        job = jobs.get(d)
        live = job and job[1] not in poller.FINAL
        if live and m > job[2] + limit:
            job[1], live = "error", False
            out.append((d, job[2] + limit, None, job[0], "error", "abgebrochen"))
        if kind == "start":
            if not live:
                job = jobs[d] = [i, "queued", m]
            out.append((d, m, i, job[0], job[1], None))
        elif live:
            job[2] = m
            new = "error" if kind == "missing" else kind
            if new != job[1]:
                job[1] = new
                out.append((d, m, i, job[0], new, "abgebrochen" if kind == "missing" else msg if new == "error" else None))
    return out, jobs


def shown(df):
    return sorted(((r.document_id, (r.ts - T0).total_seconds() / 60, r.event_id, r.job_id, r.status, r.error) for r in df.collect()), key=str)


def test_poller_goes_on_after_a_restart(spark, tmp_path):
    folder, table = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    run = lambda: shown(poller.poll(spark, spark.readStream.schema(SCHEMA).parquet(folder), table, "6 minutes", "1 minute"))
    arrive(spark, folder, [(1, 0, 10, "start", None), (1, 1, 11, "start", None), (2, 0, 20, "start", None), (3, 0, 30, "start", None), (3, 2, 31, "missing", None), (4, 0, 40, "running", None), (None, 0, 50, "start", None)])
    first = run()
    assert first == sorted([(1, 0, 10, 10, "queued", None), (1, 1, 11, 10, "queued", None), (2, 0, 20, 20, "queued", None), (3, 0, 30, 30, "queued", None), (3, 2, 31, 30, "error", "abgebrochen")], key=str)
    arrive(spark, folder, [(1, 3, 12, "running", None), (1, 4, 13, "start", None), (1, 5, 14, "done", None), (3, 5, 32, "start", None), (3, 5.5, 33, "error", "kein Boden")])
    second = run()
    new = [x for x in second if x not in first]
    assert new == sorted([(1, 3, 12, 10, "running", None), (1, 4, 13, 10, "running", None), (1, 5, 14, 10, "done", None), (3, 5, 32, 32, "queued", None), (3, 5.5, 33, 32, "error", "kein Boden")], key=str)
    arrive(spark, folder, [(5, 60, 60, "start", None)])  # time goes on; document 2 has not been seen for the limit
    third = run()
    assert [x for x in third if x not in second] == sorted([(2, 6, None, 20, "error", "abgebrochen"), (5, 60, 60, 60, "queued", None)], key=str)
    arrive(spark, folder, [(2, 61, 21, "start", None)])
    assert [x for x in run() if x not in third] == [(2, 61, 21, 21, "queued", None)]


def test_poller_equals_a_loop(spark, tmp_path):
    rnd = random.Random(4)
    kinds = ["start", "start", "running", "running", "done", "error", "missing"]
    events = [(rnd.choice([1, 1, 1, 2, 3, 4, 5]), rnd.randrange(200), i, rnd.choice(kinds), rnd.choice([None, "x"])) for i in range(400)]
    folder = f"file://{tmp_path}/in"
    arrive(spark, folder, events)
    got = shown(poller.poll(spark, spark.readStream.schema(SCHEMA).parquet(folder), f"file://{tmp_path}/out", "6 minutes", "1 minute"))
    want, jobs = plain(events, 6)
    want += [(d, s + 6, None, j, "error", "abgebrochen") for d, (j, status, s) in jobs.items() if status not in poller.FINAL and s + 6 < max(e[1] for e in events) - 1]
    assert got == sorted(((d, float(m), *rest) for d, m, *rest in want), key=str)


def test_registered_streams(spark):
    """Counts per day equal SQL over the events; the poller equals the loop over the same table."""
    ours = {(r.day, r.status): r.n for r in catalog.QUERIES["job_stream"](spark, DIR).collect()}
    batch = {(r.day, r.status): r.n for r in catalog.QUERIES["job_windows"](spark, DIR).collect()}
    assert ours == batch and ours
    kind = "CASE event_type WHEN 'signup' THEN 'start' WHEN 'view' THEN 'running' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'done' ELSE 'missing' END"
    rows = duckdb.sql(f"SELECT user_id, epoch_us(ts::TIMESTAMP), event_id, {kind}, NULL FROM '{DIR}/events.parquet' WHERE user_id IS NOT NULL AND ts IS NOT NULL").fetchall()
    limit, late = 10 * 86400 * 10**6, 86400 * 10**6
    want, jobs = plain(rows, limit)
    want += [(d, s + limit, None, j, "error", "abgebrochen") for d, (j, status, s) in jobs.items() if status not in poller.FINAL and s + limit < max(r[1] for r in rows) - late]
    got = [tuple(r) for r in catalog.QUERIES["job_poller"](spark, DIR).select("document_id", F.unix_micros("ts"), "event_id", "job_id", "status", "error").collect()]
    near = lambda rows: sorted(((d, m // 1000, *rest) for d, m, *rest in rows), key=str)
    assert near(got) == near(want) and len(got) > 50

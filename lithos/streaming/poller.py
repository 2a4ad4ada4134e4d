"""The state of a document's job, kept by a stream: repeated starts, states as they are seen, jobs that are seen no more."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lithos.session import ship_package

FINAL = ("done", "error")
ABORTED = "abgebrochen"
OUTPUT = "document_id long, ts timestamp, event_id long, job_id long, status string, error string"
STATE = "job_id long, status string, seen long"


def _milliseconds(ts: pd.Timestamp) -> int:
    return ts.value // 1_000_000


def follow(limit_ms: int):
    """The state function: a row for each start and each change of state.

    A start gives its event's id as the job, or the id of the job that is still open, which it does not change. A state
    belongs to the open job; without one it is left out. 'missing' (the job is not known any more) and no sign of an open job for
    the limit both end it as an error. Events of a batch count in order of time, then event id; those of one document in
    one batch are held together, which the trigger bounds.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (document,) = key
        job, status, seen = state.get if state.exists else (None, None, None)
        out = []
        if state.hasTimedOut:
            status = "error"
            out.append((document, pd.Timestamp(seen + limit_ms, unit="ms"), None, job, status, ABORTED))
        else:
            events = pd.concat(list(frames)).sort_values(["ts", "event_id"], kind="stable")
            for e in events.itertuples(index=False):
                at = _milliseconds(e.ts)
                open_ = job is not None and status not in FINAL
                if open_ and at > seen + limit_ms:
                    status, open_ = "error", False
                    out.append((document, pd.Timestamp(seen + limit_ms, unit="ms"), None, job, status, ABORTED))
                if e.kind == "start":
                    if not open_:
                        job, status, seen = int(e.event_id), "queued", at
                    out.append((document, e.ts, int(e.event_id), job, status, None))
                elif open_:
                    seen = max(seen, at)
                    new = "error" if e.kind == "missing" else e.kind
                    if new != status:
                        status = new
                        error = (ABORTED if e.kind == "missing" else e.message) if new == "error" else None
                        out.append((document, e.ts, int(e.event_id), job, status, error))
        if job is not None:
            state.update((job, status, seen))
            if status not in FINAL:
                state.setTimeoutTimestamp(max(seen + limit_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["document_id", "ts", "event_id", "job_id", "status", "error"]).astype({"event_id": "Int64"})

    return step


def followed(events: DataFrame, limit: str = "6 minutes", late: str = "1 minute") -> DataFrame:
    """A stream of events(document_id, ts, event_id, kind, message) -> its job states; kinds are start, queued, running,
    done, error and missing. Rows without a document, time or kind are left out. State is a few values per document."""
    limit_ms = int(pd.Timedelta(limit).total_seconds() * 1000)
    rows = events.where("document_id IS NOT NULL AND ts IS NOT NULL AND kind IS NOT NULL").withWatermark("ts", late)
    return rows.groupBy("document_id").applyInPandasWithState(follow(limit_ms), OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def drained(stream: DataFrame, table: str, mode: str = "append") -> None:
    """Run a stream over all that is there, into folders batch=<n> of a table; a batch that is run again, after a failure,
    replaces its folder. State and progress lie below the table, so the next call goes on from there."""
    write = lambda rows, n: rows.write.mode("overwrite").parquet(f"{table}/batch={n}")
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{table}/_state").foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()


def poll(spark: SparkSession, events: DataFrame, table: str, limit: str = "6 minutes", late: str = "1 minute") -> DataFrame:
    """All states so far, after the events that came since the last call."""
    ship_package(spark)
    drained(followed(events, limit, late), table)
    return spark.read.schema(OUTPUT + ", batch long").parquet(table).drop("batch")

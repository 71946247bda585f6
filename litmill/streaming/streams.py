"""Streaming forms: novelty of arriving records, status counts in event time, and the task state machine."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from litmill.functions.text import normalize_title


def status_counts(events: DataFrame, ts: str, status: str, late: str = "1 day", window: str = "1 day") -> DataFrame:
    """(window_start, status, n) of a stream of events; what is later than `late` is left out."""
    e = events.withColumn("at", F.col(ts).cast("timestamp"))
    return e.withWatermark("at", late).groupBy(F.window("at", window).alias("w"), status).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), status, "n")


def sessions(events: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    e = events.withColumn("at", F.col(ts).cast("timestamp")).withWatermark("at", late)
    return e.groupBy(F.session_window("at", gap).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("session_start"), key, "n")


def new_titles(records: DataFrame, library: DataFrame) -> DataFrame:
    """Arriving records whose normalised title the library (a table) lacks."""
    known = library.select(normalize_title(F.col("title")).alias("k")).where("k <> ''").distinct()
    r = records.withColumn("key", normalize_title(F.col("title")))
    return r.join(known, r.key == known.k, "left").where("k is null").drop("k", "key")


TASK_STATE = "task_id long, status string, changes int"


def task_states(events: DataFrame, key: str = "user_id", status: str = "status", order: str = "event_id") -> DataFrame:
    """(task_id, status, changes): the state of each task after every batch of its events.

    A terminal state holds against later non-terminal events, except for a retry, which is pending.
    """

    def step(k: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, changes = state.get if state.exists else ("", 0)
        rows = pd.concat(list(pdfs))
        for s in rows.sort_values(order)[status]:
            if s != now and not (now in ("completed", "failed", "cancelled") and s == "running"):
                now, changes = s, changes + 1
        state.update((now, changes))
        yield pd.DataFrame({"task_id": [k[0]], "status": [now], "changes": [changes]})

    return events.groupBy(key).applyInPandasWithState(step, TASK_STATE, "status string, changes int", "update", GroupStateTimeout.NoTimeout)


def run_to_end(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Everything available, once, into a table in memory: for tests and small results."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)

"""Streams of file events: merged per path, debounced, applied in micro-batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from codeloom.operators.changes import MERGE

EVENT_SCHEMA = "path string, change string, ts timestamp, seq long"


def read_events(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Events from a folder of Parquet files, a bounded number of files per micro-batch."""
    return spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def fold(pending: str | None, incoming: str) -> str:
    return incoming if pending is None else MERGE.get((pending, incoming), incoming)


def _until(state: GroupState, last: pd.Timestamp, quiet_ms: int) -> None:
    """State goes once the watermark has passed a key's last event by ``quiet_ms``; a time that has passed already is moved just ahead of it."""
    state.setTimeoutTimestamp(max(int(last.timestamp() * 1000) + quiet_ms, state.getCurrentWatermarkMs() + 1))


def merged(events: DataFrame, late: str = "10 minutes", quiet: float = 3600) -> DataFrame:
    """After each micro-batch the merged kind of every path it touched.

    State per path is one letter, one count and one time; it ends when the watermark has passed the path's last event by ``quiet`` seconds, as its changes have been applied long since, and the
    next event starts afresh. So state is bounded by the paths that change within that time.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now, n, last = state.get if state.exists else (None, 0, None)
        rows = pd.concat(list(batches)).sort_values(["ts", "seq"])
        for change in rows["change"]:
            now, n = fold(now, change), n + 1
        newest = rows["ts"].iloc[-1]
        last = newest if last is None else max(newest, pd.Timestamp(last))
        state.update((now, n, last.to_pydatetime()))
        _until(state, last, int(quiet * 1000))
        yield pd.DataFrame({"path": [key[0]], "change": [now], "events": [n]})

    return events.withWatermark("ts", late).groupBy("path").applyInPandasWithState(step, "path string, change string, events long", "change string, events long, last timestamp", "update", GroupStateTimeout.EventTimeTimeout)


def debounced(events: DataFrame, seconds: float = 1, late: str = "10 minutes") -> DataFrame:
    """The events that come more than ``seconds`` after the path's event before, as :func:`codeloom.operators.changes.debounce` keeps them; the first of each burst stays.

    State per path is the time of its last event; it ends once the watermark has passed that by ``seconds``, as no event can then fall into the burst. Events within a micro-batch are taken in their order;
    one that comes after later ones of its path counts from the latest.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = pd.Timestamp(state.get[0]) if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["ts", "seq"])
        keep = []
        for ts in rows["ts"]:
            keep.append(last is None or (ts - last).total_seconds() > seconds)
            last = ts if last is None else max(last, ts)
        state.update((last.to_pydatetime(),))
        _until(state, last, int(seconds * 1000) + 1)
        yield rows.loc[keep, ["path", "change", "ts", "seq"]]

    return events.withWatermark("ts", late).groupBy("path").applyInPandasWithState(step, EVENT_SCHEMA, "last timestamp", "append", GroupStateTimeout.EventTimeTimeout)


def windowed_counts(events: DataFrame, size: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events by kind and tumbling window, late ones up to the watermark included."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "change").count().select(F.col("window.start").alias("start"), "change", F.col("count").alias("n"))


def sessions(calls: DataFrame, key: str, ts: str, gap: str = "10 seconds", late: str = "10 minutes") -> DataFrame:
    """I10 without its closing rule: calls by session windows that end after a gap."""
    return calls.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).count().select(key, F.col("session_window.start").alias("started"), F.col("count").alias("calls"))


def run(df: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update"):
    """Drains what there is and applies it batch by batch; a batch that is run again must have the same effect."""
    query = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(apply).start()
    query.awaitTermination()
    return query

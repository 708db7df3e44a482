"""Live queries as Structured Streaming.

A log table that grows (files or any source) is read as a stream; each
micro-batch brings the committed state up to date, evaluates the watched query
and appends a row to the results when its condition or its hash says so.
Offsets and results live in checkpointed folders, so a durable watcher misses
and repeats nothing across restarts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def watch(changes: DataFrame, query: Callable[[DataFrame], DataFrame], key: str, results: str, checkpoint: str, on_change: bool = True, once: bool = True) -> StreamingQuery:
    """Watch ``query`` over the rows of ``changes`` seen so far.

    ``query`` maps a batch of new rows to (``key``, value) rows. Each batch adds to
    ``results`` the keys whose value differs from the last one written
    (``on_change``) or all that are not empty (condition mode), as the partition
    ``epoch``, which a batch that is run again replaces. The last values are kept
    beside the checkpoint, so a batch reads a row for each key and not all results.
    """

    def step(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        new = query(batch).select(key, F.col("value").cast("string").alias("value"))
        if on_change:
            try:
                last = spark.read.schema(new.schema).parquet(f"{checkpoint}/last-values/epoch={epoch - 1}")
            except AnalysisException as e:
                if e.getCondition() != "PATH_NOT_FOUND":
                    raise
                last = new.limit(0)
            last.join(new.select(key), key, "left_anti").union(new).write.mode("overwrite").parquet(f"{checkpoint}/last-values/epoch={epoch}")
            new = new.join(last.withColumnRenamed("value", "was"), key, "left").filter(~F.col("value").eqNullSafe(F.col("was"))).drop("was")
        new.write.mode("overwrite").parquet(f"{results}/epoch={epoch}")

    writer = changes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def exactly_once(changes: DataFrame, key: str, time: str, late: str) -> DataFrame:
    """Retries of the same key within ``late`` are dropped."""
    return changes.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def tumbling(changes: DataFrame, time: str, width: str, late: str, *by: str) -> DataFrame:
    """Counts by window, late rows within the watermark included."""
    return changes.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *by, "n")


def wills(events: DataFrame, ttl_ms: int) -> DataFrame:
    """(session, fired_at): sessions that send no heartbeat for ``ttl_ms`` of event
    time and didn't close. ``events``: session, ts (timestamp), kind ('arm',
    'beat' or 'close'). State is one deadline a session."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (deadline,) = state.get
            state.remove()
            yield pd.DataFrame({"session": [key[0]], "fired_at": [pd.Timestamp(deadline, unit="ms")]})
            return
        rows = pd.concat(list(batches)).sort_values("ts")
        deadline = state.get[0] if state.exists else None
        for ts, kind in zip(rows["ts"], rows["kind"], strict=True):
            at = int(ts.timestamp() * 1000)
            if kind == "close":
                deadline = None
            elif kind == "arm" or deadline is not None:
                deadline = max(deadline or 0, at + ttl_ms)
        if deadline is None:
            if state.exists:
                state.remove()
        else:
            state.update((deadline,))
            state.setTimeoutTimestamp(max(deadline, state.getCurrentWatermarkMs() + 1))

    return events.withWatermark("ts", "0 seconds").groupBy("session").applyInPandasWithState(run, "session string, fired_at timestamp", "deadline long", "append", GroupStateTimeout.EventTimeTimeout)

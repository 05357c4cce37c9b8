"""Streams of events: progress, windows, sessions, repeats."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

PROGRESS = "ts timestamp, event string, chunk_id string, batch long, data string"


def progress(spark: SparkSession, folder: str) -> DataFrame:
    """The progress log, a folder of JSON lines, as a stream."""
    return spark.readStream.schema(PROGRESS).json(folder)


def watch(log: DataFrame, name: str, seconds: int = 2) -> StreamingQuery:
    """Counts by event in a memory table, renewed every ``seconds``."""
    counts = log.groupBy("event").agg(F.count("*").alias("n"))
    return counts.writeStream.outputMode("complete").format("memory").queryName(name).trigger(processingTime=f"{seconds} seconds").start()


def _marked(events: DataFrame, late: str) -> DataFrame:
    """Watermarks need an instant; times without zone are taken in the session's zone."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def tumbling(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total) by window; the same for a table and for a stream."""
    if events.isStreaming:
        events = _marked(events, late)
    out = events.groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, length: str = "2 hours", step: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    if events.isStreaming:
        events = _marked(events, late)
    return events.groupBy(F.window("ts", length, step)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, start, end, n) of runs of events with no pause of ``gap``."""
    if events.isStreaming:
        events = _marked(events, late)
    out = events.groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def without_repeats(events: DataFrame, key: str = "event_id", late: str = "10 minutes") -> DataFrame:
    if events.isStreaming:
        return _marked(events, late).dropDuplicatesWithinWatermark([key])
    return events.dropDuplicates([key])


def upsert_results(results: DataFrame, path: str, log: str) -> StreamingQuery:
    """Append a stream of results (chunk_id, status, processed_at) to a table, a folder for each batch: the session's checkpoint.

    A batch that is run again replaces its own folder, so that a lost driver or
    executor leaves no result twice; ``sessions.latest`` reads one row per chunk.
    """

    def save(batch: DataFrame, no: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={no}")

    return results.writeStream.foreachBatch(save).option("checkpointLocation", log).trigger(availableNow=True).start()


def failure_runs(attempts: DataFrame, most: int = 2) -> DataFrame:
    """(user_id, run, ts): a row whenever a key's failures in a row reach ``most`` or more, kept as state per key.

    ``attempts``: user_id, ts, failed. A success ends the run. Attempts of one batch are taken in order of time.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = state.get[0] if state.exists else 0
        # Nine bytes an attempt are held to put them in order, no frames.
        parts = [(b["ts"].to_numpy("datetime64[us]"), b["failed"].to_numpy(bool)) for b in batches]
        ts, failed = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        order = np.argsort(ts, kind="stable")
        ts, failed = ts[order], failed[order]
        at = np.arange(1, len(ts) + 1)
        ended = np.maximum.accumulate(np.where(failed, 0, at))  # place of the last success so far
        run = np.where(failed, at - ended + np.where(ended == 0, before, 0), 0)
        state.update((int(run[-1]) if len(run) else before,))
        long = run >= most
        yield pd.DataFrame({"user_id": np.full(long.sum(), key[0], np.int64), "run": run[long].astype(np.int64), "ts": ts[long]})

    zoned = attempts.withColumn("ts", F.col("ts").cast("timestamp"))
    return zoned.groupBy("user_id").applyInPandasWithState(step, "user_id long, run long, ts timestamp", "run long", "append", GroupStateTimeout.NoTimeout)

"""Manifests of content hashes and what follows from their difference."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from hashlib import sha256

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusloom.plans.staging import file_system


def manifest(files: DataFrame) -> DataFrame:
    """(file_path, hash, size)."""
    return files.select(F.col("path").alias("file_path"), F.sha2(F.col("text"), 256).alias("hash"), F.length("text").cast("long").alias("size"))


def load_manifest(spark: SparkSession, path: str) -> DataFrame | None:
    """A saved manifest; none if it is missing or can't be read as one."""
    fs, jpath = file_system(spark, path)
    if not fs.exists(jpath):
        return None
    try:
        found = spark.read.parquet(path)
    except (PySparkException, Py4JJavaError):
        return None
    return found if {"file_path", "hash"} <= set(found.columns) else None


def diff(before: DataFrame, now: DataFrame) -> DataFrame:
    """(file_path, change) with change added, deleted or changed."""
    a, b = before.select("file_path", F.col("hash").alias("h0")), now.select("file_path", F.col("hash").alias("h1"))
    change = F.when(F.col("h0").isNull(), "added").when(F.col("h1").isNull(), "deleted").when(F.col("h0") != F.col("h1"), "changed")
    return a.join(b, "file_path", "full_outer").select("file_path", change.alias("change")).where("change is not null")


def affected_chunks(chunk_map: DataFrame, delta: DataFrame) -> DataFrame:
    """Chunks of changed or deleted files, each once."""
    stale = delta.where("change <> 'added'")
    return chunk_map.join(stale, chunk_map.path == stale.file_path, "left_semi").select("chunk_id").distinct()


def to_analyse(files: DataFrame, delta: DataFrame) -> DataFrame:
    """Files that are new or changed."""
    fresh = delta.where("change <> 'deleted'")
    return files.join(fresh, files.path == fresh.file_path, "left_semi")


def chunks_for_file(chunk_map: DataFrame, path: str) -> DataFrame:
    """The chunks of one file, in order."""
    return chunk_map.where(F.col("path") == path).orderBy("start")


class _Fresh(StatefulProcessor):
    """The hash of a file's last text; a row goes on if its text has another."""

    def init(self, handle) -> None:
        self.last = handle.getValueState("last", "hash string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 - Spark's names
        known = self.last.get()[0] if self.last.exists() else None
        newest = None
        for pdf in rows:
            newest = pdf.tail(1)
        text = newest["text"].iat[0]
        now = "" if text is None else sha256(text.encode()).hexdigest()
        if now != known:
            self.last.update((now,))
            yield newest
        else:
            yield newest.head(0)

    def close(self) -> None:
        pass


@contextmanager
def _rocks(spark: SparkSession) -> Iterator[None]:
    """Streams that are started inside keep their state in RocksDB, which states by key need; the session's setting returns after."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def watch_files(spark: SparkSession, folder: str, schema: str, manifest_path: str, name: str) -> StreamingQuery:
    """Follow a folder of Parquet tables of files (path, text, ...): each batch's new or changed files go to the table ``name``'s folder beside the manifest.

    What a file's last text was is state, a hash for each path; the manifest is appended to and never read again. A
    repeated batch replaces its own folders. Of several rows of a path in a batch one counts.
    """

    def step(batch: DataFrame, no: int) -> None:
        batch = batch.persist()
        batch.write.mode("overwrite").parquet(f"{manifest_path}-{name}/batch={no}")
        manifest(batch).write.mode("overwrite").parquet(f"{manifest_path}/batch={no}")
        batch.unpersist()

    with _rocks(spark):
        rows = spark.readStream.schema(schema).parquet(folder)
        fresh = rows.groupBy("path").transformWithStateInPandas(_Fresh(), rows.schema, "Append", "None")
        return fresh.writeStream.foreachBatch(step).trigger(availableNow=True).option("checkpointLocation", f"{manifest_path}-{name}-log").start()


#: A listing of a tree: every file there was at a time, with what tells whether it has changed.
LISTING = "file_path string, hash string, listed timestamp"
#: State by key needs this store.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The changes of a file, whose last hash and time are state; the state runs out if a later listing lacks the file. Times are microseconds."""
    if state.hasTimedOut:
        state.remove()
        yield pd.DataFrame({"file_path": [key[0]], "change": ["deleted"], "at": [state.getCurrentWatermarkMs() * 1000]})
        return
    held = state.get if state.exists else None
    rows = sorted((at, h) for pdf in batches for at, h in zip(pdf["at"].tolist(), pdf["hash"].tolist()))
    out = []
    for at, h in rows:
        if held and at < held[1]:
            continue  # a listing older than what is known
        change = "added" if held is None else "changed" if held[0] != h else None
        if change:
            out.append((key[0], change, at))
        held = (h, at)
    state.update(held)
    state.setTimeoutTimestamp(held[1] // 1000 + 1)
    if out:
        yield pd.DataFrame(out, columns=["file_path", "change", "at"])


def listing(files: DataFrame, at: str) -> DataFrame:
    """A listing (file_path, hash, listed) of ``files`` (path, text) at a time."""
    return manifest(files).select("file_path", "hash", F.lit(at).cast("timestamp").alias("listed"))


def changes(listings: DataFrame) -> DataFrame:
    """(file_path, change, listed) of a stream of listings: what is added or changed when it is listed, what is deleted once a later listing lacks it.

    State is a hash and a time per file, which go to Python and back in batches of files, not in calls for each; no manifest is read
    again, and what hasn't changed gives no row. A file's timer stands just after its last listing; the watermark follows the latest listing, so that the timers of
    all files that it has were moved on before, and those of missing files go off. A listing must come whole in one batch.
    """
    marked = listings.withWatermark("listed", "0 seconds").select("file_path", "hash", "listed", F.unix_micros("listed").alias("at"))
    found = marked.groupBy("file_path").applyInPandasWithState(_follow, "file_path string, change string, at long", "hash string, at long", "append", GroupStateTimeout.EventTimeTimeout)
    return found.select("file_path", "change", F.timestamp_micros("at").alias("listed"))


def watch_listings(spark: SparkSession, folder: str, out: str, log: str) -> StreamingQuery:
    """Follow a folder of listings: the changes of each batch go to a folder below ``out``, which a repeated batch replaces."""

    def save(batch: DataFrame, no: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={no}")

    with _rocks(spark):
        found = changes(spark.readStream.schema(LISTING).parquet(folder))
        return found.writeStream.foreachBatch(save).trigger(availableNow=True).option("checkpointLocation", log).start()

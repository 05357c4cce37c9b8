"""The map step as a stream of batches: each is written once, watched, and followed by events.

Numbered chunks wait in a queue, a folder for every batch, in files of ``FILE_CHUNKS``, so that a large batch is work for many tasks.
A stream takes one batch's number at a time; what a batch
gives is written to a folder of its own before the next begins, so that an end at any time costs the running batch only, and
one that is run again replaces its own folder. What is left to do follows from the results, not from the stream's log.

A batch of which more than half fails twice in a row turns the rest to one chunk after another (``coalesce(1)``), where
what they call can't take more.

Events (``streaming.events.PROGRESS``) are rows in the progress log: batch_start, chunk_complete,
finding and escalation per chunk, batch_end with the counts that an observation took while the batch ran.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusloom.functions.text import failure_type
from corpusloom.sources.files import emit
from corpusloom.streaming.events import PROGRESS

#: Results (chunk_id, status, findings, ...) of chunks (chunk_id, content, attempt, ...).
Analyser = Callable[[DataFrame], DataFrame]
#: However many chunks there are, they go in so many batches at the most.
MOST_BATCHES = 100
#: Chunks that one file of the queue holds at the most.
FILE_CHUNKS = 1000


def batch_size(chunks: int, wanted: int, most: int = MOST_BATCHES) -> int:
    return max(wanted, -(-chunks // most))


def with_failure(results: DataFrame) -> DataFrame:
    """``results`` with the kind of each failure, from ``error`` if there is such a column."""
    if "failure" in results.columns:
        return results
    said = failure_type(F.coalesce("error", F.lit(""))) if "error" in results.columns else F.lit("unknown")
    return results.withColumn("failure", F.when(F.col("status") == "failed", said))


def event(kind: str | Column, batch: int, chunk: Column | None = None, data: Column | None = None) -> list[Column]:
    null = F.lit(None).cast("string")
    columns = (F.current_timestamp(), F.lit(kind), null if chunk is None else chunk, F.lit(batch).cast("long"), null if data is None else data)
    return [c.alias(n.split()[0]) for c, n in zip(columns, PROGRESS.split(", "))]


@dataclass
class BatchRun:
    """One pass over a queue, whose folders of chunks have the columns ``schema``. ``done`` has the number, the failures and the way of every batch that was written."""

    spark: SparkSession
    results: str
    progress: str
    run: str
    attempt: int
    analyser: Analyser
    stronger: Analyser | None
    queue: str
    schema: StructType
    done: list[dict] = field(default_factory=list)

    def sequential(self) -> bool:
        """Whether two batches in a row had over half their chunks failed; once so, it stays."""
        return any(a["rate"] > 0.5 and b["rate"] > 0.5 for a, b in zip(self.done, self.done[1:]))

    def step(self, numbers: DataFrame, no: int) -> None:
        spark, one_by_one = numbers.sparkSession, self.sequential()
        one = spark.range(0, 1, 1, 1)
        emit(one.select(*event("batch_start", no)), self.progress)
        rows = waiting(spark, self.queue, self.schema, no + 1)
        rows = rows.coalesce(1) if one_by_one else rows
        weak, strong = rows.where("tier is null").drop("tier"), rows.where("tier is not null").drop("tier")
        out = self.analyser(weak).withColumn("tier", F.lit(None).cast("string"))
        if self.stronger is not None:
            out = out.unionByName(self.stronger(strong).withColumn("tier", F.lit("stronger")), allowMissingColumns=True)
        out = with_failure(out).withColumns({"attempt": F.lit(self.attempt), "processed_at": F.current_timestamp()})
        seen = Observation()
        counts = [F.count("*").alias("n"), F.count_if(F.col("status") == "failed").alias("failed"), F.coalesce(F.sum(F.size("findings")), F.lit(0)).alias("findings")]
        folder = f"{self.results}/run={self.run}-{no}"
        out.observe(seen, *counts).write.mode("overwrite").parquet(folder)
        told = seen.get | {"sequential": one_by_one}
        told["rate"] = round(told["failed"] / told["n"], 4) if told["n"] else 0.0
        self.done.append(told)
        made = spark.read.schema(out.schema).parquet(folder)
        tell = lambda kind, data: F.struct(F.lit(kind).alias("event"), data.alias("data"))
        found = F.transform(F.coalesce("findings", F.array()), lambda f: tell("finding", F.to_json(f)))
        raised = F.when(F.col("tier").isNotNull(), F.array(tell("escalation", F.to_json(F.struct("tier", "attempt")))))
        lines = F.concat(F.array(tell("chunk_complete", F.to_json(F.struct("status", "failure", "attempt")))), found, F.coalesce(raised, F.slice(found, 1, 0)))
        events = made.select(F.col("chunk_id").cast("string").alias("chunk_id"), F.explode(lines).alias("e")).select(*event(F.col("e.event"), no, F.col("chunk_id"), F.col("e.data")))
        emit(events.unionByName(one.select(*event("batch_end", no, data=F.lit(json.dumps(told))))), self.progress)


def write_queue(chunks: DataFrame, batches: int, path: str) -> None:
    """Chunks with their ``batch`` from 1: a folder for every batch, and a file with its number."""
    chunks.repartition("batch").write.option("maxRecordsPerFile", FILE_CHUNKS).partitionBy("batch").parquet(f"{path}/chunks")
    chunks.sparkSession.range(1, batches + 1, 1, batches).select(F.col("id").alias("batch")).write.parquet(f"{path}/numbers")


def waiting(spark: SparkSession, queue: str, schema: StructType, batch: int) -> DataFrame:
    """The chunks of one batch of a queue."""
    held = StructType([f for f in schema if f.name != "batch"])
    return spark.read.schema(held).parquet(f"{queue}/chunks/batch={batch}").withColumn("batch", F.lit(batch).cast("long")).select(*schema.names)


def run_queue(log: str, name: str, run: BatchRun) -> None:
    """Take a run's batches in order until all are written or the stream named ``name`` is stopped; each file of a number is a turn of the stream."""
    numbers = run.spark.readStream.schema("batch long").option("maxFilesPerTrigger", 1).parquet(f"{run.queue}/numbers")
    stream = numbers.writeStream.queryName(name).foreachBatch(run.step).option("checkpointLocation", log).trigger(availableNow=True).start()
    stream.awaitTermination()


def stop(spark: SparkSession, name: str) -> None:
    """End the stream of that name, whoever began it; its running batch's jobs are cancelled."""
    for stream in spark.streams.active:
        if stream.name == name:
            stream.stop()

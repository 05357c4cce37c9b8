"""Sessions as tables: results by chunk, progress, batches, budgets, clean-up."""

from __future__ import annotations

import json
import re
import secrets
import time
import uuid
import warnings
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import asdict

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.errors import CorpusError
from corpusloom.model import MOST_CHUNKS, PHASES, SCAN_MODES, WARN_CHUNKS, Config
from corpusloom.operators.analyse import numbered_batches, run_map
from corpusloom.operators.chunking import chunk_adaptive, chunk_fixed
from corpusloom.operators.incremental import diff, load_manifest, manifest
from corpusloom.operators.mapping import Analyser, BatchRun, batch_size, run_queue, stop, write_queue
from corpusloom.plans.reduce import Reduced, aggregate_findings
from corpusloom.plans.running import running_sum
from corpusloom.plans.staging import file_system, stage
from corpusloom.sources.files import export_results, rotate, scan_targeted, with_text

NAME = re.compile(r"[A-Za-z0-9_-]+")
LOG = "session_id string, query string, phase string, config string, final_answer string, at timestamp"
NOTES = "note string, at timestamp"


def new_session_id(prefix: str = "session") -> str:
    return f"{prefix}-{time.strftime('%Y%m%d-%H%M%S')}-{secrets.token_hex(8)}"


def latest(results: DataFrame, key: str = "chunk_id", order: tuple[str, ...] = ("processed_at",)) -> DataFrame:
    """One result per chunk: a later one replaces an earlier one. Aggregated map-side, so that no chunk's history is gathered."""
    rest = [c for c in results.columns if c != key]
    last = F.max_by(F.struct(*rest), F.struct(*order))
    return results.groupBy(key).agg(last.alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in rest])


def pending(chunks: DataFrame, results: DataFrame) -> DataFrame:
    """Chunks without a result other than a placeholder."""
    done = results.where(~F.col("status").isin("placeholder", "pending")).select("chunk_id").distinct()
    return chunks.join(done, "chunk_id", "left_anti")


def restored(chunks: DataFrame, checkpoint: DataFrame) -> DataFrame:
    """Chunks with the status a checkpoint has for them."""
    known = checkpoint.select("chunk_id", F.col("status").alias("__s"))
    return chunks.join(known, "chunk_id", "left").withColumn("status", F.coalesce("__s", F.lit("pending"))).drop("__s")


def status(chunks: DataFrame, results: DataFrame) -> DataFrame:
    """(total, processed, failed, percent)."""
    joined = chunks.select("chunk_id").join(results.select("chunk_id", "status"), "chunk_id", "left")
    done = F.count_if(F.col("status") == "success")
    return joined.agg(F.count("*").alias("total"), done.alias("processed"), F.count_if(F.col("status") == "failed").alias("failed"), F.round(100.0 * done / F.count("*"), 2).alias("percent"))


def batches(attempts: DataFrame, size: int = 5) -> DataFrame:
    """(batch, n, succeeded, placeholders, failed, rate): attempts in turn (``no`` from 1, ``status``), ``size`` to a batch; ``rate`` is that of failures."""
    batch = F.floor((F.col("no") - 1) / size) + 1
    of = lambda *kinds: F.count_if(F.col("status").isin(*kinds))
    counts = [of("success").alias("succeeded"), of("placeholder", "pending").alias("placeholders"), of("failed").alias("failed")]
    return attempts.groupBy(batch.alias("batch")).agg(F.count("*").alias("n"), *counts, F.round(of("failed") / F.count("*"), 4).alias("rate"))


def fall_back(batch_rates: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Batches that follow two in a row with over half failed; from there on work is sequential.

    Batches are numbered without gaps: each gives its state to the two after it, so
    that no series is gathered in one task.
    """
    keys = keys or []
    rest = [c for c in batch_rates.columns if c not in (*keys, "batch")]
    ahead = batch_rates.withColumn("__k", F.explode(F.array(*map(F.lit, (0, 1, 2)))))
    bad = lambda k: F.coalesce(F.bool_or((F.col("__k") == k) & (F.col("rate") > 0.5)), F.lit(False))
    own = F.max(F.when(F.col("__k") == 0, F.struct(*rest))).alias("__own")
    out = ahead.groupBy(*keys, (F.col("batch") + F.col("__k")).alias("batch")).agg(own, (bad(1) & bad(2)).alias("fall_back"))
    return out.where("__own is not null").select(*keys, "batch", *[F.col(f"__own.{c}").alias(c) for c in rest], "fall_back")


def should_escalate(failure: Column, attempt: Column) -> Column:
    return failure.isin("quality_low", "complexity") & (attempt >= 2)


def within_budget(wanted: DataFrame, total: int, ratio: float = 0.15, cost: float = 5.0, each: float = 0.01) -> DataFrame:
    """The first escalations (by ``no``) that the ratio and the cost cap allow; both caps bound a count, so this is a top-k."""
    most = min(int(ratio * total), int(cost / each + 1e-9))
    return wanted.orderBy("no").limit(most)


def escalate(failures: DataFrame, total: int, **caps: float) -> DataFrame:
    """``failures`` (no, failure, attempt, ...) that go to the stronger analyser, within the budget, with ``tier``."""
    wanted = failures.where(should_escalate(F.col("failure"), F.col("attempt")))
    return within_budget(wanted, total, **caps).withColumn("tier", F.lit("stronger"))


def to_delete(sessions: DataFrame, now: Column, days: int = 7, most_bytes: int = 1 << 30) -> DataFrame:
    """(session_id, size, reason): too old, then the least recent beyond ``most_bytes``."""
    rows = sessions.select("session_id", "size", "mtime")
    old = F.col("mtime") < now - F.expr(f"interval {days} days")
    young = running_sum(rows.where(~old), F.col("size"), [F.desc("mtime"), F.col("session_id")], "kept").where(F.col("kept") > most_bytes)
    return rows.where(old).select("session_id", "size", F.lit("age").alias("reason")).unionByName(young.select("session_id", "size", F.lit("space").alias("reason")))


class Session:
    """A session's tables below one folder: phases, files, chunks, results, notes. Each change is an appended file."""

    def __init__(self, spark: SparkSession, root: str, session_id: str):
        if not NAME.fullmatch(session_id):
            raise CorpusError("session_name", "letters, digits, - and _ only", what="session_id")
        self.spark, self.root, self.path, self.session_id = spark, root, f"{root.rstrip('/')}/{session_id}", session_id

    @classmethod
    def init(cls, spark: SparkSession, root: str, query: str, config: Config | None = None, session_id: str | None = None, force: bool = False) -> Session:
        """A new session; refuses to reuse an id unless forced."""
        if not query:
            raise CorpusError("query", "a session needs a query", what="query")
        config = config or Config()
        if config.scan_mode not in SCAN_MODES:
            raise CorpusError("setting", f"{config.scan_mode} is no way to scan", what="scan_mode")
        s = cls(spark, root, session_id or new_session_id())
        if s.exists() and not force:
            raise CorpusError("session_exists", "the session exists; force replaces it", what=s.session_id)
        s._drop("")
        row = (s.session_id, query, PHASES[0], json.dumps(asdict(config)), None, None)
        spark.createDataFrame([row], LOG).withColumn("at", F.current_timestamp()).write.mode("overwrite").parquet(f"{s.path}/log")
        return s

    @classmethod
    def resume(cls, spark: SparkSession, root: str, session_id: str | None = None) -> Session:
        """The named session, or the one last changed."""
        if session_id is None:
            newest = cls.every(spark, root).orderBy(F.desc("at"), "session_id").first()
            if newest is None:
                raise CorpusError("no_session", "there is no session to resume", what=root)
            session_id = newest["session_id"]
        s = cls(spark, root, session_id)
        if not s.exists():
            raise CorpusError("no_session", "no such session", what=session_id)
        return s

    @classmethod
    def every(cls, spark: SparkSession, root: str) -> DataFrame:
        """(session_id, query, phase, final_answer, at): the last state of every session below ``root``."""
        logs = f"{root.rstrip('/')}/*/log"
        fs, jpath = file_system(spark, logs)
        if not fs.globStatus(jpath):
            return spark.createDataFrame([], LOG).drop("config")
        return latest(spark.read.schema(LOG).parquet(logs), "session_id", ("at",)).select("session_id", "query", "phase", "final_answer", "at")

    def _there(self, what: str) -> bool:
        fs, jpath = file_system(self.spark, f"{self.path}/{what}")
        return fs.exists(jpath)

    def exists(self) -> bool:
        return self._there("log")

    def log(self) -> DataFrame:
        return self.spark.read.schema(LOG).parquet(f"{self.path}/log")

    def phase(self) -> str:
        return self.log().orderBy(F.desc("at")).first()["phase"]

    def _append(self, **changed: str) -> None:
        last = self.log().orderBy(F.desc("at")).limit(1)
        for name, value in changed.items():
            last = last.withColumn(name, F.lit(value).cast("string"))
        last.withColumn("at", F.current_timestamp()).write.mode("append").parquet(f"{self.path}/log")

    def set_phase(self, phase: str) -> None:
        if phase not in PHASES:
            raise CorpusError("setting", f"{phase} is no phase", what="phase")
        self._append(phase=phase)

    def set_final_answer(self, answer: str) -> None:
        """Keep the answer; the session is completed."""
        self._append(final_answer=answer, phase="completed")

    def final_answer(self) -> str | None:
        return self.log().orderBy(F.desc("at")).first()["final_answer"]

    def add_results(self, results: DataFrame) -> None:
        missing = {"chunk_id", "status", "processed_at"} - set(results.columns)
        if missing:
            raise CorpusError("columns", f"results lack {sorted(missing)}", what="results")
        results.write.parquet(f"{self.path}/results/run=added-{uuid.uuid4().hex}")

    def attempts(self) -> DataFrame:
        """Every result there ever was: a folder for each batch of the map and each ``add_results``."""
        return self.spark.read.option("mergeSchema", "true").parquet(f"{self.path}/results").drop("run")

    def results(self) -> DataFrame:
        """The latest result of every chunk."""
        return latest(self.attempts())

    def progress(self) -> str:
        """The folder of the map's events; ``streaming.events.progress`` follows it."""
        return f"{self.path}/progress"

    def add_note(self, note: str) -> None:
        row = self.spark.createDataFrame([(note,)], "note string").withColumn("at", F.current_timestamp())
        row.write.mode("append").parquet(f"{self.path}/notes")

    def notes(self) -> DataFrame:
        """(note, at)."""
        if not self._there("notes"):
            return self.spark.createDataFrame([], NOTES)
        return self.spark.read.schema(NOTES).parquet(f"{self.path}/notes")

    def clear_notes(self) -> None:
        self.spark.createDataFrame([], NOTES).write.mode("overwrite").parquet(f"{self.path}/notes")

    def status(self, chunks: DataFrame) -> DataFrame:
        """(total, processed, failed, percent) of the session's chunks."""
        return status(chunks, self.results() if self._there("results") else chunks.select("chunk_id", F.lit("pending").alias("status")).limit(0))

    def checkpoint(self, chunks: DataFrame) -> DataFrame:
        """Chunks with the status that their results give them; what is pending is run on resuming."""
        return restored(chunks, self.results()) if self._there("results") else chunks.withColumn("status", F.lit("pending"))

    def reset(self) -> None:
        """Back to the first phase, without results or notes; the query stays."""
        for what in ("results", "notes", "progress", "queue", "queue-log"):
            self._drop(what)
        self._append(phase=PHASES[0], final_answer=None)

    def clean(self) -> None:
        """Remove the session's tables."""
        self._drop("")

    def abort(self) -> None:
        """Cancel what ``map`` and ``reduce`` are running, from another thread; batches that were written stay, and ``map`` goes on with the rest."""
        stop(self.spark, self._stream)
        self.spark.sparkContext.cancelJobGroup(self.path)

    @contextmanager
    def _running(self, phase: str) -> Iterator[None]:
        """Jobs inside belong to the session and end with ``abort``."""
        sc = self.spark.sparkContext
        self.set_phase(phase)
        sc.setJobGroup(self.path, f"{self.session_id}: {phase}", interruptOnCancel=True)
        try:
            yield
        except (PySparkException, Py4JJavaError) as e:
            if "cancelled" in str(e).lower():
                raise CorpusError("cancelled", f"{phase} was cancelled", what=self.session_id) from e
            raise
        finally:
            sc.setLocalProperty("spark.jobGroup.id", None)

    @property
    def _stream(self) -> str:
        return f"map of {self.path}"

    def config(self) -> Config:
        kept = json.loads(self.log().orderBy(F.desc("at")).first()["config"])
        return Config(**kept | {"target_paths": tuple(kept["target_paths"])})

    def query(self) -> str:
        return self.log().orderBy(F.desc("at")).first()["query"]

    def scan(self, files: DataFrame) -> DataFrame:
        """Take ``files`` (path, text, ...) as the session's, in its scan mode, and keep their manifest."""
        config = self.config()
        if config.scan_mode == "targeted":
            files = scan_targeted(files, list(config.target_paths))
        if config.scan_mode == "lazy":
            files = files.drop("text").where(F.size(F.split("path", "/")) <= config.lazy_depth).orderBy("path").limit(config.lazy_file_limit)
        self._drop("files")
        self._drop("manifest")
        files.write.parquet(f"{self.path}/files")
        if "text" in files.columns:
            manifest(self.files()).write.parquet(f"{self.path}/manifest")
        self.set_phase("scouting")
        return self.files()

    def files(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/files")

    def chunk(self, strict: bool = True, force: bool = False) -> DataFrame:
        """Cut the session's files as its configuration says; of files that a previous session has unchanged, chunks and results are taken over.

        More than ``MOST_CHUNKS`` are refused unless forced, more than ``WARN_CHUNKS`` give a warning.
        """
        config, files = self.config(), self.files()
        cut = lambda rows: chunk_adaptive(rows) if config.adaptive_chunking else chunk_fixed(rows, config.chunk_size, config.chunk_overlap, strict)
        chunks = cut(with_text(files))
        self._drop("chunks")
        chunks.write.parquet(f"{self.path}/chunks")
        n = self.chunks().count()
        if n > MOST_CHUNKS and not force:
            self._drop("chunks")
            raise CorpusError("many_chunks", f"{n} chunks, of which {MOST_CHUNKS} are allowed", what="chunk_size")
        if n > WARN_CHUNKS:
            warnings.warn(f"{n} chunks; up to {WARN_CHUNKS} are advised", stacklevel=2)
        if config.previous_session:
            before = Session(self.spark, self.root, config.previous_session)
            old = load_manifest(self.spark, f"{before.path}/manifest")
            if old is not None and before._there("results"):
                stale = diff(old, load_manifest(self.spark, f"{self.path}/manifest")).select(F.col("file_path").alias("path"))
                same = self.chunks().join(stale, "path", "left_anti").select("chunk_id").distinct()
                self.add_results(before.results().join(same, "chunk_id", "left_semi"))
        self.set_phase("chunking")
        return self.chunks()

    def chunks(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/chunks")

    def map(self, analyser: Analyser = run_map, stronger: Analyser | None = None) -> DataFrame:
        """Analyse the chunks without a result, again those that fail, up to ``max_retries`` times in all; (chunk_id, status, findings, ...) of every chunk.

        Chunks go in batches of ``batch_size``, each written before the next (``mapping``): after an abort another ``map`` does
        what is left. Chunks that failed twice by quality or complexity go to the ``stronger`` analyser, if there is
        one, as far as ratio and cost allow; those that failed otherwise are tried again as they were.
        """
        config, chunks = self.config(), self.chunks()
        rotate(self.spark, self.progress())
        with self._running("mapping"):
            total = chunks.count()
            for attempt in range(1, config.max_retries + 1):
                left = stage(self._left(chunks, attempt, total, stronger is not None and config.enable_escalation), "map-left")
                n = left.count()
                if not n:
                    continue
                size = batch_size(n, config.batch_size)
                numbered = numbered_batches(left.select("chunk_id", "path", "start"), [F.col("path"), F.col("start"), F.col("chunk_id")], size)
                name = uuid.uuid4().hex
                queued = left.join(numbered.select("chunk_id", "batch"), "chunk_id").withColumn("attempt", F.lit(attempt))
                run = BatchRun(self.spark, f"{self.path}/results", self.progress(), name, attempt, analyser, stronger, f"{self.path}/queue/{name}", queued.schema)
                write_queue(queued, -(-n // size), run.queue)
                run_queue(f"{self.path}/queue-log/{name}", self._stream, run)
                if len(run.done) * size < n:
                    raise CorpusError("cancelled", "the map was stopped", what=self.session_id)
        return self.results() if self._there("results") else chunks.select("chunk_id", F.lit("pending").alias("status")).limit(0)

    def _left(self, chunks: DataFrame, attempt: int, total: int, escalating: bool) -> DataFrame:
        """The chunks of an attempt, with ``tier`` for those that go to the stronger analyser."""
        none = F.lit(None).cast("string")
        if not self._there("results"):
            return chunks.withColumn("tier", none) if attempt == 1 else chunks.limit(0).withColumn("tier", none)
        every = self.attempts()
        for name, kind in (("attempt", "int"), ("failure", "string"), ("tier", "string")):
            if name not in every.columns:
                every = every.withColumn(name, F.lit(None).cast(kind))
        last = latest(every.select("chunk_id", "status", "attempt", "failure", "processed_at")).withColumnRenamed("status", "__status")
        tried = F.when(F.coalesce("__status", F.lit("pending")).isin("pending", "placeholder"), 0).otherwise(F.coalesce("attempt", F.lit(1)))
        open_ = chunks.join(last, "chunk_id", "left").withColumn("__tried", tried).where((F.coalesce("__status", F.lit("pending")) != "success") & (F.col("__tried") == attempt - 1))
        if not escalating or attempt < 3:
            return open_.select(*chunks.columns, none.alias("tier"))
        config = self.config()
        cap = min(int(config.max_escalation_ratio * total), int(config.max_cost / 0.01 + 1e-9))
        used = every.where("tier is not null").select("chunk_id").distinct().count()
        wanted = open_.where(should_escalate(F.col("failure"), F.col("__tried"))).orderBy("path", "start").limit(max(cap - used, 0))
        chosen = wanted.select("chunk_id", F.lit("stronger").alias("tier"))
        return open_.join(chosen, "chunk_id", "left").select(*chunks.columns, "tier")

    def reduce(self, least: float = 0.7, opposed: float = 0.4) -> Reduced:
        """Merge the findings of all results: near-duplicates, contradictions, counts."""
        with self._running("reducing"):
            where = self.chunks().select("chunk_id", F.col("path").alias("file"))
            found = self.results().where("status = 'success'").select("chunk_id", F.posexplode("findings").alias("place", "f"))
            name = F.sha2(F.concat_ws("|", "chunk_id", "place"), 256)
            findings = stage(found.join(where, "chunk_id").select(F.left(name, F.lit(16)).alias("finding_id"), F.concat_ws(": ", "f.point", "f.evidence").alias("point"), "f.confidence", "file"), "findings")
            return aggregate_findings(findings, self.query(), None, least, opposed)

    def export(self, out: str) -> None:
        """Results as JSON lines, with the session's fields."""
        export_results(self.results(), self.session_id, self.query(), self.final_answer(), out)

    def _drop(self, what: str) -> None:
        fs, jpath = file_system(self.spark, f"{self.path}/{what}" if what else self.path)
        fs.delete(jpath, True)

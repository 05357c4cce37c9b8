"""The map in batches: written once each, stopped and resumed, sequential after failures, escalated by kind, watched."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from corpusloom.errors import CorpusError
from corpusloom.model import Config
from corpusloom.operators import analyse, mapping, sessions


def session(spark, folder, n=12, **config):
    s = sessions.Session.init(spark, str(folder), "q", Config(chunk_size=100, **{"batch_size": 3} | config), "s")
    s.scan(spark.createDataFrame([(f"f{i:02}.md", ".md", f'token = "{i:x}"') for i in range(n)], "path string, ext string, text string"))
    s.chunk(strict=False)
    return s


def events(spark, s):
    return sorted((r.batch, r.event) for r in spark.read.json(s.progress()).collect())


def failing(when, error):
    def run(part):
        out = analyse.run_map(part).join(part.select("chunk_id", F.when(when, F.lit(error)).alias("error")), "chunk_id")
        return out.withColumn("status", F.when(F.col("error").isNotNull(), "failed").otherwise(F.col("status")))

    return run


def test_batches_and_their_events(spark, tmp_path):
    s = session(spark, tmp_path, 7)
    assert s.map().where("status = 'success'").count() == 7
    assert events(spark, s) == sorted([(b, e) for b, n in enumerate((3, 3, 1)) for e in ["batch_start", "batch_end", *["chunk_complete", "finding"] * n]])
    ends = [r.data for r in spark.read.json(s.progress()).where("event = 'batch_end'").orderBy("batch").collect()]
    assert all('"failed": 0' in d and '"sequential": false' in d for d in ends)
    assert s.map().count() == 7 and s.attempts().count() == 7  # nothing is left to do


def test_stopped_and_resumed(spark, tmp_path):
    """What was written before an abort stays; another map does the rest only."""
    s = session(spark, tmp_path, 9)
    begun, codes = [], []

    @F.udf("string")
    def slow(status):
        time.sleep(60)
        return status

    def analyser(part):
        begun.append(sorted(r.path for r in part.collect()))
        out = analyse.run_map(part)
        return out if len(begun) == 1 else out.withColumn("status", slow("status"))

    def run():
        try:
            s.map(analyser)
        except CorpusError as e:
            codes.append(e.code)

    worker = threading.Thread(target=run)
    worker.start()
    for _ in range(100):
        time.sleep(0.3)
        if len(begun) == 2:
            break
    time.sleep(1)
    sessions.Session(spark, str(tmp_path), "s").abort()
    worker.join(40)
    assert codes == ["cancelled"] and not worker.is_alive()
    kept = {r.chunk_id for r in s.results().collect()}
    assert len(kept) == 3
    again = []
    assert s.map(lambda part: again.append(part.select("chunk_id").collect()) or analyse.run_map(part)).where("status = 'success'").count() == 9
    assert len([r for rows in again for r in rows]) == 6 and kept.isdisjoint({r.chunk_id for rows in again for r in rows}) and s.attempts().count() == 9


def test_two_bad_batches_turn_to_one_after_another(spark, tmp_path):
    s = session(spark, tmp_path, 12, max_retries=1)
    s.map(failing(F.lit(True), "rate limit"))
    told = [r.data for r in spark.read.json(s.progress()).where("event = 'batch_end'").orderBy("batch").collect()]
    assert ["true" in d for d in told] == [False, False, True, True]


def test_escalation_by_kind(spark, tmp_path):
    """Complex chunks go to the stronger analyser after two attempts, within the budget; timeouts never."""
    s = session(spark, tmp_path, 10, batch_size=20, max_escalation_ratio=0.25)
    n = F.regexp_extract("path", r"f(\d+)", 1).cast("int")
    weak = failing(n < 6, "x")
    late = lambda part: weak(part).withColumn("error", F.when(F.col("error").isNotNull(), F.when(F.col("chunk_id").isin(hard), "the chunk is too complex").otherwise("timeout")))
    hard = [r.chunk_id for r in s.chunks().where(n < 3).collect()]
    done = s.map(late, analyse.run_map).collect()
    strong = {r.chunk_id for r in done if r.tier == "stronger"}
    assert len(strong) == 2 and strong < set(hard) and all(r.status == "success" and r.attempt == 3 for r in done if r.chunk_id in strong)
    assert sorted(r.failure for r in done if r.status == "failed") == ["complexity", *["timeout"] * 3]
    assert len([e for e in events(spark, s) if e[1] == "escalation"]) == 2


def test_limits_on_chunks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sessions, "MOST_CHUNKS", 5)
    monkeypatch.setattr(sessions, "WARN_CHUNKS", 3)
    with pytest.raises(CorpusError, match="many_chunks"):
        session(spark, tmp_path / "a", 6)
    with pytest.warns(UserWarning, match="4 chunks"):
        session(spark, tmp_path / "b", 4)
    s = sessions.Session(spark, str(tmp_path / "a"), "s")
    with pytest.warns(UserWarning):
        assert s.chunk(strict=False, force=True).count() == 6


def test_many_chunks_make_larger_batches():
    from corpusloom.operators.mapping import batch_size

    assert batch_size(40, 5) == 5 and batch_size(500, 5) == 5 and batch_size(1_000_000, 5) == 10_000


def test_the_progress_log_is_put_aside_when_large(spark, tmp_path):
    from corpusloom.sources import files as src

    folder = str(tmp_path / "progress")
    assert not src.rotate(spark, folder)
    row = spark.sql("SELECT current_timestamp() AS ts, 'finding' AS event, 'c' AS chunk_id, 1L AS batch, 'x' AS data")
    for _ in range(2):
        src.emit(row, folder)
        assert not src.rotate(spark, folder, 10_000) and src.rotate(spark, folder, 10)
    assert spark.read.json(f"{folder}.1").count() == 1


def test_a_batch_is_work_for_many_tasks(spark, tmp_path, monkeypatch):
    """One file a batch was one task a batch, however many chunks it had."""
    monkeypatch.setattr(mapping, "FILE_CHUNKS", 10)
    chunks = spark.range(70).select(F.col("id").alias("chunk_id"), F.lit("x").alias("content"), (F.floor(F.col("id") / 35) + 1).cast("long").alias("batch"))
    mapping.write_queue(chunks, 2, str(tmp_path / "q"))
    for batch in (1, 2):
        rows = mapping.waiting(spark, str(tmp_path / "q"), chunks.schema, batch)
        assert len(rows.inputFiles()) == 4
        assert {(r.chunk_id, r.batch) for r in rows.collect()} == {(k + 35 * (batch - 1), batch) for k in range(35)}
    assert len(spark.read.schema("batch long").parquet(str(tmp_path / "q/numbers")).inputFiles()) == 2

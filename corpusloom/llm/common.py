"""What several operators share: words, the held-out fold, reading a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


#: Bytes of texts that Python workers get at once in the queries and the pipeline.
BATCH_BYTES = 2 << 20


def configure(spark: SparkSession) -> None:
    """Settings of an application of these operators (the queries, the pipeline): Arrow batches of ``BATCH_BYTES`` at most.

    The operators themselves leave the session's settings as they are.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(name).rstrip("b")) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """array<string> of the words of a text; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only, so that no other letter changes its bytes."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held_out(doc_id: Column) -> Column:
    """True for the quarter of the documents that no model may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def drawn(h: Column, share: Column) -> Column:
    """True for the given share of all 64-bit hashes ``h``, the lowest; shares far below a millionth are kept apart too."""
    return h.cast("double") + 2.0**63 <= share * 2.0**64

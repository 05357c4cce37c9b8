"""Cutting lineage through tables in the shared folder.

Executors come and go, so a cut must leave files that every executor can read
again. ``stage`` writes Parquet below ``spark.checkpoint.dir`` and hands back a
reader of it; nothing is kept in an executor's own memory or disk. A staged table
that later ones replace is removed with ``drop``, what is left when the application ends.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import broadcast

from corpusloom.errors import CorpusError

_own: list[str] = []
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; one of our own in local mode, where driver and executors are one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise CorpusError("no_shared_folder", "intermediate tables need a folder that all executors reach", what="spark.checkpoint.dir")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="corpusloom-"))
        named = _own[0]
    return named.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that no earlier run has used."""
    return f"{shared_dir(spark)}/corpusloom/{what}-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str):
    """(file system, path) of Hadoop for a path."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def stage(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return it as a fresh scan."""
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.parquet(path)
    fs, jpath = file_system(spark, path)
    fs.deleteOnExit(jpath)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def drop(*staged: DataFrame) -> None:
    """Remove tables that ``stage`` wrote; none may be read again, nor anything that was not computed yet from them."""
    for df in staged:
        if path := _paths.pop(df, None):
            fs, jpath = file_system(df.sparkSession, path)
            fs.delete(jpath, True)


def dealt(df: DataFrame) -> DataFrame:
    """``df`` over as many tasks as there are cores, where its few files would leave cores idle; else as it is.

    For work that costs far more than moving the rows. A table of many files isn't shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if 0 < len(df.inputFiles()) < cores else df


@contextmanager
def bounded_batches(spark: SparkSession, megabytes: int = 8) -> Iterator[None]:
    """Smaller Arrow batches for the jobs run inside, whose tasks hold several times a batch; the session's setting returns after.

    Elsewhere Spark's own bound of bytes in a batch holds.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    if not 0 < int(before.rstrip("b")) <= megabytes << 20:
        spark.conf.set(name, str(megabytes << 20))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def join_hot(rows: DataFrame, sizes: DataFrame, key: str, hot: int = 100_000, most: int = 100_000) -> DataFrame:
    """``rows`` joined with ``sizes`` (key, n, ...: a row per key, n rows of it in ``rows``) on a key of which some may be very frequent.

    Keys of over ``hot`` rows, of more than ``most`` such keys the hottest, are joined by broadcast, so that no task gets all rows
    of one; the rest by shuffle, of which no key then has over ``hot`` rows, or over a share of 1 / ``most`` of all. ``sizes`` must
    be cheap to read again.
    """
    many = sizes.where(sizes["n"] > hot)
    found = many.limit(most + 1).count()
    if not found:
        return rows.join(sizes.drop("n"), key)
    if found > most:
        many = stage(many.orderBy(many["n"].desc(), key).limit(most), "hottest")
    many = many.drop("n")
    few = sizes.drop("n").join(broadcast(many.select(key)), key, "left_anti")
    spread = rows.join(broadcast(many), key)
    return spread.unionByName(rows.join(broadcast(many.select(key)), key, "left_anti").join(few, key))

"""Mixing sources to target weights by weighted fair queueing.

Every source gets a target number of words. Documents wait in their source's
queue in hashed order; each has the virtual finish time (words of its source up
to and including it) / target. A second lap of the queue follows the first, so a
source whose target is above its size gives some documents twice. All sources
are then one sequence, range-sorted by finish time and cut where the running sum
of words reaches the total budget.

Targets. Sources in code point order, null last, weigh 5, 2, 1, repeating. They
share ``share`` times all words; a target stops at ``most`` times its source's
words and the excess is shared again by weight. That is filling to a common
level x: target = min(most * words, x * weight), with x from the sources sorted
by words / weight; one window over one row per source.

Scale. Running sums are taken in two steps, so no source and no sequence passes
through one task: a queue is cut by hash into pieces with their own sums, the
global sequence into the ranges of its sort; sums of the pieces are summed over
pieces, and only then are rows summed within their piece. Texts are read once, for the
sizes; equal rows get places of their own (``mix``).

Cases. Null or wordless text: size 0, never counted, taken 0. A source without
words: target 0. Repeated rows are separate documents. Ties in finish time go by
source, lap, hash and id. An empty table gives an empty table. A corpus of one
document larger than what remains of the budget takes what fits whole. Long texts are
counted whole. In ``keep_mix`` other columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import WORD
from corpusloom.plans.staging import stage

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
PIECE_ROWS = 20_000
#: Ranges of the sort at the most, whatever the number of rows; what lies in one is summed as a stream.
MOST_RANGES = 10_000


def _place() -> Column:
    """A document's place in its source's queue."""
    return F.xxhash64(F.lit("queue"), "doc_id", F.xxhash64("text"))


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, h): words of each document and its place in the queue."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", size.alias("size"), _place().alias("h"))


def targets(rows: DataFrame) -> DataFrame:
    """(source, source_size, target), one row per source."""
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1)
    per = per.withColumn("weight", weight).withColumn("cap", MOST * F.col("source_size"))
    # Sources below the level x are capped: the level is the first at which the next source is not.
    rising = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    all_rows = Window.partitionBy(F.lit(1))
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    capped = F.coalesce(F.sum("cap").over(before), F.lit(0))
    lighter = F.coalesce(F.sum("weight").over(before), F.lit(0))
    budget = SHARE * F.sum("source_size").over(all_rows)
    level = (budget - capped) / (F.sum("weight").over(all_rows) - lighter)
    per = per.withColumn("ratio", F.col("cap") / F.col("weight")).withColumn("level", level)
    first_open = F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", F.col("source").isNull(), "source", "level")))
    x = first_open.over(all_rows)["level"]
    full = F.col("cap").cast("double")
    target = F.when(x.isNull(), full).otherwise(F.least(full, x * F.col("weight")))
    return per.select("source", "source_size", target.alias("target"))


def _running(rows: DataFrame, keys: list[str], piece: str, value: str, order: list[Column], out: str) -> DataFrame:
    """``rows`` with the running sum of ``value`` within ``keys``, by ``piece`` and then ``order``."""
    sums = rows.groupBy(*keys, piece).agg(F.sum(value).alias("__sum"))
    through = Window.partitionBy(*keys or [F.lit(1)]).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    at = [F.col(k).alias(f"__at_{k}") for k in [*keys, piece]]
    offsets = sums.select(*at, F.coalesce(F.sum("__sum").over(through), F.lit(0)).alias("__before"))
    cond = F.lit(True)
    for k in [*keys, piece]:
        cond &= F.col(k).eqNullSafe(F.col(f"__at_{k}"))
    joined = rows.join(offsets, cond).select(*rows.columns, "__before")
    within = Window.partitionBy(*keys, piece).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return joined.withColumn(out, F.col("__before") + F.sum(value).over(within)).drop("__before")


def ranges_of(n: int) -> int:
    return max(2, min(n // PIECE_ROWS * 2, MOST_RANGES))


def schedule(rows: DataFrame) -> DataFrame:
    """Both laps of every document of ``sizes`` with ``finish``, ``position`` (running words) and ``taken``.

    One row per document and lap: doc_id, source, size, h, source_size, target, lap. ``rows`` must be cheap to read again.
    """
    goals = targets(rows)
    n = rows.count()
    # Pieces of a queue: the top bits of the hash, so many that a piece has a few rows.
    bits = max(4, min(40, (n // PIECE_ROWS).bit_length() + 2))
    rows = rows.withColumn("piece", F.shiftright("h", 64 - bits))
    queued = _running(rows, ["source"], "piece", "size", [F.col("h"), F.col("doc_id"), F.col("size")], "through")
    queued = _with_goals(queued, goals)
    lap = F.explode(F.sequence(F.lit(0), F.lit(MOST - 1)))
    laps = queued.withColumn("lap", lap).where("size > 0 and target > 0")
    laps = laps.withColumn("finish", (F.col("lap") * F.col("source_size") + F.col("through")) / F.col("target"))
    laps = stage(laps.drop("piece", "through"), "laps")
    order = ["finish", "source", "lap", "h", "doc_id", "size"]
    ranged = laps.repartitionByRange(ranges_of(n), *order)
    ranged = stage(ranged.withColumn("piece", F.spark_partition_id()), "ranges")
    summed = _running(ranged, [], "piece", "size", [F.col(c) for c in order], "position").drop("piece")
    budget = rows.agg(F.floor(SHARE * F.sum("size"))).first()[0] or 0
    return summed.withColumn("taken", F.col("position") <= budget)


def _with_goals(rows: DataFrame, goals: DataFrame, most: int = 10_000) -> DataFrame:
    """Each row's goal. At most ``most`` sources are broadcast; more are joined by shuffle."""
    goals = goals.withColumnRenamed("source", "__source")
    few = goals.limit(most + 1).count() <= most
    return rows.join(F.broadcast(goals) if few else goals, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")


def numbered(rows: DataFrame) -> DataFrame:
    """``sizes`` with a place of its own for each of several equal rows, so that they spread over the queue."""
    key = ["doc_id", "source", "size", "h"]
    each = rows.groupBy(*key).agg(F.count("*").alias("n")).withColumn("no", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return each.withColumn("h", F.when(F.col("no") > 1, F.xxhash64("h", "no")).otherwise(F.col("h"))).select(*key)


def mix(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken): one row per row of ``docs``."""
    rows = stage(numbered(sizes(docs)), "sizes")
    laps = schedule(rows)
    key = ["doc_id", "source", "size", "h"]
    took = laps.where("taken").groupBy(*[F.col(k).alias(f"__{k}") for k in key]).agg(F.count("*").alias("laps"))
    cond = F.lit(True)
    for k in key:
        cond &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    each = rows.join(took, cond, "left").select(*key, (F.col("size") * F.coalesce("laps", F.lit(0))).alias("taken"))
    return _with_goals(each, targets(rows)).select("doc_id", "size", "source_size", "target", "taken")


def keep_mix(docs: DataFrame) -> DataFrame:
    """The documents of the mix with the columns of ``docs``; one taken in both laps comes twice.

    Each lap takes a source's queue up to some place, so that a row's laps follow
    from its own place and the last places taken: two per source, broadcast if
    they are few. The texts aren't shuffled. Repeated rows have one place
    and are taken together.
    """
    place = F.struct("h", "doc_id", "size")
    ends = schedule(stage(sizes(docs), "sizes")).where("taken").groupBy("source", "lap").agg(F.max(place).alias("end"))
    ends = stage(ends.groupBy("source").agg(F.collect_list("end").alias("__ends")), "mix-ends")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    mine = F.struct(_place().alias("h"), F.col("doc_id").alias("doc_id"), size.alias("size"))
    rows = _with_goals(docs.withColumn("__place", F.when(size > 0, mine)), ends)
    laps = F.filter("__ends", lambda end: F.col("__place") <= end)
    lap = F.explode(laps).alias("__lap")
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns], lap).drop("__lap")

"""Benchmark decontamination with DataFrame expressions only.

Texts are lower-cased (A-Z) and cut into words and five-word shingles. A window
of a document has as many words as a benchmark item. Windows and items get a
SimHash fingerprint of 64 bits over their shingles, each weighing as often as it
occurs. Fingerprints within ``RADIUS`` bits are found by multi-index hashing, 8 blocks
of 8 bits, where by the pigeonhole at least one block differs in at most
RADIUS // 8 = 2 bits, so items are listed under every value within 2 bits of each
block, by their size. It is the index that says which items a window may be like. Pairs are
then verified by the exact weighted (multiset) Jaccard similarity of their shingles, 0.8 or more.

Which windows. A window that is 0.8 similar to an item of ``size`` shingles has at least ``similar / (1 + similar)`` of the
shingles of both in common, so ``similar * size`` at least, and so one of any ``size -
ceil(similar * size) + 1`` of the item's: documents without any of the rarest ones are left out by a first scan. In the others
the places are marked that hold a shingle of whatever item of a size; every window of that size with enough marks is
fingerprinted. It may begin with a mark: moved on to the next mark a window loses nothing that an item has. So ``start_word``
and ``n_windows`` are of windows that begin so, or end with the document.

Work grows with the text, not with the square of an item: marks in a window are counted by their
places in a sorted list; fingerprints are differences of running sums of bits; the shingles that a window has in common with
an item are a running sum, too: an occurrence counts for the starts from which it is not one too many.

Radius. Of 4,000 random windows at the limit of similarity for each of 8 sizes none was further
than 22 bits from its item, but for items of a few shingles repeated over and over.
Items of fewer than ``FEW`` distinct shingles are therefore verified without the index.

Scale. Equal texts are searched once, so that copies cost a look-up. The benchmark's shingles are broadcast up to
``BLOCK_ROWS``, the names of suspect texts up to ``MOST_SUSPECTS``; beyond, both are joined by shuffle. Texts and
passages of many copies are joined by ``join_hot``.

Cases. Null or wordless texts and items: no shingle, no match. Under five words,
the whole sequence is one shingle: such an item is found in documents that are
that sequence. A document shorter than an item is one window, of its own size. Long items and documents are searched whole.
Repeated rows of an id count as one document; items of equal text each have their rows. Several
items, or several windows for one item: a row per document and item, with the most similar
window, the first on ties. No contaminated document, or an empty table: an empty result. Of the
input only doc_id, text, item_id are read; other columns, whatever their names, pass
through in ``keep_clean``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import ascii_lower, words_of
from corpusloom.plans.staging import join_hot, stage

SHINGLE = 5
SIMILAR = 0.8
RADIUS = 23
BLOCKS = 8
#: Distinct shingles below which an item's fingerprint may stray beyond the radius.
FEW = 8
#: Shingles of a benchmark up to which it is broadcast.
BLOCK_ROWS = 1_000_000
#: Suspect texts whose names (24 characters) are broadcast.
MOST_SUSPECTS = 1_000_000


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.transform(F.array(value), use)[0]


def shingles(text: Column) -> Column:
    """array<long> of the hashes of a text's shingles, in order: a hash of the hashes of its words."""

    def of(h: Column) -> Column:
        n = F.size(h)
        starts = F.slice(h, 1, F.greatest(n - (SHINGLE - 1), F.lit(0)))
        each = F.transform(starts, lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, SHINGLE)]))
        return F.when(n >= SHINGLE, each).when(n > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    return _bound(F.transform(words_of(ascii_lower(text)), lambda w: F.xxhash64(w)), of)


def simhash(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, fp): the fingerprint of each key's 64-bit values. Two bit counts share a sum's 64 bits."""
    bit = lambda k: F.shiftrightunsigned(value, k).bitwiseAND(F.lit(1).cast("long"))
    sums = [F.sum(bit(k) + F.shiftleft(bit(k + 32), 32)).alias(f"__{k}") for k in range(32)]
    counted = rows.groupBy(*keys).agg(F.count("*").alias("__n"), *sums)
    fp = F.lit(0).cast("long")
    for k in range(32):
        low, high = F.col(f"__{k}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(f"__{k}", 32)
        for count, place in ((low, k), (high, k + 32)):
            fp = fp.bitwiseOR(F.shiftleft((2 * count > F.col("__n")).cast("long"), place))
    return counted.select(*keys, fp.alias("fp"))


def blocks_of(fp: Column) -> Column:
    """array<struct<block, part>> of the 8-bit blocks of a fingerprint."""
    return F.array(*[F.struct(F.lit(b).alias("block"), F.shiftrightunsigned(fp, 8 * b).bitwiseAND(F.lit(255).cast("long")).alias("part")) for b in range(BLOCKS)])


def _near() -> Column:
    near = [m for m in range(256) if m.bit_count() <= RADIUS // BLOCKS]
    return F.array(*[F.lit(m).cast("long") for m in near])


def items(benchmark: DataFrame) -> DataFrame:
    """(item_id, item, size, h): items with words; ``item`` names their content, ``size`` is their number of shingles."""
    rows = benchmark.select("item_id", shingles(F.col("text")).alias("h"))
    return rows.select("item_id", F.xxhash64("h").alias("item"), F.size("h").alias("size"), "h").where("size > 0")


def rare_shingles(known: DataFrame, similar: float) -> DataFrame:
    """(item, size, own, rare): an item's shingles, and those of which each window ``similar`` to it holds one."""
    whole = known.select("item", "size", F.col("h").alias("own")).dropDuplicates(["item"])
    each = whole.select("item", F.explode("own").alias("s"))
    often = each.distinct().groupBy("s").agg(F.count("*").alias("n"))
    ranked = each.join(often, "s").groupBy("item").agg(F.array_sort(F.collect_list(F.struct("n", "s"))).alias("r"))
    enough = F.ceil(F.col("size") * similar - 1e-9).cast("int")
    return whole.join(ranked, "item").select("item", "size", "own", F.array_distinct(F.slice("r.s", 1, F.col("size") - enough + 1)).alias("rare"))


def named(text: Column) -> Column:
    """96 bits that name a text."""
    return F.concat(F.hex(F.xxhash64(text)), F.hex(F.hash(text)))


def _with_keys(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``rows`` (s, ...) with what the benchmark's ``keys`` have for the shingle."""
    return rows.join(F.broadcast(keys) if keys.count() <= BLOCK_ROWS else keys, "s")


def suspects(docs: DataFrame, sought: DataFrame) -> DataFrame:
    """(doc_id, d, h): the documents that hold one of the rare shingles of an item, by the name of their text, with their shingles."""
    keys = stage(sought.select(F.explode("rare").alias("s")).distinct(), "rare-keys")
    rows = docs.where("text is not null").select("doc_id", named(F.col("text")).alias("d"), "text")
    hits = _with_keys(rows.select("d", F.explode(shingles(F.col("text"))).alias("s")), keys)
    found = stage(hits.select("d").distinct(), "suspects")
    found = F.broadcast(found) if found.count() <= MOST_SUSPECTS else found
    return rows.join(found, "d", "left_semi").select("doc_id", "d", shingles(F.col("text")).alias("h"))


def windows(bodies: DataFrame, items_: DataFrame, similar: float) -> DataFrame:
    """(d, size, start, long): all windows of ``bodies`` (d, h) of an item's size, beginning with a mark or ending with the text, that hold enough marks."""
    keys = stage(items_.select(F.explode("own").alias("s"), "size").distinct(), "item-keys")
    marks = _with_keys(bodies.select("d", F.size("h").alias("n"), F.posexplode("h").alias("at", "s")), keys)
    rows = marks.groupBy("d", "n", "size").agg(F.array_sort(F.collect_list("at")).alias("p")).withColumn("long", F.least("n", "size"))
    need = F.ceil((F.col("long") + F.col("size")) * (similar / (1 + similar)) - 1e-9).cast("int")
    rows = rows.withColumns({"need": need, "last": F.col("n") - F.col("long")})
    # The window from the i-th mark on holds enough if the mark need - 1 further on is in it.
    own = F.filter(F.transform("p", lambda a, i: F.when((a <= F.col("last")) & (F.get("p", i + F.col("need") - 1) < a + F.col("long")), a)), lambda a: a.isNotNull())
    end = F.when(F.size(F.filter("p", lambda a: a >= F.col("last"))) >= F.col("need"), F.array("last")).otherwise(F.array().cast("array<int>"))
    return rows.select("d", "size", F.explode(F.array_union(own, end)).alias("start"), "long")


def fingerprints(bodies: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` of ``windows`` with ``fp``, from running sums of bits at each window's two ends. Two bit counts share a sum's 64 bits."""
    spans = found.groupBy("d").agg(F.min("start").alias("low"), F.max(F.col("start") + F.col("long")).alias("high"))
    inside = F.slice("h", F.col("low") + 1, F.col("high") - F.col("low"))
    places = bodies.join(spans, "d").select("d", "low", F.posexplode(inside).alias("at", "s")).select("d", (F.col("low") + F.col("at")).alias("at"), F.lit(1).alias("kind"), "s")
    ends = found.select("d", F.explode(F.array(F.col("start"), F.col("start") + F.col("long"))).alias("at")).distinct()
    both = places.unionByName(ends.select("d", "at", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("s")))
    bit = lambda k: F.shiftrightunsigned("s", k).bitwiseAND(F.lit(1).cast("long"))
    before = Window.partitionBy("d").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    sums = [F.sum(bit(k) + F.shiftleft(bit(k + 32), 32)).over(before).alias(f"__{k}") for k in range(32)]
    at_ends = stage(both.select("d", "at", "kind", *sums).where("kind = 0").select("d", "at", F.array(*[F.col(f"__{k}") for k in range(32)]).alias("sums")), "bit-sums")
    low, high = (at_ends.select("d", F.col("at").alias(name), F.col("sums").alias(f"{name}_sums")) for name in ("start", "end"))
    rows = found.withColumn("end", F.col("start") + F.col("long")).join(low, ["d", "start"]).join(high, ["d", "end"])
    fp = F.lit(0).cast("long")
    for k in range(32):
        ones = F.col("end_sums")[k] - F.col("start_sums")[k]
        for count, place in ((ones.bitwiseAND(F.lit(0xFFFFFFFF)), k), (F.shiftrightunsigned(ones, 32), k + 32)):
            fp = fp.bitwiseOR(F.shiftleft((2 * count > F.col("long")).cast("long"), place))
    return rows.select("d", "size", "start", "long", fp.alias("fp"))


def near(asked: DataFrame, known: DataFrame) -> DataFrame:
    """(size, fp, item): the ``known`` items (item, size, item_fp) within the radius of each of ``asked`` (size, fp), through the blocks of both."""
    listed = known.select("item", "size", "item_fp", F.explode(blocks_of(F.col("item_fp"))).alias("b"))
    listed = listed.select("item", "size", "item_fp", "b.block", F.explode(F.transform(_near(), lambda m: m.bitwiseXOR(F.col("b.part")))).alias("part"))
    blocks = asked.select("size", "fp", F.explode(blocks_of(F.col("fp"))).alias("b")).select("size", "fp", "b.*")
    met = blocks.join(listed, ["size", "block", "part"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS)
    return met.select("size", "fp", "item").distinct()


def candidates(bodies: DataFrame, sought: DataFrame, similar: float) -> DataFrame:
    """(d, item, size, start, long): windows with the items that the index, or for items of few shingles a shingle, finds for them."""
    rows = sought.withColumn("few", F.size(F.array_distinct("own")) < FEW)
    found = stage(windows(bodies, rows.where("not few"), similar), "windows")
    prints = stage(fingerprints(bodies, found).withColumn("key", F.concat_ws(" ", "size", "fp")), "fingerprints")
    known = simhash(rows.where("not few").select("item", "size", F.explode("own").alias("s")), ["item", "size"], "s").withColumnRenamed("fp", "item_fp")
    asked = prints.groupBy("key", "size", "fp").agg(F.count("*").alias("n"))
    pairs = near(asked.select("size", "fp"), known).groupBy("size", "fp").agg(F.collect_list("item").alias("items"))
    sizes = stage(asked.join(pairs, ["size", "fp"]).select("key", "n", "items"), "near-items")
    indexed = join_hot(prints.drop("fp"), sizes, "key").select("d", F.explode("items").alias("item"), "size", "start", "long")
    keys = stage(rows.where("few").select("item", "size", F.explode(F.array_distinct("own")).alias("s")), "few-keys")
    plain = _with_keys(bodies.select("d", F.size("h").alias("n"), F.posexplode("h").alias("at", "s")), keys).withColumn("long", F.least("n", "size"))
    return indexed.unionByName(plain.select("d", "item", "size", F.least("at", F.col("n") - F.col("long")).alias("start"), "long").distinct())


def rated(bodies: DataFrame, asked: DataFrame, sought: DataFrame) -> DataFrame:
    """``asked`` of ``candidates`` with ``common``, the shingles that window and item share, repeats counted as often as both have them."""
    spans = asked.groupBy("d", "item", "size", "long").agg(F.min("start").alias("low"), F.max(F.col("start") + F.col("long")).alias("high"))
    places = bodies.join(spans, "d").select("d", "item", "long", "low", F.size("h").alias("n"), F.posexplode(F.slice("h", F.col("low") + 1, F.col("high") - F.col("low"))).alias("at", "s"))
    parts = sought.select("item", F.explode("own").alias("s")).groupBy("item", "s").agg(F.count("*").cast("int").alias("c"))
    held = places.join(parts, ["item", "s"]).groupBy("d", "item", "s", "c", "n", "long").agg(F.array_sort(F.collect_list(F.col("low") + F.col("at"))).alias("p"))
    # An occurrence is one too many in windows that also hold the one c before it.
    each = held.select("d", "item", "c", "n", "long", "p", F.posexplode("p").alias("i", "at"))
    first = F.greatest(F.coalesce(F.get("p", F.col("i") - F.col("c")), F.lit(-1)) + 1, F.col("at") - F.col("long") + 1, F.lit(0))
    each = each.select("d", "item", first.alias("first"), F.least(F.col("at"), F.col("n") - F.col("long")).alias("last")).where("first <= last")
    steps = each.select("d", "item", F.explode(F.array(F.struct(F.col("first").alias("at"), F.lit(1).alias("step")), F.struct((F.col("last") + 1).alias("at"), F.lit(-1).alias("step")))).alias("e"))
    rows = steps.select("d", "item", "e.at", "e.step", F.lit(0).alias("kind"), F.lit(None).cast("int").alias("size"), F.lit(None).cast("int").alias("long"))
    rows = rows.unionByName(asked.select("d", "item", F.col("start").alias("at"), F.lit(0).alias("step"), F.lit(1).alias("kind"), "size", "long"))
    through = Window.partitionBy("d", "item").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumn("common", F.sum("step").over(through)).where("kind = 1")
    return summed.select("d", "item", "size", F.col("at").alias("start"), "long", "common")


def leaks(docs: DataFrame, benchmark: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(doc_id, item_id, similarity, start_word, n_windows): one row per contaminated document and leaked item."""
    known = stage(items(benchmark), "items")
    sought = stage(rare_shingles(known, similar), "rare-shingles")
    copies = stage(suspects(docs, sought), "suspect-texts")
    bodies = stage(copies.groupBy("d").agg(F.first("h").alias("h"), F.count("*").alias("copies")), "texts")
    asked = stage(candidates(bodies.drop("copies"), sought, similar), "candidates")
    likeness = F.col("common") / (F.col("long") + F.col("size") - F.col("common"))
    hit = rated(bodies.drop("copies"), asked, sought).withColumn("similarity", likeness).where(F.col("similarity") >= similar)
    best = F.max_by(F.col("start"), F.struct("similarity", -F.col("start"))).cast("long").alias("start_word")
    each = hit.groupBy("d", "item").agg(F.max("similarity").alias("similarity"), best, F.count("*").alias("n_windows"))
    found = each.groupBy("d").agg(F.collect_list(F.struct("item", "similarity", "start_word", "n_windows")).alias("found"))
    sizes = stage(found.join(bodies.select("d", F.col("copies").alias("n")), "d"), "leaks")
    rows = join_hot(copies.select("doc_id", "d"), sizes, "d").select("doc_id", F.explode("found").alias("f")).select("doc_id", "f.*")
    # Rows that repeat an id with other texts count together.
    best = F.max_by(F.struct("similarity", "start_word"), F.struct("similarity", -F.col("start_word"))).alias("best")
    rows = rows.groupBy("doc_id", "item").agg(best, F.max("n_windows").alias("n_windows"))
    return rows.join(known.select("item", "item_id"), "item").select("doc_id", "item_id", "best.similarity", "best.start_word", "n_windows")


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a leaked item; columns and repeated rows as they came."""
    bad = stage(leaks(docs, benchmark).select("doc_id").distinct(), "leaked")
    bad = bad.withColumnRenamed("doc_id", "__leaked")
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("__leaked")), "left_anti")

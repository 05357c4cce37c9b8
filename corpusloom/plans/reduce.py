"""The reduce step: near-duplicate groups, merged findings, contradictions, counts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher
from itertools import combinations
from math import ceil, log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from corpusloom.functions.text import block_tokens, confidence_score, lower_words, needs_verification, negation, normalize_path, relevance, start_tokens, tokens, without_flag
from corpusloom.plans.components import star_components
from corpusloom.plans.staging import bounded_batches, join_hot, stage

#: Bits of the number of counts into which all words fall by their hash, to tell rare ones from common ones: for few texts, and for many.
RARITY = (16, 24)
#: Counts that are put together in one row.
RUN = 1 << 12
#: Words of sets that meet by all subsets of the size they must share.
SMALL = 8
#: Words of their prefixes that similar sets must share: by chance, sets share one more often than three.
SHARED = 3
#: Longs of a set's parities at the most.
SIGNS = 64
#: Texts of one start word that are compared in one task, with as many others.
CELL = 1000
#: Tasks to which cells are dealt at the most.
TASKS = 10_000
#: Words of the pairs that are compared at once, pairs that wait for that, and words of masks kept between.
LANES = 1 << 14
WAITING = 1 << 16
MASKS = 1 << 23
#: Codes into which characters are folded. The commonest, up to the first share of a start word's characters, are only counted
#: at first; those up to the next share, and the rest, are put in order apart.
FOLDED = 64
FAR = 1 << 60
TOP = np.uint64(63)
SHARES = (0.25, 0.6)
#: Lengths of the runs by which matching blocks are found.
RUNS = (12, 3, 1)


def exact_groups(rows: DataFrame, key: list[str], id_col: str) -> DataFrame:
    """One row per distinct key: the smallest id and how many rows."""
    return rows.groupBy(*key).agg(F.min(id_col).alias(id_col), F.count("*").alias("n"))


def hashed(words: Column) -> Column:
    """A set of words as sorted 64-bit hashes; sets are compared as these."""
    return F.sort_array(F.transform(words, lambda w: F.xxhash64(w)))


def token_sets(rows: DataFrame, id_col: str, text: str, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """(classes with their key and the number ``n`` of their members, (key, id) of the members): texts with one token set and one start (``exact``: equal texts) are one class, named by its smallest id."""
    # A text is cut into words once, for both.
    known = rows.select(F.col(id_col).alias("id"), lower_words(F.col(text)).alias("words"), F.length(text).alias("len"), F.col(text).alias("text"))
    known = known.select("id", hashed(F.array_distinct("words")).alias("t"), hashed(start_tokens(F.col("words"))).alias("b"), "len", "text")
    same = F.coalesce("text", F.lit("")) if exact else F.to_json(F.struct("t", "b", "len"))
    known = known.withColumn("key", F.sha2(same, 256))
    # Sets are kept once, of the classes; the rows' keys are made again, which moves none.
    classes = known.groupBy("key").agg(F.min("id").alias("class_id"), F.first("t").alias("t"), F.first("b").alias("b"), F.first("len").alias("len"), F.count("*").alias("n"))
    return stage(classes, "token-classes"), known.select("key", "id")


def token_classes(rows: DataFrame, id_col: str, text: str, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """(classes, members): the classes of ``token_sets`` and the class of every row."""
    classes, known = token_sets(rows, id_col, text, exact)
    members = join_hot(known, classes.select("key", "class_id", "n"), "key")
    return classes.drop("n"), members.select(F.col("id").alias(id_col), "class_id")


def rarity(classes: DataFrame) -> tuple[Column, int]:
    """(a table of the plan, its length): how many of the sets ``t`` hold the words of a slot, on a scale of logarithms in bytes; 6 is one set.

    About 64 slots a set, as few words as possible to a slot: where rare words share theirs with common ones, they can't be told
    from them, and prefixes fill with words that many sets hold.
    """
    low, high = RARITY
    slots = 1 << min(high, max(low, (64 * classes.count()).bit_length()))
    held = classes.select(F.explode("t").alias("h")).select(F.pmod("h", F.lit(slots)).alias("slot"), F.lit(1).cast("long").alias("c"))
    held = held.unionByName(classes.sparkSession.range(slots).select(F.col("id").alias("slot"), F.lit(0).cast("long").alias("c"))).groupBy("slot").agg(F.sum("c").alias("c"))
    level = F.least(F.lit(127), F.floor(6 * F.log2(F.col("c") + 1))).cast("tinyint")
    runs = held.groupBy(F.floor(F.col("slot") / RUN).alias("run")).agg(F.sort_array(F.collect_list(F.struct("slot", level.alias("c"))))["c"].alias("levels"))
    every = runs.agg(F.flatten(F.sort_array(F.collect_list(F.struct("run", "levels")))["levels"]).alias("rarity"))
    return every.scalar(), slots


def prefixes(classes: DataFrame, least: float, *more: str, words: int = 1) -> DataFrame:
    """(class_id, n, at, h, more...): the rarest of each set's hashes ``t``, so many that two sets of similarity ``least`` share ``words`` of them, or all that they must share; less those that no other set holds.

    Rare by the table of ``rarity``, made by one sum over all sets: any fixed order of all words is right, and in this one common
    words come last. The table is a value of the plan; sets are ranked in their own rows. ``h`` is a word's level before most
    of its hash, one long, as these are sorted at once; words that share it only bring more sets together.
    """
    table, slots = rarity(classes)
    level = lambda h: F.coalesce(F.get("rarity", F.pmod(h, F.lit(slots)).cast("int")), F.lit(0)).cast("long")
    ranked = F.sort_array(F.transform("t", lambda h: F.shiftleft(level(h), 56).bitwiseOR(F.shiftrightunsigned(h, 8))))
    n = F.size("t")
    cut = F.slice(ranked, 1, F.least(n, n - F.ceil(n * least - 1e-9).cast("int") + words))
    # Used by one projection, the table is a value of it; as a column, as under a generator, each row would hold a copy.
    rows = classes.withColumn("rarity", table).select("class_id", n.alias("n"), *more, cut.alias("cut")).select("class_id", "n", *more, F.posexplode("cut").alias("at", "h"))
    return rows.where(F.col("h") >= 7 << 56)


def met(a: DataFrame, b: DataFrame, least: float, also: Column, words: int = 1) -> DataFrame:
    """(a, b): the classes of two sides of ``prefixes`` that share so many words there and can share enough words in all.

    The first word shared by both prefixes has all other shared words after it, each next one less, so a pair that can't share enough from
    there on is dropped where it meets, before anything is moved.
    """
    rest = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) + (words - 1)
    enough = rest * (1 + least) + 1e-6 >= (F.col("n_a") + F.col("n_b")) * least
    fits = F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * least
    pairs = a.join(b, "h").where(fits & also & enough)
    if words == 1:
        return pairs.select(F.col("class_id_a").alias("a"), F.col("class_id_b").alias("b")).distinct()
    needed = F.least(F.lit(words), F.ceil(F.greatest("n_a", "n_b") * least - 1e-9).cast("int"))
    pairs = pairs.groupBy(F.col("class_id_a").alias("a"), F.col("class_id_b").alias("b"), needed.alias("needed")).count()
    return pairs.where(F.col("count") >= F.col("needed")).select("a", "b")


@F.arrow_udf(ArrayType(LongType()))
def signs(sets: pa.Array) -> pa.Array:
    """The parities of sets' hashes by slot, two to four bits a word in longs; two sets differ in no more slots than words."""
    n = np.diff(sets.offsets.to_numpy())
    longs = np.minimum(SIGNS, 2 << np.ceil(np.log2(np.maximum(n, 64) / 64)).astype(int))
    ends = np.cumsum(longs)
    words = sets.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    at = np.repeat(ends - longs, n) + ((words >> np.uint64(6)).astype(np.int64) & (np.repeat(longs, n) - 1))
    out = np.zeros(longs.sum(), np.uint64)
    np.bitwise_xor.at(out, at, np.uint64(1) << (words & np.uint64(63)))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(out.view(np.int64)))


def signed(classes: DataFrame, *more: str) -> DataFrame:
    """(class_id, n, signs, more...): the sizes of the sets ``t`` and their ``signs``."""
    return classes.select("class_id", F.size("t").alias("n"), signs("t").alias("signs"), *more)


def near_enough(least: float) -> Column:
    """Whether the signs of two sets, of which the longer are folded, let them have a similarity of ``least``."""
    w = F.least(F.size("signs_a"), F.size("signs_b"))
    fold = lambda x: F.transform(F.sequence(F.lit(0), w - 1), lambda k: F.aggregate(F.sequence(k, F.size(x) - 1, w), F.lit(0).cast("long"), lambda acc, i: acc.bitwiseXOR(F.get(x, i))))
    differ = F.aggregate(F.zip_with(fold("signs_a"), fold("signs_b"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, c: acc + c)
    return differ <= (F.col("n_a") + F.col("n_b")) * ((1 - least) / (1 + least)) + 1e-6


def _side(pre: DataFrame, side: str) -> DataFrame:
    return pre.select("h", *[F.col(c).alias(f"{c}_{side}") for c in pre.columns if c != "h"])


def _shared(a: str, b: str) -> Column:
    """Jaccard similarity of two sets."""
    shared = F.size(F.array_intersect(a, b))
    return shared / (F.size(a) + F.size(b) - shared)


def rated(pairs: DataFrame, least: float, *more: str) -> DataFrame:
    """(a, b, similarity, more...) of those of (a, ta, b, tb, more...) whose sets ``ta`` and ``tb`` have the similarity ``least``; each two sets are intersected once."""
    counts = F.struct(F.size(F.array_intersect("ta", "tb")).alias("shared"), (F.size("ta") + F.size("tb")).alias("both"))
    counted = pairs.select("a", "b", *more, F.inline(F.array(counts)))
    alike = counted.withColumn("similarity", F.col("shared") / (F.col("both") - F.col("shared")))
    return alike.where(F.col("similarity") >= least).select("a", "b", "similarity", *more)


def similar_classes(classes: DataFrame, least: float, length_ratio: float = 0.5, by_start: bool = True) -> DataFrame:
    """(a, b, similarity) of classes whose Jaccard similarity is ``least`` or more and whose starts share a word.

    Without ``by_start`` and with a ``length_ratio`` of 0 these are all pairs of that similarity.

    Candidates share ``SHARED`` words of both prefixes, of which a set of n has n - ceil(least * n) + ``SHARED``. Common words are in no
    prefix but of the shortest texts, so a word that all texts share makes no candidates. Sizes, lengths, starts (as 64
    bits) and the places of the shared word are tested where two sets meet, then their signs and starts. Only sets
    that these let be alike are fetched: what is moved for other candidates is an eighth of a set or less.
    """
    start = F.aggregate("b", F.lit(0).cast("long"), lambda acc, h: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(h, F.lit(64)).cast("int"))))
    # Both sides read one exchange.
    pre = prefixes(classes.withColumn("starts", start), least, "len", "starts", words=SHARED).repartition("h")
    also = (F.col("class_id_a") < F.col("class_id_b")) & (F.least("len_a", "len_b") >= F.greatest("len_a", "len_b") * length_ratio)
    if by_start:
        also &= F.col("starts_a").bitwiseAND(F.col("starts_b")) != 0
    pairs = met(_side(pre, "a"), _side(pre, "b"), least, also, SHARED)
    with bounded_batches(classes.sparkSession):
        known = stage(signed(classes, "b"), "signs")
    for side in "ab":
        pairs = pairs.join(known.select(F.col("class_id").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("n", "signs", "b")]), side)
    pairs = pairs.where(near_enough(least))
    if by_start:
        pairs = pairs.where(F.arrays_overlap("b_a", "b_b"))
    pairs = stage(pairs.select("a", "b"), "candidates")
    left, right = (classes.select(F.col("class_id").alias(side), F.col("t").alias(f"t{side}")) for side in "ab")
    return rated(pairs.join(left, "a").join(right, "b"), least)


def near_groups(rows: DataFrame, id_col: str, text: str, least: float = 0.7) -> DataFrame:
    """(id, class_id, group_id, n_links): a row per row, groups by transitive similarity; links are between classes."""
    classes, members = token_sets(rows, id_col, text)
    members = stage(members, "keys")
    pairs = stage(similar_classes(classes.drop("n"), least), "pairs")
    roots = star_components(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")))
    both = pairs.select(F.col("a").alias("c")).unionByName(pairs.select(F.col("b").alias("c"))).groupBy("c").agg(F.count("*").alias("n_links"))
    # What a class is called is found once a class; the rows of a class, however many, then meet one row.
    named = classes.select("key", "class_id", "n").join(roots, F.col("class_id") == F.col("node"), "left").join(both, F.col("class_id") == F.col("c"), "left")
    named = stage(named.select("key", "n", "class_id", F.coalesce("root", "class_id").alias("group_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "class-groups")
    return join_hot(members, named, "key").select(F.col("id").alias(id_col), "class_id", "group_id", "n_links")


def merged(findings: DataFrame, groups: DataFrame, id_col: str) -> DataFrame:
    """(group_id, finding id, confidence, n_findings, n_files): the surest finding leads, ties by the smallest id."""
    rows = findings.join(groups.select(id_col, "group_id"), id_col)
    lead = F.min_by(F.struct(id_col, "confidence"), F.struct(-confidence_score(F.col("confidence")), F.col(id_col)))
    out = rows.groupBy("group_id").agg(lead.alias("lead"), F.count("*").alias("n_findings"), F.countDistinct("file").alias("n_files"))
    return out.select("group_id", F.col(f"lead.{id_col}").alias(id_col), F.col("lead.confidence").alias("confidence"), "n_findings", "n_files")


def statement_classes(findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes, members): statements with the same words, asserting or denying alike, are one class, named by its smallest id."""
    rows = findings.select("finding_id", hashed(tokens(F.col("point"))).alias("t"), negation(F.col("point")).alias("neg"))
    rows = rows.withColumn("key", F.sha2(F.to_json(F.struct("t", "neg")), 256))
    classes = rows.groupBy("key").agg(F.min("finding_id").alias("class_id"), F.first("t").alias("t"), F.first("neg").alias("neg"), F.count("*").alias("n"))
    classes = stage(classes, "statement-classes")
    members = join_hot(rows.select("key", "finding_id"), classes.select("key", "class_id", "n"), "key")
    return classes.select("class_id", "t", "neg", F.col("n").alias("members")), members.select("finding_id", "class_id")


def contradictions(findings: DataFrame, least: float = 0.4, digits: int | None = None) -> DataFrame:
    """(a, b, similarity, n_a, n_b): classes of statements alike of which just one denies, the asserting one first.

    n_a asserting statements stand against n_b denying ones (``statement_classes`` has them); they aren't listed pair by pair.
    ``digits`` rounds the similarity, which costs less here than for each pair.
    """
    classes, _ = statement_classes(findings)
    n = F.size("t")
    sizes = {neg: sorted(r["n"] for r in classes.where(n <= SMALL).where(F.col("neg") == neg).select(n.alias("n")).distinct().collect() if r["n"]) for neg in (False, True)}
    out = opposed_small(classes, least, sizes[False], sizes[True], digits)
    if not classes.where(n > SMALL).isEmpty():
        pre = stage(prefixes(classes, least, "neg"), "prefixes")
        a, b = _side(pre.where("not neg"), "a"), _side(pre.where("neg"), "b")
        pairs = met(a.where(F.col("n_a") > SMALL), b, least, F.lit(True)).unionByName(met(a.where(F.col("n_a") <= SMALL), b.where(F.col("n_b") > SMALL), least, F.lit(True)))
        left, right = (classes.select(F.col("class_id").alias(side), F.col("t").alias(f"t{side}"), F.col("members").alias(f"n_{side}")) for side in "ab")
        rated = pairs.join(left, "a").join(right, "b").withColumn("similarity", _shared("ta", "tb"))
        out = out.unionByName(rated.where(F.col("similarity") >= least).select("a", "b", _rounded(F.col("similarity"), digits).alias("similarity"), "n_a", "n_b"))
    return out


def _rounded(x: Column, digits: int | None) -> Column:
    return x if digits is None else F.round(x, digits)


def opposed_small(classes: DataFrame, least: float, asserting: list[int], denying: list[int], digits: int | None = None) -> DataFrame:
    """``contradictions`` between classes of those sizes, of few words each.

    Two sets of given sizes must share so many words; they meet under each subset of so many, so that those that meet are alike, and
    are taken under the first words that they share. A word that many statements share brings none together by itself.
    Most that meet share no more: their other words, as bits of a long or of another, have none in common, and what they are rated
    is known with the subset. Only where bits of both meet are the words compared.
    """
    needed = lambda n, m: max(1, ceil(least * (n + m) / (1 + least) - 1e-9))
    t, size = F.col("t"), F.size("t")
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(h, F.lit(64)).cast("int"))
    bits = lambda of, shift: F.aggregate(of, F.lit(0).cast("long"), lambda acc, i: acc.bitwiseOR(bit(F.shiftright(F.get(t, i), shift))))

    def met_by(n: int, m: int, first: bool) -> Column:
        """A set of n words by each subset that it may share with one of m: two hashes of the subset, the bits of the other words, the similarity of sets that share it alone."""
        k = needed(n, m)
        subsets = [set(c) for c in combinations(range(n), k)]
        of = F.lit([[sorted(c), sorted({*range(n)} - c) or [n]] for c in subsets])
        sizes = (F.lit(n if first else m), F.lit(m if first else n))
        alone = F.lit(k / (n + m - k))

        def struct(c: Column) -> Column:
            words = F.transform(F.get(c, F.lit(0)), lambda i: F.get(t, i))
            others, more = (F.lit(0).cast("long") if k == n else bits(F.get(c, F.lit(1)), shift) for shift in (0, 6))
            return F.struct(F.xxhash64(*sizes, words).alias("key"), F.hash(words).alias("check"), others.alias("others"), more.alias("more"), alone.alias("alone"), _rounded(alone, digits).alias("said"))

        return F.transform(of, struct)

    def side(neg: bool, sizes: list[int], others: list[int], name: str) -> DataFrame:
        every = none = F.array().cast("array<struct<key: bigint, check: int, others: bigint, more: bigint, alone: double, said: double>>")
        for n in sizes:
            every = F.when(size == n, F.concat(none, *[met_by(n, m, not neg) for m in others if needed(n, m) <= min(n, m)])).otherwise(every)
        rows = classes.where((F.col("neg") == neg) & (size <= SMALL)).select(F.explode(every).alias("by"), "class_id", "t", "members")
        rated = ["by.alone", "by.said"] if name == "a" else []
        return rows.select("by.key", "by.check", *[F.col(f"by.{c}").alias(f"{c}_{name}") for c in ("others", "more")], *rated, F.col("class_id").alias(name), t.alias(f"t{name}"), F.col("members").alias(f"n_{name}"))

    both = side(False, asserting, denying, "a").join(side(True, denying, asserting, "b"), ["key", "check"])
    na, nb, shared = F.size("ta"), F.size("tb"), F.array_intersect("ta", "tb")
    enough = F.greatest(F.lit(1), F.ceil(least * (na + nb) / (1 + least) - 1e-9).cast("int"))
    met_first = (F.size(shared) >= enough) & (F.col("key") == F.xxhash64(na, nb, F.slice(shared, 1, enough))) & (_shared("ta", "tb") >= least)
    no_more = (F.col("others_a").bitwiseAND(F.col("others_b")) == 0) | (F.col("more_a").bitwiseAND(F.col("more_b")) == 0)
    both = both.where(F.when(no_more, F.col("alone") >= least).otherwise(met_first))
    return both.select("a", "b", F.when(no_more, F.col("said")).otherwise(_rounded(_shared("ta", "tb"), digits)).alias("similarity"), "n_a", "n_b")


def ghosts(findings: DataFrame, deleted: DataFrame) -> DataFrame:
    """(ghost, path): the findings, as hashes of their rows, that name a deleted file.

    A file is named by ``file``, or as a word of ``chunk_id`` or ``evidence`` where
    there are such columns. Words are compared whole, so this is an equi-join and
    no finding meets every deleted path.
    """
    gone = deleted.select(normalize_path(F.col("file_path")).alias("path")).distinct()
    named = [F.array(normalize_path(F.col("file")))]
    named += [F.regexp_extract_all(normalize_path(F.coalesce(c, F.lit(""))), F.lit(r"[^\s\"'`()<>,;:|]*[^\s\"'`()<>,;:|.!?]"), 0) for c in ("chunk_id", "evidence") if c in findings.columns]
    return findings.select(row_hash(findings).alias("ghost"), F.explode(F.array_distinct(F.concat(*named))).alias("path")).join(gone, "path", "left_semi").select("ghost", "path")


def row_hash(rows: DataFrame) -> Column:
    """A digest of all columns; equal rows share it, and share every verdict over their columns."""
    return F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])), 256)


def without_deleted(findings: DataFrame, deleted: DataFrame) -> DataFrame:
    """Findings that name no deleted file."""
    gone = ghosts(findings, deleted).select("ghost").distinct()
    return findings.withColumn("ghost", row_hash(findings)).join(gone, "ghost", "left_anti").drop("ghost")


@dataclass(frozen=True)
class Reduced:
    """``findings`` (group_id, finding_id, point, confidence, verify, relevance, n_findings, n_files), ``opposed`` (a, b, similarity, n_a, n_b; between findings of equal words), ``counts`` (one row)."""

    findings: DataFrame
    opposed: DataFrame
    counts: DataFrame


def aggregate_findings(findings: DataFrame, query: str, deleted: DataFrame | None = None, least: float = 0.7, opposed: float = 0.4) -> Reduced:
    """The whole reduce of (finding_id, point, confidence, file, ...): ghosts go, near-duplicates merge, contradictions are named, all is counted."""
    total = findings.count()
    kept = stage(findings if deleted is None else without_deleted(findings, deleted), "kept")
    kept = kept.withColumn("verify", needs_verification(F.col("point"))).withColumn("point", without_flag(F.col("point")))
    groups = stage(near_groups(kept, "finding_id", "point", least), "groups")
    lead = merged(kept, groups, "finding_id")
    flags = kept.join(groups.select("finding_id", "group_id"), "finding_id").groupBy("group_id").agg(F.bool_or("verify").alias("verify"))
    points = kept.select("finding_id", "point", relevance(F.col("point"), query).alias("relevance"))
    out = stage(lead.join(points, "finding_id").join(flags, "group_id").select("group_id", "finding_id", "point", "confidence", "verify", "relevance", "n_findings", "n_files"), "merged")
    pairs = stage(contradictions(out.select("finding_id", "point"), opposed), "opposed")
    counts = out.agg(F.coalesce(F.sum("n_findings"), F.lit(0)).alias("total_findings"), F.count("*").alias("unique_findings"), F.count_if("verify").alias("verification_required"))
    ratio = F.round(dedup_ratio(F.col("total_findings"), F.col("unique_findings")), 6)
    counts = counts.withColumn("deduplication_ratio", ratio).withColumn("filtered_deleted", F.lit(total) - F.col("total_findings"))
    return Reduced(out, pairs, counts.withColumn("contradictions", F.lit(pairs.agg(F.coalesce(F.sum(F.col("n_a") * F.col("n_b")), F.lit(0))).first()[0]).cast("long")))


def summary(reduced: DataFrame, most: int = 10) -> DataFrame:
    """(place, line): the surest and most relevant merged findings, one line each."""
    best = reduced.orderBy(F.desc(confidence_score(F.col("confidence"))), F.desc("relevance"), "finding_id").limit(most)
    place = F.row_number().over(Window.orderBy(F.desc(confidence_score(F.col("confidence"))), F.desc("relevance"), "finding_id"))
    check = F.when(F.col("verify"), " (to verify)").otherwise("")
    return best.select(place.cast("long").alias("place"), F.concat(F.lit("["), F.upper("confidence"), F.lit("] "), "point", check).alias("line"))


def _cells(rows: DataFrame, id_col: str, text: str, least: float, length_ratio: float) -> DataFrame:
    """(big, deal, low, high, w, part, id, text, start): texts of a start word dealt to cells of two parts, whose lengths can fit.

    Words of few texts have no parts; many of them share a cell. A word of one text is in none.
    """
    texts = rows.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).groupBy("text").agg(F.min("id").alias("id"))
    known = stage(texts.where("id is not null").withColumn("start", block_tokens(F.col("text"))), "texts")
    band = F.floor(F.log(F.greatest(F.length("text"), F.lit(1))) / log(_step(least, length_ratio)) + 1e-9).cast("int")
    each = known.withColumn("w", F.explode("start")).withColumn("band", band)
    held = stage(each.groupBy("w").agg(F.count("*").alias("n")).where("n > 1"), "ratio-words")
    few = held.where(F.col("n") <= CELL)
    deals = ceil((few.agg(F.sum("n")).first()[0] or 1) / CELL)
    every = ["id", "text", "start"]
    whole = F.struct(F.lit(0).alias("band"), F.lit(0).alias("part"))
    deal = F.pmod(F.xxhash64("w"), F.lit(deals)).cast("int").alias("deal")
    small = each.join(few.select("w"), "w").select(F.lit(None).cast("string").alias("big"), deal, whole.alias("low"), whole.alias("high"), "w", whole.alias("part"), *every)

    each = each.join(held.where(F.col("n") > CELL).select("w"), "w")
    parts = stage(each.groupBy("w", "band").agg(F.ceil(F.count("*") / CELL).cast("int").alias("parts")), "ratio-parts")
    each = each.join(parts, ["w", "band"]).withColumn("own", F.pmod(F.xxhash64("text"), F.col("parts")).cast("int"))
    for name, other in (("below", 1), ("above", -1)):
        each = each.join(parts.select("w", (F.col("band") + other).alias("band"), F.col("parts").alias(name)), ["w", "band"], "left")
    place = lambda band, part: F.struct(band.alias("band"), part.alias("part"))
    mine = place(F.col("band"), F.col("own"))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    beside = lambda d: lambda k: place(F.col("band") + d, k)
    others = F.concat(F.transform(upto(F.col("parts")), beside(0)), F.transform(upto(F.coalesce("below", F.lit(0))), beside(-1)), F.transform(upto(F.coalesce("above", F.lit(0))), beside(1)))
    each = each.select("w", mine.alias("part"), F.explode(others).alias("other"), *every)
    large = each.select(F.col("w").alias("big"), F.lit(0).alias("deal"), F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "w", "part", *every)
    # About one task a cell: cells take few bytes and much work, so tasks aren't put together by their bytes.
    tasks = deals + 2 * (parts.agg(F.sum(F.col("parts").cast("double") ** 2)).first()[0] or 0)
    return small.unionByName(large).repartition(int(min(tasks, TASKS)), "big", "deal", "low", "high")


def _step(least: float, length_ratio: float) -> float:
    """Lengths that fit differ by this factor at most, so texts meet those of their own band and of the ones beside it."""
    return (1 + 1e-9) * max(min((2 - least) / least if least > 0 else 1e9, 1 / length_ratio if length_ratio > 0 else 1e9), 1.01)


def similar_by_ratio(rows: DataFrame, id_col: str, text: str, least: float = 0.7, length_ratio: float = 0.5) -> DataFrame:
    """(a, b, ratio) of classes of equal texts whose starts share a word, alike by their characters' order.

    Exact. Texts of a start word meet in cells of two parts, by bands of length, so that a common word is spread over many tasks. Of
    the pairs whose lengths fit, only those are compared whose counts of characters are near enough: matching blocks
    hold no more of a character than either text, so the L1 distance of the counts bounds the ratio. They are also a common
    subsequence: those of the rare and of the less rare characters are taken first, then that of all, and few pairs are left to be rated. A pair meets
    under each word it shares and is compared under the first.
    """
    kind = rows.select(F.col(id_col).alias("id")).schema["id"].dataType.simpleString()

    def compared(cell: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(ratio_pairs(cell, least, length_ratio), columns=["a", "b", "ratio"])

    return _cells(rows, id_col, text, least, length_ratio).groupBy("big", "deal", "low", "high").applyInPandas(compared, f"a {kind}, b {kind}, ratio double")


def ratio_work(rows: DataFrame, id_col: str, text: str, least: float = 0.7, length_ratio: float = 0.5) -> DataFrame:
    """(w, met, compared): for each start word of two texts or more how many pairs of fitting lengths meet, and how many of them need the comparison of their order."""

    def counted(cell: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(w, met, len(x)) for w, _, x, *_, met in fitting_pairs(cell, least, length_ratio)], columns=["w", "met", "compared"])

    cells = _cells(rows, id_col, text, least, length_ratio).groupBy("big", "deal", "low", "high").applyInPandas(counted, "w string, met long, compared long")
    return cells.groupBy("w").agg(F.sum("met").alias("met"), F.sum("compared").alias("compared"))


def folded(text: str) -> np.ndarray:
    """A text's characters folded to ``FOLDED`` codes; folding brings texts nearer, never apart."""
    return (np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) % FOLDED).astype(np.uint8)


def character_counts(texts: list[str]) -> np.ndarray:
    """How often each folded character is in each text."""
    out = np.zeros((len(texts), FOLDED), np.int32)
    for k, t in enumerate(texts):
        out[k] = np.bincount(folded(t), minlength=FOLDED)
    return out


def fitting_pairs(cell: pd.DataFrame, least: float, length_ratio: float) -> Iterator[tuple]:
    """(word, places, x, y, slack, shared, met) for each word of a cell: the pairs of rows whose lengths and counts of characters fit.

    ``met`` pairs have lengths that fit. ``slack`` is by how many characters a pair's counts let it be nearer than it must. ``places`` has
    where the rows' texts hold the characters of a group, the rarest first; ``shared`` how many of a group both texts hold. What they
    don't share in order of those takes from the slack.
    """
    ids, texts, starts, parts = (cell[c].tolist() for c in ("id", "text", "start", "part"))
    key = lambda p: (p["band"], p["part"])
    low, high = key(cell["low"].iat[0]), key(cell["high"].iat[0])
    step = _step(least, length_ratio)
    for word, at in cell.groupby("w").indices.items():
        at = sorted(at.tolist(), key=lambda k: (len(texts[k]), ids[k]))
        counts = character_counts([texts[k] for k in at])
        held = counts.sum(0)
        by_count = np.argsort(-held, kind="stable")
        ends = [0, *np.searchsorted(np.cumsum(held[by_count]), np.array(SHARES) * held.sum(), "right").tolist(), FOLDED]
        groups = [slice(a, b) for a, b in zip(ends[1:], ends[2:])][::-1]
        counts = counts[:, by_count[: max(np.count_nonzero(held), 1)]]
        if counts.max() < 1 << 15:
            counts = counts.astype(np.int16)
        earlier = [{x for x in starts[k] if x < word} for k in at]
        marks = np.array([sum({1 << (hash(x) & 63) for x in e}) for e in earlier], np.uint64)
        names = pd.factorize(pd.Series([ids[k] for k in at]))[0]
        sizes = np.array([len(texts[k]) for k in at])
        grouped = np.stack([counts[:, g].sum(1, dtype=np.int64) for g in groups])
        one = low == high
        left = range(len(at)) if one else [p for p, k in enumerate(at) if key(parts[k]) == low]
        right = np.arange(len(at)) if one else np.array([p for p, k in enumerate(at) if key(parts[k]) == high], int)
        r_counts, r_marks, r_names, r_sizes, r_grouped = counts[right], marks[right], names[right], sizes[right], grouped[:, right]
        met, found = 0, []
        for p in left:
            n = int(sizes[p])
            first = p + 1 if one else int(np.searchsorted(r_sizes, n / step - 1))
            last = int(np.searchsorted(r_sizes, n * step + 1, "right"))
            if first >= last:
                continue
            among = slice(first, last)
            total, shorter = r_sizes[among] + n, np.minimum(r_sizes[among], n)
            near = (2 * shorter >= least * total) & (shorter >= np.maximum(r_sizes[among], n) * length_ratio)
            met += int(near.sum())
            apart = np.abs(r_counts[among] - counts[p])
            slack = (total - apart.sum(1) - least * total) / 2
            near &= (slack >= -1e-6) & (r_names[among] != names[p])
            for q in np.flatnonzero(near & ((r_marks[among] & marks[p]) != 0)).tolist():
                near[q] = earlier[p].isdisjoint(earlier[right[first + q]])
            fit = np.flatnonzero(near)
            if len(fit):
                shared = [(of[p] + of_right[first + fit] - apart[fit, g].sum(1)) // 2 for g, of, of_right in zip(groups, grouped, r_grouped)]
                found.append((np.full(len(fit), p), right[first + fit], slack[fit], *shared))
        none = (np.zeros(0, int), np.zeros(0, int), np.zeros(0), *[np.zeros(0, int) for _ in groups])
        x, y, slack, *shared = (np.concatenate(c) for c in zip(*found)) if found else none
        whole = {at[p]: folded(texts[at[p]]) for p in np.unique(np.concatenate([x, y])).tolist()}
        group = np.zeros(FOLDED, int)
        for k, g in enumerate(groups, 1):
            group[by_count[g]] = k
        places = [{k: np.flatnonzero(group[c] == g) for k, c in whole.items()} for g in range(1, len(groups) + 1)]
        place = np.array(at)
        yield word, places, place[x], place[y], slack, shared, met


def ratio_pairs(cell: pd.DataFrame, least: float, length_ratio: float) -> list[tuple]:
    """The pairs (a, b, ratio) of one cell, of its part or of a text of each of two parts."""
    ids, texts = cell["id"].tolist(), cell["text"].tolist()
    sizes = np.array([len(t) for t in texts])
    out, places, waiting = [], [{} for _ in SHARES], []

    def rate() -> None:
        x, y, slack, *shared = (np.concatenate(c) for c in zip(*waiting))
        whole = {k: folded(texts[k]) for k in np.unique(np.concatenate([x, y])).tolist()}
        # Characters matched further apart leave too few on either side of them.
        needed = lambda: least * (sizes[x] + sizes[y]) / 2 - 1e-6
        ahead = lambda: (np.floor(sizes[x] - needed()).astype(int), np.floor(sizes[y] - needed()).astype(int))
        for k, of in enumerate(places):
            codes = {i: whole[i][at] for i, at in of.items()}
            slack = slack - (shared[k] - common_lengths(codes, x, y, of, ahead()))
            left = slack >= -1e-6
            x, y, slack, *shared = (c[left] for c in (x, y, slack, *shared))
        left = common_lengths(whole, x, y) >= needed()
        for i, j in zip(x[left].tolist(), y[left].tolist()):
            if (ratio := block_ratio(*sorted((texts[i], texts[j])))) >= least:
                out.append((min(ids[i], ids[j]), max(ids[i], ids[j]), ratio))
        for of in places:
            of.clear()
        waiting.clear()

    for _, more, x, y, slack, shared, _ in fitting_pairs(cell, least, length_ratio):
        # Of a row of the cell, which has one word, so that no two words' groups meet.
        for of, new in zip(places, more):
            of |= new
        waiting.append((x, y, slack, *shared))
        if sum(len(w[0]) for w in waiting) >= WAITING:
            rate()
    if waiting:
        rate()
    return out


def block_ratio(a: str, b: str) -> float:
    """``SequenceMatcher(None, a, b, autojunk=False).ratio()`` from runs of characters.

    A longest match of a run's length or more is a longest match of runs, at the same place; only where
    no run matches are shorter runs and last the characters tried.
    """
    by_run: dict[int, SequenceMatcher] = {}

    def longest(alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
        for run in RUNS:
            if run <= min(ahi - alo, bhi - blo):
                if run not in by_run:
                    by_run[run] = SequenceMatcher(None, *([t[k : k + run] for k in range(len(t) - run + 1)] for t in (a, b)), autojunk=False)
                i, j, k = by_run[run].find_longest_match(alo, ahi - run + 1, blo, bhi - run + 1)
                if k:
                    return i, j, k + run - 1
        return alo, blo, 0

    matched, waiting = 0, [(0, len(a), 0, len(b))]
    while waiting:
        alo, ahi, blo, bhi = waiting.pop()
        i, j, k = longest(alo, ahi, blo, bhi)
        matched += k
        if k:
            waiting += [(alo, i, blo, j), (i + k, ahi, j + k, bhi)]
    return 2.0 * matched / (len(a) + len(b)) if a or b else 1.0


def _masks(codes: np.ndarray) -> np.ndarray:
    """For each word of 63 places and each code, and a last one that no text holds, the places that hold it; a word's last bit is left for the borrow."""
    at = np.arange(len(codes))
    bits = np.zeros((FOLDED + 1, (len(codes) // 63 + 1) * 64), bool)
    bits[codes, at // 63 * 64 + at % 63] = True
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64).T


def common_lengths(codes: dict[int, np.ndarray], x: np.ndarray, y: np.ndarray, places: dict[int, np.ndarray] | None = None, ahead: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """The lengths of the longest common subsequences of the sequences ``x`` and ``y`` of ``codes``, or a little more.

    Matching blocks are a common subsequence, so no ratio is above twice this length over both lengths. Many pairs are
    taken at once, side by side in ``LANES`` words, a step for each code of their shorter sequences. A borrow passes one word in a
    step: where that word is zero it is lost, which can only leave a place counted that isn't.

    With the codes' ``places`` in their texts, codes of which one is further on than ``ahead`` (of x, of y) may be left
    unmatched: words are skipped in the steps for which that holds of all pairs taken at once.
    """
    size = {k: len(c) for k, c in codes.items()}
    m, n = np.array([size[k] for k in x.tolist()], int), np.array([size[k] for k in y.tolist()], int)
    swap = m < n
    x, y, m, n = np.where(swap, y, x), np.where(swap, x, y), np.maximum(m, n), np.minimum(m, n)
    words = m // 63 + 1
    order = np.lexsort((x, -n, -words))
    out, known, held, start = np.zeros(len(x), int), {}, 0, 0
    while start < len(order):
        wide = int(words[order[start]])
        some = order[start : start + max(LANES // wide, 1)]
        start += len(some)
        long, which = np.unique(x[some], return_inverse=True)
        table = np.zeros((wide, len(long), FOLDED + 1), np.uint64)
        for at, k in enumerate(long.tolist()):
            if k not in known:
                if held > MASKS:
                    known, held = {}, 0
                known[k] = _masks(codes[k])
                held += known[k].size
            table[: len(known[k]), at] = known[k]
        table = table.reshape(wide, -1)
        many = int(n[some].max())
        steps = np.full((len(some), many), FOLDED, np.int64)
        for lane, k in enumerate(y[some].tolist()):
            steps[lane, : size[k]] = codes[k]
        steps = np.ascontiguousarray((steps + (which * (FOLDED + 1))[:, None]).T)
        # Bits of w are the places matched.
        w, u, s, carry, mask = (np.zeros((wide, len(some)), np.uint64) for _ in range(5))
        first, last = np.zeros(wide, int), np.full(wide, many)
        if places is not None and many and wide > 2:
            far = [np.where(swap[some], b[some], a[some]) for a, b in (ahead, ahead[::-1])]
            low, high = (ends[:, which] for ends in _ends([places[k] for k in long.tolist()], wide))
            first, last = _active((low - far[0]).min(1), (high + far[1]).max(1), [places[k] for k in y[some].tolist()], many)
        # From one change of the words in use to the next.
        turns = sorted({0, many, *first[first < many].tolist(), *last[last < many].tolist()})
        for begin, end in zip(turns, turns[1:]):
            used = np.flatnonzero((first <= begin) & (last > begin))
            if not len(used):
                continue
            rows = slice(int(used[0]), int(used[-1]) + 1)
            w_, u_, s_, carry_, mask_, part = w[rows], u[rows], s[rows], carry[rows], mask[rows], table[rows]
            up, passed = s_[1:], carry_[:-1]
            for step in steps[begin:end]:
                np.take(part, step, axis=1, out=mask_, mode="clip")
                np.bitwise_or(w_, mask_, out=mask_)
                np.bitwise_xor(w_, mask_, out=u_)
                np.subtract(w_, u_, out=s_)
                np.right_shift(s_, TOP, out=carry_)
                np.subtract(up, passed, out=up)
                np.bitwise_and(s_, mask_, out=w_)
        out[some] = np.bitwise_count(w).sum(0, dtype=np.int64)
    return out


def _ends(places: list[np.ndarray], wide: int) -> tuple[np.ndarray, np.ndarray]:
    """For each word and sequence the first and the last of the places; far off where a sequence has no such word."""
    low, high = np.full((len(places), wide), FAR), np.full((len(places), wide), -FAR)
    for k, at in enumerate(places):
        begins = at[::63]
        low[k, : len(begins)] = begins
        high[k, : len(begins)] = [*at[62::63], *at[-1:]][: len(begins)]
    return low.T, high.T


def _active(low: np.ndarray, high: np.ndarray, shorter: list[np.ndarray], many: int) -> tuple[np.ndarray, np.ndarray]:
    """For each word, whose places are matched from ``low`` to ``high``, the first step that may match in it and the one after the last.

    Of the steps, which all pairs take at once, each sixteenth is looked at.
    """
    some = range(0, many, 16)
    at = np.full((len(shorter), len(some) + 1), FAR)
    for lane, c in enumerate(shorter):
        begins = c[::16]
        at[lane, : len(begins)] = begins
    least, most = at.min(0)[:-1], np.where(at == FAR, -FAR, at).max(0)[1:]
    # A step's place is at most that of the next one looked at, or any where that is none of some pair's.
    most = np.where((at[:, 1:] == FAR).any(0), FAR, most)
    first = np.searchsorted(np.maximum.accumulate(most), low) * 16
    last = np.searchsorted(least, high, "right") * 16
    return np.minimum(first, many), np.minimum(last, many)


def dedup_ratio(total: Column, unique: Column) -> Column:
    return F.when(total > 0, 1 - unique / total).otherwise(F.lit(0.0))

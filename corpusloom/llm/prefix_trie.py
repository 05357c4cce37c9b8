"""Prefix trie of conversations, as a z-fast trie whose nodes are rows.

A conversation is a string of turns. Every prefix of it has a key, the MD5 of its turns' digests, so that equal prefixes
have equal keys and a prefix of known length is found by equality. The trie is compacted: a row per
node in which conversations end or part, with the edge above it (``low`` to ``high`` turns, the
keys and the characters of each place in between in ``path``).

Handles. The edge (low, high] is filed under the prefix of its two-fattest depth, the number in the
interval that the highest power of two divides. A conversation finds its exit node by fat binary
search: of the depths that are still possible the two-fattest is asked for; a hit moves the
lower end to the hit edge's end, or, where the conversation leaves the edge, ends the search; a miss moves the upper
end below. As many rounds as the greatest depth has bits, each a join by equality, then
one look-up of the child by its first key.

Batches. Conversations are inserted in growing batches, by hash. All of a batch are located first;
only what they have below their exit becomes rows of new places. A place belongs to
the least conversation through it, so the places that one owns are the tail of its own string: cut
where conversations part or end, they are the new edges. Edges of the trie are split where a new one leaves or ends.

Results. Counts of a node are sums over its subtree: they are added along parents by pointer doubling,
as many rounds as the height of the compacted trie has bits. Savings follow from two
sums, of the characters of members and of distinct places. At last edges are expanded, a row for every place.

Scale. Equal conversations are one string with a count, from the start. Keys that many ask for (a first turn that a third of all
conversations share) are joined by ``join_hot``. Ids that end in a node are sorted by range, joined to texts of bounded
length there, and only these pass, in order, through the running hash of their node: a digest has one task, which
holds one such text at a time.

Cases. A null role or text is empty; turns go by number, null first, then by digest, repeated rows being turns
each. Rows without a conv_id belong to no conversation; remainders of negative ids are negative, as in SQL. A conversation without turns, after the
rebuilding, is a member of the root. One conversation's keys (16 bytes a turn) are held together, its
texts never. An empty table gives an empty one. Columns other than conv_id, turn, role and text are not
read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.plans.staging import drop, join_hot, stage

#: Conversations whose first turns others take over, and the most turns taken.
FAMILY, HEADS = 100, 6
#: Shares of the strings up to which each batch goes.
BATCHES = (1 / 8, 1.0)
ROOT = b""
#: Characters of ids that are hashed at once.
IDS_AT_ONCE = 1 << 16


def strings(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns: array<struct<h, n>>): each conversation's turns in order, as digests and code points."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    h = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    turn = F.struct(F.col("turn").isNotNull().alias("numbered"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"), h.alias("h"), F.length(text).cast("long").alias("n"))
    rows = conversations.where("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    return rows.select("conv_id", F.transform("t", lambda t: F.struct(t["h"].alias("h"), t["n"].alias("n"))).alias("turns"))


def rebuilt(whole: DataFrame, family: int = FAMILY, heads: int = HEADS) -> DataFrame:
    """``whole`` of ``strings``, each one's first turns replaced by as many of its family's first conversation; their number follows from the id."""
    first = F.col("conv_id") - F.col("conv_id") % family
    lead = whole.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("__first"), F.slice("turns", 1, heads - 1).alias("__lead"))
    n = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    rows = whole.join(lead, first == F.col("__first"), "left")
    return rows.select("conv_id", F.concat(F.slice(F.coalesce("__lead", F.slice("turns", 1, 0)), F.lit(1), n), F.slice("turns", n + 1, F.size("turns"))).alias("turns"))


@F.pandas_udf(T.ArrayType(T.BinaryType()))
def prefix_keys(digests: pd.Series) -> pd.Series:
    """The key of every prefix of one turn or more."""

    def keys(turns) -> list[bytes]:
        running, out = hashlib.md5(usedforsecurity=False), []
        for h in turns:
            running.update(h)
            out.append(running.digest())
        return out

    return digests.map(keys)


@F.pandas_udf(T.ArrayType(T.LongType()))
def prefix_sums(numbers: pd.Series) -> pd.Series:
    return numbers.map(np.cumsum)


def keyed(rows: DataFrame) -> DataFrame:
    """(conv_id, depth, key, path: array<struct<key, n, chars>>): the whole string's key, and of each prefix its key, its last turn's characters and those of all."""
    part = lambda name: F.transform("turns", lambda t: t[name])
    out = rows.select("conv_id", prefix_keys(part("h")).alias("keys"), prefix_sums(part("n")).alias("sums"), part("n").alias("own"))
    path = F.transform(F.arrays_zip("keys", "own", "sums"), lambda p: F.struct(p["keys"].alias("key"), p["own"].alias("n"), p["sums"].alias("chars")))
    return out.select("conv_id", F.size("keys").alias("depth"), F.coalesce(F.try_element_at("keys", F.lit(-1)), F.lit(ROOT)).alias("key"), path.alias("path"))


def two_fattest(low: Column, high: Column) -> Column:
    """Of the numbers above ``low`` up to ``high`` that which the highest power of two divides."""
    bits = F.length(F.bin(low.bitwiseXOR(high).cast("long"))) - 1
    return F.call_function("shiftleft", F.call_function("shiftright", high, bits), bits)


def edges_of(rows: DataFrame) -> DataFrame:
    """``rows`` (up, low, path) as edges: with their end, first key, and handle."""
    high = F.col("low") + F.size("path")
    at = lambda d: F.get("path", d - F.col("low") - 1)["key"]
    return rows.select("up", "low", high.alias("high"), F.element_at("path", -1)["key"].alias("key"), F.get("path", F.lit(0))["key"].alias("first"), at(two_fattest(F.col("low"), high)).alias("handle"), "path")


def _matched(low: Column, path: Column, own: Column) -> Column:
    """Up to which depth a string follows an edge. Keys of prefixes agree up to there and nowhere below."""
    alike = F.zip_with(path, F.slice(own, low + 1, F.greatest(F.size(path), F.lit(1))), lambda a, b: F.coalesce(a["key"] == b["key"], F.lit(False)).cast("int"))
    return low + F.aggregate(alike, F.lit(0), lambda n, x: n + x)


def _asked(rows: DataFrame, by: str, edges: DataFrame, key: str) -> DataFrame:
    """``rows`` with the edge whose ``key`` is their ``by``, as far as there is one."""
    found = edges.select(F.col(key).alias(by), F.col("key").alias("e_key"), F.col("low").alias("e_low"), F.col("high").alias("e_high"), F.col("path").alias("e_path"))
    sizes = stage(rows.groupBy(by).agg(F.count("*").alias("n")).join(found, by, "left"), "trie-asked")
    return join_hot(rows, sizes, by)


def locate(strings_: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, depth, path, at, edge, inside): the depth ``at`` which each string leaves the trie, the edge on which, and whether that is before its end.

    ``edge`` is null where the string leaves, or ends, in the root.
    """
    depth = edges.agg(F.max("high")).first()[0] or 0
    start = {"a": F.lit(0), "b": F.least(F.col("depth"), F.lit(depth)), "at": F.lit(None).cast("int"), "edge": F.lit(None).cast("binary"), "inside": F.lit(False)}
    done: list[DataFrame] = []
    rows = strings_.select("key", "depth", "path", *[c.alias(n) for n, c in start.items()])
    for _ in range(depth.bit_length()):
        if rows.isEmpty():
            break
        done.append(rows.where("a >= b or at is not null"))
        open_ = rows.where("a < b and at is null").withColumn("f", two_fattest(F.col("a"), F.col("b")))
        asked = _asked(open_.withColumn("ask", F.get("path", F.col("f") - 1)["key"]), "ask", edges, "handle")
        hit, m = F.col("e_key").isNotNull(), _matched(F.col("e_low"), F.col("e_path"), F.col("path"))
        through = hit & (F.col("m") == F.col("e_high"))
        moved = asked.withColumn("m", F.when(hit, m)).select(
            "key", "depth", "path",
            F.when(through, F.col("e_high")).otherwise(F.col("a")).alias("a"),
            F.when(hit, F.col("b")).otherwise(F.col("f") - 1).alias("b"),
            F.when(hit & ~through, F.col("m")).alias("at"),
            F.when(hit, F.col("e_key")).otherwise(F.col("edge")).alias("edge"),
            (hit & ~through).alias("inside"),
        )
        rows = stage(moved, "trie-search")
    done.append(rows)
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    every = stage(every, "trie-found")
    # The child below the last node that was passed, whose handle may lie deeper than the string follows it.
    left = every.where("at is null and a < depth").withColumn("ask", F.get("path", F.col("a"))["key"])
    asked = _asked(left, "ask", edges, "first")
    hit, m = F.col("e_key").isNotNull(), _matched(F.col("e_low"), F.col("e_path"), F.col("path"))
    last = asked.select("key", "depth", "path", F.when(hit, m).otherwise(F.col("a")).alias("at"), F.when(hit, F.col("e_key")).otherwise(F.col("edge")).alias("edge"), F.coalesce(hit & (m < F.col("e_high")), F.lit(False)).alias("inside"))
    known = every.where("at is not null or a >= depth").select("key", "depth", "path", F.coalesce("at", "a").alias("at"), "edge", "inside")
    return known.unionByName(last)


def split(edges: DataFrame, cuts: DataFrame) -> DataFrame:
    """``edges`` cut at the depths of ``cuts`` (edge, at)."""
    per = cuts.groupBy(F.col("edge").alias("key")).agg(F.array_sort(F.collect_set("at")).alias("cuts"))
    rows = edges.join(per, "key", "left").withColumn("cuts", F.coalesce("cuts", F.array().cast("array<int>")))
    bounds = F.concat(F.array("low"), "cuts", F.array("high"))
    parts = rows.select("up", "low", "path", F.posexplode(F.slice(bounds, 1, F.size(bounds) - 1)).alias("i", "from"), bounds.alias("bounds"))
    to, of = F.get("bounds", F.col("i") + 1), F.col("from") - F.col("low")
    up = F.when(F.col("i") == 0, F.col("up")).otherwise(F.get("path", of - 1)["key"])
    return edges_of(parts.select(up.alias("up"), F.col("from").alias("low"), F.slice("path", of + 1, to - F.col("from")).alias("path")))


def grown(located: DataFrame) -> DataFrame:
    """The edges below the exits of ``located``."""
    below = located.where("at < depth").select(F.col("key").alias("string"), "depth", "path", F.posexplode(F.slice("path", F.col("at") + 1, F.col("depth") - F.col("at"))).alias("i", "x"), "at")
    d = F.col("at") + F.col("i") + 1
    up = F.when(d > 1, F.get("path", d - 2)["key"]).otherwise(F.lit(ROOT))
    places = below.select(F.col("x.key").alias("key"), F.col("x.chars").alias("chars"), F.col("x.n").alias("n"), d.alias("d"), up.alias("up"), "string", (d == F.col("depth")).alias("ends"))
    places = stage(places.groupBy("key").agg(F.min("string").alias("owner"), F.max("ends").alias("ends"), F.first("d").alias("d"), F.first("up").alias("up"), F.first("n").alias("n"), F.first("chars").alias("chars")), "trie-places")
    kids = places.groupBy(F.col("up").alias("key")).agg(F.count("*").alias("kids"))
    marked = places.join(kids, "key", "left").withColumn("stop", F.col("ends") | (F.coalesce("kids", F.lit(0)) != 1))
    # An owner's places are the tail of one string: stops after a place say to which edge it belongs.
    chain = marked.groupBy("owner").agg(F.array_sort(F.collect_list(F.struct("d", "key", "n", "chars", "up", "stop"))).alias("c"))
    first = F.get("c", F.lit(0))["d"]
    stops = F.transform(F.filter("c", lambda p: p["stop"]), lambda p: p["d"])
    lows = F.concat(F.array(first - 1), F.slice(stops, 1, F.greatest(F.size(stops) - 1, F.lit(0))))
    cut = chain.withColumn("first", first).select("c", "first", F.explode(F.arrays_zip(lows.alias("low"), stops.alias("high"))).alias("e"))
    mine = F.slice("c", F.col("e.low") - F.col("first") + 2, F.col("e.high") - F.col("e.low"))
    return edges_of(cut.select(F.get(mine, F.lit(0))["up"].alias("up"), F.col("e.low").alias("low"), F.transform(mine, lambda p: F.struct(p["key"].alias("key"), p["n"].alias("n"), p["chars"].alias("chars"))).alias("path")))


def build(distinct: DataFrame, batches: tuple[float, ...] = BATCHES) -> DataFrame:
    """The edges of the trie of ``distinct`` strings (key, depth, path), inserted in batches."""
    drawn = distinct.where("depth > 0").withColumn("__draw", (F.xxhash64("key").cast("double") + 2.0**63) / 2.0**64)
    edges, low = None, 0.0
    for high in batches:
        mine = drawn.where(F.col("__draw") >= low)
        mine = (mine.where(F.col("__draw") < high) if high < 1 else mine).drop("__draw")
        if edges is None:
            edges = stage(grown(mine.withColumn("at", F.lit(0))), "trie")
        else:
            found = stage(locate(mine, edges), "trie-located")
            after = stage(split(edges, found.where("inside").select("edge", "at")).unionByName(grown(found)), "trie")
            drop(edges, found)
            edges = after
        low = high
    return edges


def subtree_sums(nodes: DataFrame) -> DataFrame:
    """(key, n_convs, conv_id, chars, leaves, spread) over subtrees; ``nodes`` have their own, and ``up``, the parent (null for the root).

    Doubling: after round k a node has the sums of its descendants less than 2^k levels below, and its ancestor
    2^k levels above, to which it gives them.
    """
    adds = ("n_convs", "chars", "leaves", "spread")
    now = stage(nodes.select("key", F.col("up").alias("to"), "conv_id", *adds), "trie-sums")
    while not (rising := now.where("to is not null")).isEmpty():
        given = rising.groupBy(F.col("to").alias("key")).agg(F.min("conv_id").alias("__least"), *[F.sum(a).alias(f"__{a}") for a in adds])
        # One row per ancestor: where it stands itself, and how many point to it.
        next_ = stage(rising.groupBy("to").agg(F.count("*").alias("n")).join(now.select(F.col("key").alias("to"), F.col("to").alias("beyond")), "to"), "trie-jumps")
        jumps = join_hot(rising.select("key", "to"), next_, "to").select("key", F.col("beyond").alias("to"))
        summed = now.drop("to").join(given, "key", "left").join(jumps, "key", "left")
        own = [(F.col(a) + F.coalesce(f"__{a}", F.lit(0))).alias(a) for a in adds]
        after = stage(summed.select("key", "to", F.least("conv_id", "__least").alias("conv_id"), *own), "trie-sums")
        drop(now)
        now = after
    return now.drop("to")


def _texts_of_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, id) in order to rows (key, no, text): ids that follow each other, joined by commas up to a bound."""
    now, ids, size, no = None, [], 0, 0
    row = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([no], pa.int64()), pa.array([",".join(ids)])], names=["key", "no", "text"])
    for batch in batches:
        for key, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if key != now or size > IDS_AT_ONCE:
                if ids:
                    yield row()
                now, ids, size, no = key, [], 0, no + 1
            ids.append(str(i))
            size += len(ids[-1]) + 1
    if ids:
        yield row()


def _digest_of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, .., text) in order to one row (key, digest) for each key."""
    now, running, out = None, None, []
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
            if key != now:
                if running is not None:
                    out.append((now, running.hexdigest()))
                now, running = key, hashlib.sha256(text.encode())
            else:
                running.update(b"," + text.encode())
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.binary()), pa.array([d for _, d in out], pa.string())], names=["key", "ends"])
        out = []
    if running is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([running.hexdigest()], pa.string())], names=["key", "ends"])


def ends_digests(members: DataFrame) -> DataFrame:
    """(key, ends): SHA-256 of the ids of ``members`` (key, conv_id), ascending, joined by commas."""
    ranged = members.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").select("key", F.col("conv_id").cast("long").alias("id"), F.spark_partition_id().alias("part"))
    # Ranges follow each other, so (range, number in the range) orders a node's texts.
    texts = ranged.select("key", "id").mapInArrow(_texts_of_ids, "key binary, no long, text string").withColumn("part", F.spark_partition_id())
    ordered = texts.select("key", "part", "no", "text").repartition("key").sortWithinPartitions("key", "part", "no")
    return ordered.mapInArrow(_digest_of_texts, "key binary, ends string")


def trie(conversations: DataFrame, batches: tuple[float, ...] = BATCHES) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): a row for each distinct prefix of the rebuilt conversations."""
    members = stage(keyed(rebuilt(stage(strings(conversations), "conversations"))), "conversation-keys")
    alike = members.groupBy("key").agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("path").alias("path"))
    distinct = stage(alike, "distinct-conversations")
    edges = build(distinct.select("key", "depth", "path"), batches)
    kids = stage(edges.groupBy(F.col("up").alias("key")).agg(F.count("*").alias("kids")), "trie-children")

    of_end = F.coalesce(F.try_element_at("path", F.lit(-1))["chars"], F.lit(0).cast("long"))
    ending = distinct.select("key", "n_convs", "conv_id", (F.col("n_convs") * of_end).alias("chars"))
    root = distinct.limit(1).select(F.lit(ROOT).alias("key"), F.lit(None).cast("binary").alias("up"), F.lit(0).cast("long").alias("spread"))
    spread = F.aggregate("path", F.lit(0).cast("long"), lambda n, p: n + p["n"])
    nodes = edges.select("key", "up", spread.alias("spread")).unionByName(root).join(ending, "key", "left").join(kids, "key", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    sums = stage(subtree_sums(nodes.select("key", "up", "conv_id", zero("n_convs"), zero("chars"), F.col("kids").isNull().cast("long").alias("leaves"), "spread")), "trie-totals")

    ends = F.coalesce("ends", F.lit(hashlib.sha256(b"").hexdigest()))
    whole = sums.join(kids, "key", "left").join(ends_digests(members.select("key", "conv_id")), "key", "left").withColumns({"kids": F.coalesce("kids", F.lit(0)).cast("long"), "ends": ends})
    whole = stage(whole, "trie-nodes")
    above = whole.where("kids > 0").select(F.col("key").alias("up"), F.col("kids").alias("n"), F.col("conv_id").alias("above"))
    placed = join_hot(edges.select("key", "up", "low", "high", "path").join(whole, "key"), above, "up")
    first = F.get("path", F.lit(0))
    each = placed.withColumn("c_low", first["chars"] - first["n"]).select("*", F.posexplode("path").alias("i", "p"))
    last, before = F.col("i") == F.col("high") - F.col("low") - 1, F.col("p.chars") - F.col("p.n")
    rows = each.select(
        "conv_id",
        (F.col("low") + F.col("i") + 1).cast("long").alias("depth"),
        F.when(F.col("i") == 0, F.col("above")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        "n_convs",
        F.when(last, F.col("kids")).otherwise(F.lit(1)).cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("chars") - F.col("n_convs") * before - F.col("spread") - F.col("c_low") + before).alias("saved_tokens"),
        F.when(last, F.col("ends")).otherwise(F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
    top = whole.where(F.col("key") == F.lit(ROOT)).select(
        "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", F.col("kids").alias("n_children"),
        F.col("leaves").alias("n_leaves"), (F.col("chars") - F.col("spread")).alias("saved_tokens"), F.col("ends").alias("ends_sha256"),
    )
    return rows.unionByName(top)

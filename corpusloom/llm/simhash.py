"""Near-duplicate documents: SimHash fingerprints and covering locality-sensitive hashing.

A text is lower-cased (A-Z), cut into words and 3-word shingles, repeats
included. Each shingle is hashed with XXH64, seed 42; a bit of the 64-bit
fingerprint is set if it is set in over half of the hashes.

Fingerprints that differ in at most r bits are linked. Candidates come from
covering hashing: every bit position gets a vector of r+1 bits, and every
nonzero vector v of r+1 bits gives a mask of the positions whose vector has an
odd product with v. For any r positions some v has an even product with all
their vectors, so two fingerprints within r bits agree on all masked positions
in at least one of the 2**(r+1) - 1 tables. No pair is missed by chance.

Scale. Only distinct fingerprints are hashed, so copies cost one row. Buckets
with one fingerprint are dropped after a map-side count. A bucket of more than
``block`` fingerprints is cut again: two members within r bits agree on one of
r+1 slices of the positions outside the mask, so the bucket becomes r+1 times as many smaller
ones, and what is still large is compared block against block in separate tasks.
Each task gives only the links of a spanning forest of what it compared: all
links of the relation count for the components, while no group is listed pair by
pair. Components come from alternating large-star and small-star rounds over the
remaining links, each round a table in the shared folder.

Cases. Null or wordless text: fingerprint zero, linked like any other. Fewer
words than a shingle: the whole sequence is one shingle. Repeated rows stay, each
with its component. A row without an id has the component of its fingerprint.
Component ids are the smallest id reachable; null only if no member has an id.
An empty table gives an empty table. Columns of the input pass through in
``keep_one``; ``components`` returns its own columns only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.plans.components import star_components
from corpusloom.plans.staging import bounded_batches, drop, join_hot, stage

RADIUS = 3
SHINGLE = 3
BLOCK = 1024


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a whole text, as a signed integer."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    size = min(size, len(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = (ends - np.array([len(w) for w in words])).tolist()
    ends = ends.tolist()[size - 1 :]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], 42) for a, b in zip(starts, ends)], np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        bits = np.unpackbits(hashes[at : at + 65536].view(np.uint8), bitorder="little").reshape(-1, 64)
        counts += bits.sum(0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, fp) of every row."""
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(fingerprint)

    return docs.select(F.col(id_col).alias("doc_id"), of(F.col(text)).alias("fp"))


def _staged(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    with bounded_batches(docs.sparkSession, 2):
        return stage(fingerprints(docs, text, id_col), "prints")


def masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """The 2**(radius+1) - 1 covering masks; position p carries the vector 1 + p mod (2**(radius+1) - 1)."""
    n = 2 ** (radius + 1) - 1
    vector = [1 + p % n for p in range(bits)]
    return [sum(1 << p for p in range(bits) if (vector[p] & v).bit_count() % 2) for v in range(1, n + 1)]


def slices(mask: int, parts: int, bits: int = 64) -> list[int]:
    """The positions outside a mask, dealt into ``parts`` masks."""
    free = [p for p in range(bits) if not mask >> p & 1]
    return [sum(1 << p for p in free[k::parts]) for k in range(parts)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def forest(left: np.ndarray, right: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the pairs within ``radius`` between two blocks (or within one)."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    links = []
    bare = right.view(np.uint64)  # bits of a negative number are those of its absolute value
    for x in left:
        for y in right[np.bitwise_count(bare ^ x.view(np.uint64)) <= radius]:
            a, b = root(int(x)), root(int(y))
            if a != b:
                parent[max(a, b)] = min(a, b)
                links.append((int(x), int(y)))
    return links


def _compare(radius: int):
    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Runs of one key come together, since the partition is sorted; a run is at most two blocks."""
        held = pd.DataFrame()
        for pdf in batches:
            pdf = pd.concat([held, pdf], ignore_index=True)
            key = pdf[["mask", "rest", "pair"]]
            new = (key != key.shift()).any(axis=1).to_numpy()
            at = np.flatnonzero(new)
            held = pdf.iloc[at[-1] :] if len(at) else pdf
            yield _runs(pdf, at, radius)
        if len(held):
            yield _runs(held, np.array([0, len(held)]), radius)

    return compare


def _runs(pdf: pd.DataFrame, at: np.ndarray, radius: int) -> pd.DataFrame:
    fps, side = pdf["fp"].to_numpy(np.int64), pdf["side"].to_numpy()
    links: list[tuple[int, int]] = []
    for a, b in zip(at[:-1], at[1:]):
        if b - a > 1:
            left, right = fps[a:b][side[a:b] < 2], fps[a:b][side[a:b] > 0]
            links += forest(left, right, radius) if len(right) else forest(left, left, radius)
    return pd.DataFrame(links, columns=["u", "v"], dtype="int64")


def _crowded(rows: DataFrame, block: int) -> DataFrame:
    """Rows of buckets with two members or more, with the bucket's size ``n``."""
    sizes = rows.groupBy("mask", "rest").agg(F.count("*").alias("n")).where("n > 1")
    return rows.join(sizes, ["mask", "rest"])


def links(fps: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """(u, v): links whose components are those of all pairs of distinct ``fp`` within ``radius`` bits."""
    tables = masks(radius)
    keys = F.array(*[F.struct(F.lit(signed(m)).alias("mask"), F.col("fp").bitwiseAND(signed(m)).alias("rest")) for m in tables])
    rows = fps.select("fp", F.explode(keys).alias("k")).select("fp", "k.mask", "k.rest")
    first = stage(_crowded(rows, block), "simhash-buckets")

    finer = F.create_map(*[x for m in tables for x in (F.lit(signed(m)), F.array(*[F.lit(signed(m | s)) for s in slices(m, radius + 1)]))])
    hot = first.where(F.col("n") > block).select("fp", F.explode(finer[F.col("mask")]).alias("mask"))
    again = _crowded(hot.withColumn("rest", F.col("fp").bitwiseAND(F.col("mask"))), block)
    all_rows = first.where(F.col("n") <= block).unionByName(again)

    # A bucket of k blocks is compared as k * (k + 1) / 2 pairs of blocks, each row in k of them.
    k = F.ceil(F.col("n") / block).cast("int")
    mine = F.pmod(F.xxhash64("fp"), k).cast("int")
    dealt = all_rows.withColumn("k", k).withColumn("mine", mine)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    side = F.when(low == high, 0).when(F.col("mine") == low, 1).otherwise(2)
    dealt = dealt.select("mask", "rest", (low * F.col("k") + high).alias("pair"), side.cast("int").alias("side"), "fp")
    dealt = dealt.repartition("mask", "rest", "pair").sortWithinPartitions("mask", "rest", "pair")
    return dealt.mapInPandas(_compare(radius), "u long, v long").distinct()


def with_components(prints: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """(doc_id, fp) to (doc_id, fp, component_id). ``prints`` must be cheap to read again."""
    distinct = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "fingerprints")
    found = star_components(links(distinct.select("fp"), radius, block))
    member = distinct.join(found, distinct.fp == found.node, "left")
    member = stage(member.select("fp", "n", "least", F.coalesce("root", "fp").alias("root")), "members")
    lowest = stage(member.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), "lowest")
    named = stage(join_hot(member.withColumnRenamed("n", "rows"), lowest, "root").select("fp", F.col("rows").alias("n"), "component_id"), "named")
    drop(distinct, member, lowest)
    return join_hot(prints, named, "fp").select("doc_id", "fp", "component_id")


def components(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, fingerprint, component_id), one row for each row of ``docs``."""
    prints = _staged(docs, text, id_col)
    found = with_components(prints)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents of ``docs`` that are the smallest id of their component, one row each.

    Rows that repeat an id count as one document. Rows without an id form
    their own groups by fingerprint; those are kept, having nothing to be named by.
    """
    prints = _staged(docs)
    found = with_components(prints)
    drop = stage(found.where("doc_id <> component_id").select("doc_id").distinct(), "copies")
    again = stage(found.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id"), "repeated")
    kept = docs.join(drop, "doc_id", "left_anti")
    once = kept.join(again, "doc_id", "left_anti")
    first = kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return once.unionByName(first).select(*[F.col(f"`{c}`") for c in docs.columns])

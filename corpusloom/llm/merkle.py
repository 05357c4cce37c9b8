"""Merkle manifest of a table of documents: roots, inclusion proofs, proof of tampering.

Every row is a leaf: the SHA-256 of its fields, each as its UTF-8 byte count, ``:`` and
its value, or ``-``. Leaves of a language ascend by doc_id; every ``FAN`` neighbours become
the hash of their joined hex digests, until one node, the language's root, remains. These,
ordered by language, make the last tree in the same way.

Levels. Nodes are rows (tree, n, place, digest), n the number of nodes of the tree's level. Each
level is a self-join by equality: a node computes its siblings' places by shifting its slot in
its run (slot + 1, + 2, ... modulo ``FAN``, XOR being the case of two), looks them up among the nodes, and the
rows of slot zero, which know their whole run, emit the parents. What
stands left and right of a node is its step of the proof.

Proofs. Steps are put together from the root down, a row per node and level; rows of leaves meet
the path of their parent only, so what is shuffled for a row doesn't grow with the tree's
height, and a node has one parent with ``FAN`` children at most.

Scale. Leaves are numbered by ``running_sum`` (range sort, sums of ranges), so no language, however
large, passes through one task; runs are keyed by (tree, place). The number of levels follows
from the largest language, the one number that reaches the driver beside the root.

Cases. A null field is ``-``, a null language is a tree of its own, before all others;
a null doc_id comes first. Repeated ids and repeated rows are leaves each, in the order of
their digests. A lone leaf is its language's root, a lone language's root the root; a last run of one node is hashed
alike. Empty text: ``0:``. Long texts are hashed whole. An empty table gives an empty one. Columns other than FIELDS are not
read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.plans.running import running_sum
from corpusloom.plans.staging import join_hot, stage

FAN = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = "array<struct<left:string,right:string>>"


def leaf(**changed: Column) -> Column:
    """The digest of a row's fields; ``changed`` replaces some."""

    def written(name: str) -> Column:
        value = changed.get(name, F.col(name)).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*map(written, FIELDS)), 256)


def siblings(nodes: DataFrame) -> DataFrame:
    """(tree, n, place, h, left, right): every node with the digests before and after it in its run, joined."""
    slot = F.col("place") % FAN
    shifted = F.transform(F.sequence(F.lit(0), F.lit(FAN - 1)), lambda k: F.col("place") - slot + (slot + k) % FAN)
    asked = nodes.select("tree", "n", "place", F.explode(shifted).alias("at")).where("at < n")
    held = nodes.select("tree", F.col("place").alias("at"), "h")
    runs = asked.join(held, ["tree", "at"]).groupBy("tree", "n", "place").agg(F.array_sort(F.collect_list(F.struct("at", "h"))).alias("run"))
    part = lambda keep: F.array_join(F.transform(F.filter("run", keep), lambda x: x["h"]), "")
    place = F.col("place")
    return runs.select("tree", "n", "place", part(lambda x: x["at"] == place).alias("h"), part(lambda x: x["at"] < place).alias("left"), part(lambda x: x["at"] > place).alias("right"))


def parents(level: DataFrame) -> DataFrame:
    """(tree, n, place, h) of the level above: the rows of slot zero name their run's hash."""
    up = (F.col("place") / FAN).cast("long"), F.ceil(F.col("n") / FAN).cast("long")
    return level.where(F.col("place") % FAN == 0).select("tree", up[1].alias("n"), up[0].alias("place"), F.sha2(F.concat("h", "right"), 256).alias("h"))


def grow(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """(levels of ``siblings`` from the leaves up, roots (tree, h)): all trees at once; a tree is done when one node is left."""
    levels: list[DataFrame] = []
    roots = nodes.where("n = 1").select("tree", "h")
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        level = stage(siblings(nodes.where("n > 1")), "merkle-level")
        levels.append(level)
        nodes, most = parents(level), -(-most // FAN)
        roots = roots.unionByName(nodes.where("n = 1").select("tree", "h"))
    return levels, stage(roots, "merkle-roots")


def paths(levels: list[DataFrame]) -> DataFrame | None:
    """(tree, place, way): the steps from each node of the lowest level up to its tree's root; none without a level."""
    above = None
    for level in reversed(levels):
        here = level.select("tree", "place", F.array(F.struct("left", "right")).alias("way"))
        if above is not None:
            rest = above.select(F.col("tree").alias("__tree"), F.col("place").alias("__place"), F.col("way").alias("__way"))
            met = (F.col("tree") == F.col("__tree")) & ((F.col("place") / FAN).cast("long") == F.col("__place"))
            here = here.join(rest, met, "left").select("tree", "place", F.concat("way", F.coalesce("__way", F.array().cast(STEP))).alias("way"))
        above = here
    return above


def fold(digest: Column, way: Column) -> Column:
    """The root that a leaf's digest and its proof give."""
    return F.aggregate(way, digest, lambda h, step: F.sha2(F.concat(step["left"], h, step["right"]), 256))


def proof(way: Column) -> Column:
    """The proof as text: the siblings of every level, from the leaf up, left to right."""
    return F.array_join(F.transform(way, lambda step: F.concat(step["left"], step["right"])), "")


def tree_of(lang: Column) -> Column:
    """A key for a language that sorts like it, null first."""
    return F.coalesce(F.concat(F.lit("+"), lang), F.lit(""))


def numbered(leaves: DataFrame) -> DataFrame:
    """``leaves`` (tree, doc_id, h, ...) with their ``place`` in their tree from 0 and the tree's number of leaves ``n``."""
    placed = stage(running_sum(leaves, F.lit(1), [F.col("doc_id"), F.col("h")], "__no", ("tree",)), "merkle-leaves")
    sizes = stage(placed.groupBy("tree").agg(F.max("__no").alias("n")).withColumn("__n", F.col("n")), "merkle-sizes")
    rows = join_hot(placed, sizes, "tree")
    return rows.select(*leaves.columns, (F.col("__no") - 1).alias("place"), F.col("__n").alias("n"))


def manifest(docs: DataFrame, claimed: Column | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, way, claimed): a row for each row of ``docs``.

    ``way`` is the proof, ``claimed`` the digest to be checked against it: that of the column given, where it
    isn't null, else the leaf itself.
    """
    mine = leaf()
    rows = docs.select("doc_id", tree_of(F.col("lang")).alias("tree"), mine.alias("h"), F.coalesce(claimed, mine).alias("claimed") if claimed is not None else mine.alias("claimed"))
    leaves = stage(numbered(stage(rows, "merkle-rows")), "merkle-numbered")
    levels, subroots = grow(leaves.select("tree", "n", "place", "h"))
    names = running_sum(subroots, F.lit(1), [F.col("tree")], "no")
    count = subroots.count()
    tops = stage(names.select(F.lit("").alias("tree"), F.lit(count).cast("long").alias("n"), (F.col("no") - 1).alias("place"), "h", F.col("tree").alias("name")), "merkle-tops")
    top_levels, roots = grow(tops.drop("name"))
    root = roots.first()
    if root is None:
        return leaves.select("doc_id", F.col("h").alias("leaf"), F.col("h").alias("subroot"), F.col("h").alias("root"), F.array().cast(STEP).alias("way"), "claimed")

    none = F.array().cast(STEP)
    top_way = paths(top_levels)
    langs = tops.select(F.col("name").alias("tree"), "place", F.col("h").alias("subroot"))
    langs = langs.join(top_way.select("place", F.col("way").alias("top")), "place", "left") if top_way is not None else langs.withColumn("top", none)
    sizes = leaves.where("place = 0").select("tree", "n")
    langs = stage(langs.join(sizes, "tree").select("tree", "n", "subroot", F.coalesce("top", none).alias("top")), "merkle-languages")
    rows = join_hot(leaves.drop("n"), langs, "tree")
    way = F.coalesce("top", none)
    if levels:
        first = levels[0].select(F.col("tree"), "place", F.array(F.struct("left", "right")).alias("step"))
        rows = rows.join(first, ["tree", "place"], "left")
        way = F.concat(F.coalesce("step", none), way)
        if (above := paths(levels[1:])) is not None:
            rows = rows.withColumn("up", (F.col("place") / FAN).cast("long")).join(above.select("tree", F.col("place").alias("up"), F.col("way").alias("rest")), ["tree", "up"], "left")
            way = F.concat(F.coalesce("step", none), F.coalesce("rest", none), F.coalesce("top", none))
    return rows.select("doc_id", F.col("h").alias("leaf"), "subroot", F.lit(root["h"]).alias("root"), way.alias("way"), "claimed")


def verified(rows: DataFrame) -> DataFrame:
    """``rows`` of ``manifest`` with ``folded_root``, what the claimed digest and the proof give, and whether it is the root."""
    folded = rows.withColumn("folded_root", fold(F.col("claimed"), F.col("way")))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))

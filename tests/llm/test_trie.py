"""The prefix trie against a brute-force one; edge cases."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import prefix_trie, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, up string, key string"
NONE = hashlib.sha256(b"").hexdigest()


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(v, key=lambda t: t[0])] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple([*own.get(c - int(math.fmod(c, 100)), [])[:h], *turns[h:]])
    through = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            through[turns[:d]].append(c)
    kids = defaultdict(list)
    for p in through:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(through, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + ((len(through[p]) - 1) * len(p[-1][1]) if p else 0)
    out = []
    for p, cs in through.items():
        ends = ",".join(str(c) for c in sorted(c for c in cs if len(built[c]) == len(p)))
        out.append((min(cs), len(p), min(through[p[:-1]]) if p else None, len(cs), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def test_given_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(queries.op11_prefix_trie(spark, SF)) == brute(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_conversations(spark, seed, monkeypatch):
    """Few different turns, so that strings nest, part and end everywhere; several batches; long ones; tiny texts of ids; every key hot."""
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-50, 700), 120):
        alphabet = "ab" if c % 3 else "a"
        for k in range(rng.choice([1, 2, 3, 5, 8, 8, 13, 40])):
            rows.append((c, k, rng.choice(["u", "u", None]), rng.choice([*alphabet, None, "é" * 9])))
    rows += rng.sample(rows, 10)
    rng.shuffle(rows)
    monkeypatch.setattr(prefix_trie, "IDS_AT_ONCE", 7)
    join = prefix_trie.join_hot
    monkeypatch.setattr(prefix_trie, "join_hot", lambda a, b, key: join(a, b, key, hot=3, most=5))
    # Repeated rows stand side by side, whatever their digest; other ties there are none.
    assert rows_of(prefix_trie.trie(frame(spark, rows), batches=(0.2, 0.5, 1.0))) == brute(rows)


def test_edges(spark):
    rows = [(None, 0, "u", "lost"), (7, None, None, None), (7, 0, "u", "x" * 100_000), (7, 1, "", ""), (8, 5, "u", ""), (8, 5, "u", ""), (5, 0, None, None)]
    assert rows_of(prefix_trie.trie(frame(spark, rows))) == brute(rows)
    assert prefix_trie.trie(frame(spark, rows).where("conv_id < 0")).count() == 0
    assert prefix_trie.trie(frame(spark, rows[:1])).count() == 0


def test_only_conversations_without_turns(spark):
    """Whose own turns are all replaced, by a first conversation that isn't there."""
    lone = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 1)
    (root,) = rows_of(prefix_trie.trie(frame(spark, [(lone, 0, "u", "gone")])))
    assert root == (lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())


def test_two_fattest(spark):
    for low in range(20):
        for high in range(low + 1, 40):
            want = max(range(low + 1, high + 1), key=lambda x: x & -x)
            assert want == high >> ((low ^ high).bit_length() - 1) << ((low ^ high).bit_length() - 1)
    pairs = spark.createDataFrame([(a, b) for a in range(9) for b in range(a + 1, 20)], "a int, b int")
    for r in pairs.select("a", "b", prefix_trie.two_fattest(F.col("a"), F.col("b")).alias("f")).collect():
        assert r.f == max(range(r.a + 1, r.b + 1), key=lambda x: x & -x)


def test_searches_hit_handles(spark):
    """Strings of 40 turns are located in as many rounds as 40 has bits, each one's exit being its longest prefix in the trie."""
    rng = random.Random(5)
    known = {tuple(rng.choice("ab") for _ in range(n)) for n in (1, 4, 9, 40, 40, 23) for _ in range(4)}
    asked = {k[:n] + tuple(rng.choice("abc") for _ in range(m)) for k in known for n in (0, 3, len(k)) for m in (0, 5)}
    strings = lambda some: prefix_trie.keyed(spark.createDataFrame([(i, [(x.encode(), 1) for x in s]) for i, s in enumerate(some)], "conv_id long, turns array<struct<h: binary, n: long>>"))
    some, others = sorted(known), sorted(asked)
    edges = prefix_trie.build(strings(some).dropDuplicates(["key"]), (1.0,))
    found = prefix_trie.locate(strings(others).drop("conv_id"), edges)
    prefixes = {k[:n] for k in known for n in range(len(k) + 1)}
    keys = {r.key: others[r.conv_id] for r in strings(others).collect()}
    got = found.collect()
    assert len(got) == len(others)
    for r in got:
        s = keys[bytes(r.key)]
        assert r["at"] == max(n for n in range(len(s) + 1) if s[:n] in prefixes)

"""The Merkle manifest against a brute-force one; edge cases."""

import hashlib
import string
import zlib

from corpusloom.llm import merkle, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, place long, tree string, h string"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]))


def tree(nodes):
    """(root, per leaf the list of its (left, right) siblings)."""
    steps, where = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, w in enumerate(where):
            run = nodes[w - w % 8 : w - w % 8 + 8]
            steps[k].append(("".join(run[: w % 8]), "".join(run[w % 8 + 1 :])))
        nodes = [H(*nodes[a : a + 8]) for a in range(0, len(nodes), 8)]
        where = [w // 8 for w in where]
    return nodes[0], steps


def brute(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = {lang: sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for lang in langs}
    trees = {lang: tree([leaf(r) for r in g]) for lang, g in groups.items()}
    root, tops = tree([trees[lang][0] for lang in langs])
    out = []
    for lang, top in zip(langs, tops):
        for r, way in zip(groups[lang], trees[lang][1]):
            steps = way + top
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None
            folded = leaf((*r[:4], r[4].translate(LOWER))) if changed else leaf(r)
            for left, right in steps:
                folded = H(left, folded, right)
            out.append((r[0], leaf(r), trees[lang][0], root, H(*(a + b for a, b in steps)), folded, folded == root))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def query(spark, rows, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(*r, 7, "+x", "y") for r in rows], SCHEMA)
    monkeypatch.setattr(queries, "table", lambda *a: docs)
    return queries.op13_merkle(spark, "")


def test_given_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    want = brute(rows)
    assert rows_of(queries.op13_merkle(spark, SF)) == want
    assert {r[-1] for r in want} == {True, False}


def test_edges(spark, tmp_path, monkeypatch):
    rows = [(None, None, None, None, None), (None, "s", None, 3, "ABC"), (3, "s", "de", 0, ""), (3, "s", "de", 0, ""), (3, "s", "de", 1, "É"), (4, "", "", 5, "A" * 200_000), *[(i, "s", "en", i, f"Text {i}") for i in range(-3, 70)], (5, "s", "zz", None, "Lone")]
    assert rows_of(query(spark, rows, tmp_path, monkeypatch)) == brute(rows)
    for some in (rows[5:6], rows[:2], rows[2:11]):
        assert rows_of(query(spark, some, tmp_path, monkeypatch)) == brute(some)
    assert query(spark, rows[:1], tmp_path, monkeypatch).where("doc_id = 0").count() == 0


def test_empty(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([], SCHEMA)
    monkeypatch.setattr(queries, "table", lambda *a: docs)
    got = queries.op13_merkle(spark, "")
    assert got.count() == 0 and got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_any_change_is_found(spark):
    docs = spark.createDataFrame([(i, "s", "en", 1, f"text {i}", 0, "", "") for i in range(100)], SCHEMA)
    rows = merkle.manifest(docs).cache()
    assert merkle.verified(rows).where("not verified").count() == 0
    other = merkle.manifest(docs.replace("text 57", "text 58", "text")).first()
    assert other.root != rows.first().root
    mixed = rows.withColumn("claimed", rows.leaf.substr(2, 63))
    assert merkle.verified(mixed).where("verified").count() == 0

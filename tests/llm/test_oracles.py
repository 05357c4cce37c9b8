"""Operators with an SQL twin give the twin's rows."""

import duckdb
import pytest

from corpusloom.llm import oracles, queries, rules

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_twin(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    want = con.execute(oracles.ORACLES[name])
    names, kinds = [c[0] for c in want.description], [str(c[1]) for c in want.description]
    got = queries.QUERIES[name](spark, SF).select(*names)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall()))
    assert [{"bigint": "BIGINT", "boolean": "BOOLEAN", "string": "VARCHAR"}[t] for _, t in got.dtypes] == kinds


def test_twin_on_texts_that_each_rule_rejects(spark):
    words = [f"wort{i}" for i in range(40)]
    texts = [
        None, "", " \t\n", " ".join(words), " ".join(words[:19]), " ".join(words[:20]), " ".join(words * 2), " ".join(words) + " # $ % & | < >" * 2, " ".join("a" for _ in words), " ".join(["x" * 30] * 3 + ["y" * 25 + str(i) for i in range(30)]),
        "\n".join(["eine zeile mit worten", *words[:20]] * 1 + ["eine zeile mit worten"] * 4), " ".join(w + "!?" for w in words), " ".join(str(i * 7919) for i in range(40)), " ".join(words).upper(), " ".join(w for w in words[:20] for _ in range(2)),
        " ".join(f"{w} {w} {w}" for w in words[:12]), "é " * 25, "\n".join(["same line of five words"] * 9), "\x0b".join(words), " ".join(words),
    ]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    want = sorted(con.execute(oracles.ORACLES["op7_rules"]).fetchall())
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(map(tuple, rules.judge(docs, list(rules.rules())).collect())) == want
    assert len({r[-1] for r in want}) == 2

"""The pipeline against brute force on the smallest table, and its stages on rows of every odd kind."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from corpusloom.llm import langid, mixing, queries, token_store
from tests.llm.test_operators import EDGE, brute_components, brute_fingerprint, brute_leaks, brute_targets, docs_of

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


def brute_mix(rows, places):
    """How often each of ``rows`` (doc_id, source, size) is taken: all laps of all queues by finish time, up to the budget."""
    of = Counter()
    for _, source, size in rows:
        of[source] += size
    goal, through, laps = brute_targets(dict(of)), Counter(), []
    for doc, source, size in sorted(rows, key=lambda r: places[r[0]]):
        if size:
            through[source] += size
            laps += [((lap * of[source] + through[source]) / goal[source], source, lap, places[doc], doc, size) for lap in (0, 1)]
    budget, taken, used = int(1.5 * sum(of.values())), Counter(), 0
    for *_, doc, size in sorted(laps):
        used += size
        if used > budget:
            break
        taken[doc] += 1
    return taken


def brute_tokens(rows):
    """(doc_id, start, n_tokens, ids_crc32) of (doc_id, text), by the tokenizer itself."""
    encode = token_store.Encoder(queries.tokenizer_path()).tokenizer.encode
    coded = [(doc, encode(text or "", add_special_tokens=False).ids + [1]) for doc, text in sorted(rows)]
    starts = np.cumsum([0] + [len(ids) for _, ids in coded]).tolist()
    return [(doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for (doc, ids), start in zip(coded, starts)]


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_dedup", "decontamination", "mixing", "tokens"]
    assert entry.queries()["pipeline"] is corpus_pipeline.run


def test_registered(spark):
    assert [n for n in entry.queries() if n.startswith("op") and n[2].isdigit()] == [
        "op1_langid", "op2_simhash", "op3_mixing", "op4_quality", "op5_decontam", "op6_secrets", "op7_rules", "op8_orc_tokens", "op9_html", "op10_pii", "op11_prefix_trie", "op12_bpe", "op13_merkle",
    ]


def test_run_is_what_brute_force_gives(spark):
    """Every decision of every stage; the language of a text is taken from the operator, whose accuracy is tested beside it."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    named = langid.identify(docs.select("doc_id", "text"), langid.train(docs)).collect()
    known = sorted(r.doc_id for r in named if r.lang_pred != "und" and r.score >= 0.4)
    assert len(known) >= 0.99 * len(rows)

    prints = [(i, brute_fingerprint(rows[i].text)) for i in known]
    root = brute_components(prints)
    single = [i for i, fp in prints if root[fp] == i]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaked = {d for d, _ in brute_leaks([(i, rows[i].text) for i in single], items)}
    clean = [i for i in single if i not in leaked]
    assert len(clean) < len(single) < len(known)

    sized = mixing.sizes(docs.where(F.col("doc_id").isin(clean))).collect()
    taken = brute_mix([(r.doc_id, r.source, r.size) for r in sized], {r.doc_id: r.h for r in sized})
    want = brute_tokens([(i, rows[i].text) for i, n in taken.items() for _ in range(n)])
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == want


#: Names that the operators use for columns of their own.
CLASHING = ("size", "h", "piece", "lap", "finish", "target", "taken", "source_size", "fp", "component_id", "lang_pred", "start", "n_tokens", "item_id", "content")


@pytest.mark.parametrize("name", list(STAGES))
def test_stage_on_odd_rows(spark, name):
    """Nulls in any column, empty and long texts, repeated rows and clashing names pass; an empty table gives an empty one."""
    docs = docs_of(spark, EDGE).withColumns({c: F.lit(f"own {c}") for c in CLASHING})
    known = {(r.doc_id, r.text) for r in docs.collect()}
    got = STAGES[name](spark, docs, SF)
    if name == "tokens":
        assert got.count() == len(EDGE) and got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    else:
        rows = got.collect()
        assert got.columns == docs.columns and {(r.doc_id, r.text) for r in rows} <= known
        assert all(r[c] == f"own {c}" for r in rows for c in CLASHING)
    assert STAGES[name](spark, docs.where("doc_id < 0"), SF).count() == 0

"""Chunked byte-level BPE against the library that reads the same file of ranks; round trips; edge cases."""

import base64
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import bpe, queries

SF = "/root/testdata/sf0.001"
PATH = P.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, ids string, row long, no long"


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(rows):
    return sorted((r.doc_id is not None, r.doc_id or 0, np.frombuffer(r.ids, "<u4").tolist()) for r in rows)


def want(library, rows):
    return sorted((i is not None, i or 0, library.encode_ordinary(t or "")) for i, t in rows)


TEXTS = [
    None, "", " ", "a", "don't we'll I'd", "<|endoftext|> x", "wörter über alles " * 40, "  \n\n\t  x  \r\n " * 30, "x" * 500, " " * 400 + "y", "日本語のテキスト" * 60, "😀é́ " * 70, "!!!??...'s" * 50,
    "'" * 200 + "re", "a1b2 " * 90, "\n" * 300 + "end\n\n\n", "word " * 3000,
]


def test_given_documents(spark, library):
    import hashlib

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.op12_bpe(spark, SF).collect()}
    assert len(got) == len(docs)
    for r in docs:
        ids = library.encode_ordinary(r.text or "")
        g = got[r.doc_id]
        assert (g.n_tokens, g.ids_sha256, g.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())


@pytest.mark.parametrize(("chunk", "overlap"), [(64, 32), (100, 20), (1000, 64)])
def test_chunks_are_in_step(spark, library, chunk, overlap):
    """Chunks far shorter than texts, overlaps shorter than pre-tokens and runs of white space; repeated rows, null ids."""
    rng = random.Random(chunk)
    parts = ["the ", " a", "\n", "  ", "\n\n", "'s", "'re", "don't", "12", "é", "日本", "!", "...", "x" * 50, " " * 45, "\t \t", "word", "'"]
    mixed = ["".join(rng.choice(parts) for _ in range(rng.randrange(400))) for _ in range(60)]
    rows = [*enumerate([*TEXTS, *mixed]), (3, "x" * 500), (3, "x" * 500), (None, "null id " * 50)]
    docs = spark.createDataFrame([(i, t, "z", 1, 2) for i, t in rows], SCHEMA)
    got = bpe.encode(docs, PATH, P.PATTERN, chunk, overlap).collect()
    assert ids_of(got) == want(library, rows)


def test_decoding_gives_the_text_back(spark):
    rows = [(i, t or "", "z", 1, 2) for i, t in enumerate(TEXTS)]
    encoded = bpe.encode(spark.createDataFrame(rows, SCHEMA), PATH, P.PATTERN, 64, 32)
    back = {r.doc_id: bytes(r.text) for r in encoded.select("doc_id", bpe.decoded("ids", PATH).alias("text")).collect()}
    assert back == {r[0]: r[1].encode() for r in rows}


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert bpe.digests(bpe.encode(docs, PATH, P.PATTERN), PATH).count() == 0


def test_workers_tables_start_anew(library, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_CHARS", 50)
    c = bpe.Codec(PATH, P.PATTERN)
    for text in ("one two three", "four five " * 30, "one two", "y" * 5000, ""):
        assert np.frombuffer(c.encode([c.pattern.findall(text)])[0], "<u4").tolist() == library.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab 'srelm\n\té1!", max_size=120), st.integers(0, 119))
def test_cutting_depends_on_what_follows_only(text, at):
    """From a beginning that the cut text and the whole share, both go on alike: the seams rest on this."""
    c = bpe.codec(PATH, P.PATTERN)
    whole, late = c.starts(text, len(text)), [at + s for s in c.starts(text[at:], len(text))]
    shared = sorted(set(whole) & set(late))
    if shared:
        assert [s for s in whole if s >= shared[0]] == [s for s in late if s >= shared[0]]
    early = c.starts(text[:at], at - bpe.AHEAD)
    assert early == [s for s in whole if s < at - bpe.AHEAD]

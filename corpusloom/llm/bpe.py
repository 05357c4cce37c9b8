"""Byte-level BPE by a file of ranks: encoding in overlapping chunks, decoding to bytes.

A pattern cuts a text into pre-tokens, each match is merged by the ranks on its own. Where a
match ends depends on the text from its start on, and on ``AHEAD`` characters after its
end at the most, never on what was before. So a text may be cut anywhere:

1. Texts longer than ``CHUNK`` become rows of ``CHUNK`` characters and ``OVERLAP`` more, dealt over the cluster.
2. Every chunk is pre-tokenised from its own first character. Its first pre-tokens may be wrong, cut by the chunk's start.
3. Chunk and next chunk share the overlap: the first place at which both begin a pre-token is where they are in step,
   and from there on they would always agree. That is the seam.
4. Pre-tokens from a chunk's seam to the next one's are encoded, in parallel; a document's pieces are put
   together in order.

A chunk that shares no such place with its neighbour (a pre-token or a run of white space longer than the overlap) is
fused with its neighbours, ``FUSED`` to one, and cut again, until all are in step; a text that is one pre-token ends as one chunk. No
pre-token is limited in length. Texts of up to ``CHUNK`` characters are one chunk, which needs no seam.

Ids are written as ``ids``: little-endian unsigned 32-bit integers. Decoding puts the
bytes of the ids one after another.

Workers keep the ids of pre-tokens met before (``KEPT`` pre-tokens, ``KEPT_CHARS`` characters; beyond, they start anew).

Cases. Null or empty text: no ids, no bytes. Repeated rows and ids stay rows each; a null doc_id
is kept. Strings that name special tokens are ordinary text. An id that the ranks don't have is an
error in decoding; null ids decode to null. An empty table gives an empty one. Other columns are
not read, whatever their names.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.token_store import Table
from corpusloom.plans.staging import stage

CHUNK, OVERLAP = 32_768, 1_024
#: Characters after its end that a match may depend on.
AHEAD = 8
FUSED = 8
#: What a worker keeps of pre-tokens met before: two workers a core run at once, one of them decoding.
KEPT, KEPT_CHARS = 200_000, 4 << 20
PIECES = "row long, no long, doc_id long, ids binary"


def ranks_of(path: str) -> dict[bytes, int]:
    """The bytes of every token, in base 64 in the file, and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Codec:
    """Pre-tokens and ids of texts by one file of ranks and one pattern."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        self.pattern = regex.compile(pattern)
        #: takes what it is given as one pre-token
        self.merge = tiktoken.Encoding("whole", pat_str=r"(?s:.+)", mergeable_ranks=ranks_of(path), special_tokens={})
        self.table = Table(self._learn)
        self.held = 0

    def _learn(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        self.held += sum(map(len, pieces))
        lists = [self.merge.encode_ordinary(p) if p else [] for p in pieces]
        return np.array([i for x in lists for i in x], np.int32), np.array([len(x) for x in lists], np.int64)

    def starts(self, text: str, high: int) -> list[int]:
        """Places before ``high`` at which a pre-token begins, the text being cut from its own start."""
        return [s for m in self.pattern.finditer(text) if (s := m.start()) < high]

    def pieces(self, text: str, start: int, end: int) -> list[str]:
        """The pre-tokens that begin at ``start``, which must be a beginning, or later, and before ``end``."""
        if start == 0 and end >= len(text):
            return self.pattern.findall(text)
        out = []
        for m in self.pattern.finditer(text, start):
            if m.start() >= end:
                break
            out.append(m[0])
        return out

    def encode(self, lists: list[list[str]]) -> list[bytes]:
        """The ids of each list of pre-tokens."""
        if not lists:
            return []
        if self.held > KEPT_CHARS or len(self.table.numbers) > KEPT:
            self.table, self.held = Table(self._learn), 0
        keys: list[str] = []
        for pieces in lists:
            keys += pieces
            keys.append("")  # no pre-token is empty: it closes a list
        ids, counts = self.table.gather(keys, "")
        raw, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends)]


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec a worker, file and pattern."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


_tokens: dict[str, dict[int, bytes]] = {}


def decode(ids: bytes, path: str) -> bytes:
    """The bytes that ids stand for."""
    if path not in _tokens:
        _tokens[path] = {rank: token for token, rank in ranks_of(path).items()}
    return b"".join(map(_tokens[path].__getitem__, np.frombuffer(ids, "<u4").tolist()))


Batches = Iterator[pa.RecordBatch]


def _whole(path: str, pattern: str) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        c = codec(path, pattern)
        for batch in batches:
            found = c.encode([c.pattern.findall(t or "") for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["doc_id", "ids"])

    return run


def _cut(chunk: int, overlap: int) -> Callable[[Batches], Batches]:
    """Rows of one chunk each; a batch goes out for every text, and for every 256 chunks of one."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for row, doc_id, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                offsets = range(0, len(text), chunk)
                for first in range(0, len(offsets), 256):
                    some = offsets[first : first + 256]
                    n = len(some)
                    columns = [pa.array([row] * n, pa.int64()), pa.array([doc_id] * n, pa.int64()), pa.array(range(first, first + n), pa.int64()), pa.array([text[o : o + chunk + overlap] for o in some]), pa.array([o + chunk + overlap >= len(text) for o in some])]
                    yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "no", "text", "closed"])

    return run


def _marked(path: str, pattern: str, chunk: int, overlap: int) -> Callable[[Batches], Batches]:
    """Beginnings of pre-tokens in what a chunk shares with the one before and the one after, counted from the shared part's start."""

    def run(batches: Batches) -> Batches:
        c, kind = codec(path, pattern), pa.list_(pa.int32())
        for batch in batches:
            heads, tails = [], []
            for no, text, closed in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                starts = c.starts(text, len(text) if closed else len(text) - AHEAD)
                heads.append([s for s in starts if s < overlap] if no else [])
                tails.append([s - chunk for s in starts if s >= chunk])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(heads, kind), pa.array(tails, kind)], names=["row", "no", "head", "tail"])

    return run


def seams(marks: DataFrame) -> DataFrame:
    """(row, no, seam): where a chunk and the one before are first in step, from the chunk's start; null where they never are."""
    before = marks.select("row", (F.col("no") + 1).alias("no"), "tail")
    both = marks.where("no > 0").select("row", "no", "head").join(before, ["row", "no"])
    return both.select("row", "no", F.array_min(F.array_intersect("head", "tail")).alias("seam"))


def fused(chunks: DataFrame, chunk: int) -> DataFrame:
    """``chunks`` of ``chunk`` characters put together, ``FUSED`` neighbours to one."""
    part = F.struct("no", "doc_id", "closed", F.left("text", F.lit(chunk)).alias("own"), "text")
    runs = chunks.groupBy("row", F.floor(F.col("no") / FUSED).alias("no")).agg(F.array_sort(F.collect_list(part)).alias("parts"))
    last = F.element_at("parts", -1)
    own = F.transform(F.slice("parts", 1, F.size("parts") - 1), lambda p: p["own"])
    # The last chunk of a document may lie in the overlap of the one before.
    return runs.select("row", last["doc_id"].alias("doc_id"), "no", F.concat(F.array_join(own, ""), last["text"]).alias("text"), F.exists("parts", lambda p: p["closed"]).alias("closed"))


def _pieces(path: str, pattern: str) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        c = codec(path, pattern)
        for batch in batches:
            texts, starts, ends = (batch.column(k).to_pylist() for k in (3, 4, 5))
            found = c.encode([c.pieces(t, a, len(t) if b is None else b) for t, a, b in zip(texts, starts, ends)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(found, pa.binary())], names=["row", "no", "doc_id", "ids"])

    return run


def _joined(batches: Batches) -> Batches:
    """A document's pieces, which come in order, as one row."""
    now, doc_id, parts = None, None, []
    row = lambda: pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), pa.array([b"".join(parts)], pa.binary())], names=["doc_id", "ids"])
    for batch in batches:
        for r, i, ids in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3))):
            if r != now:
                if now is not None:
                    yield row()
                now, doc_id, parts = r, i, []
            parts.append(ids)
    if now is not None:
        yield row()


def encode_long(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, ids) of texts that take more than one chunk."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    cut = rows.mapInArrow(_cut(chunk, overlap), "row long, doc_id long, no long, text string, closed boolean")
    chunks = stage(cut.repartition("row", "no"), "chunks")
    encoded: list[DataFrame] = []
    while True:
        marks = stage(chunks.select("row", "no", "text", "closed").mapInArrow(_marked(path, pattern, chunk, overlap), "row long, no long, head array<int>, tail array<int>"), "chunk-marks")
        found = stage(seams(marks), "seams")
        apart = found.where("seam is null").select("row").distinct()
        starts = found.select("row", "no", "seam")
        ends = found.select("row", (F.col("no") - 1).alias("no"), (F.col("seam") + chunk).alias("end"))
        whole = chunks.join(apart, "row", "left_anti") if (some := not apart.isEmpty()) else chunks
        ranged = whole.join(starts, ["row", "no"], "left").join(ends, ["row", "no"], "left")
        ready = ranged.select("row", "no", "doc_id", "text", F.coalesce("seam", F.lit(0)).alias("start"), "end")
        encoded.append(stage(ready.mapInArrow(_pieces(path, pattern), PIECES), "pieces"))
        if not some:
            break
        chunks = stage(fused(chunks.join(apart, "row", "left_semi"), chunk), "chunks")
        chunk *= FUSED
    every = encoded[0]
    for more in encoded[1:]:
        every = every.unionByName(more)
    return every.repartition("row").sortWithinPartitions("row", "no").mapInArrow(_joined, "doc_id long, ids binary")


def encode(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, ids), a row for each row of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    is_long = F.coalesce(F.length("text") > chunk, F.lit(False))
    short = docs.where(~is_long).mapInArrow(_whole(path, pattern), "doc_id long, ids binary")
    return short.unionByName(encode_long(docs.where(is_long), path, pattern, chunk, overlap))


def decoded(ids: Column | str, path: str) -> Column:
    """The bytes that ids stand for, as a column."""

    @F.pandas_udf("binary")
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda x: None if x is None else decode(x, path))

    return run(ids)


def digests(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of ``encoded``, decoded again."""
    n = (F.octet_length("ids") / 4).cast("long")
    return encoded.select("doc_id", n.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(decoded("ids", path), 256).alias("decoded_sha256"))

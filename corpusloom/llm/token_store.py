"""Token ids in ORC files: stripes, integer run-length encoding, row indexes, Bloom filters on document ids.

Documents are range-partitioned by doc_id (and by a hash of the text, so that a
repeated or missing id spreads over files too) and sorted, so that every file holds a
range of ids and the files follow each other. A file's columns are doc_id, row (the
place in the file), n_tokens and tokens (array<int>, the text's ids and the end id). ORC writes
integers run-length encoded, keeps minima and maxima for every
``row_index_stride`` rows and Bloom filters on doc_id; a reader that asks for
some ids skips the stripes and row groups that can't hold them, and tasks read
separate stripes.

Where a document starts in the whole sequence follows from counts alone: the
token column isn't read for it. Counts are summed per file, then over the files,
then within each file by its rows.

Encoding. White space other than as a separator has no effect on this kind of
tokenizer, so a text is cut at ASCII white space and words are encoded once per
worker and looked up from then on. Words of plain letters, digits and marks are
cut further, into the runs that the tokenizer itself cuts; other words are
given to the tokenizer whole. A table that
outgrows ``KEPT`` entries starts anew. When a tokenizer file is loaded, texts of all
kinds are encoded both ways; a file that cuts texts in another way is used as it is, by
the tokenizer alone.

Cases. Null or empty text: the end id only. Null doc_id: before all others.
Repeated ids stay separate rows, in the file's order: by a hash of their text, then by its
length. Very long texts are encoded whole. An empty table gives an empty store. Other
columns aren't stored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.plans.staging import bounded_batches, new_path, stage

END_ID = 1
KEPT = 700_000
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("row", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("tokens", T.ArrayType(T.IntegerType(), False))])

#: Words of ASCII and Latin-1 letters, digits and ASCII marks without apostrophe, which open contractions.
PLAIN = re.compile(r"[A-Za-z0-9À-ÖØ-öø-ÿ!-&(-/:-@\[-`{-~]+")
PLAIN_LINES = re.compile(rf"(?:{PLAIN.pattern}\n)*")
RUN = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[!-&(-/:-@\[-`{-~]+|\n")


#: Texts on which the tables must agree with the tokenizer.
_KINDS = ("the", "Straße", "ÉTÉ", "x", "12", "a1b22c", "--", "a-b_c", "(x)", "don't", "we'll", "İ", "日本", "é\u0301", "<|x", "😀", "ª²", "...", "É.1,b")
PROBES = [*_KINDS, *(f"{a}{b}" for a in _KINDS for b in _KINDS), " ".join(_KINDS), "\n".join(_KINDS), "  two \t\t gaps\r\n\x0b\x0c end ", "", "word " * 50]


class Table:
    """The ids of every key met so far; ``learn`` gives the ids of new keys, flat, and how many each has."""

    def __init__(self, learn: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]):
        self.learn = learn
        self._restart()

    def _restart(self) -> None:
        self.numbers, self.n, self.used = defaultdict(count().__next__), 0, 0  # keys are numbered in turn
        self.start, self.size, self.pool = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.int32)

    def _append(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        for name, need in (("start", self.n + len(sizes)), ("size", self.n + len(sizes)), ("pool", self.used + len(flat))):
            if need > len(old := getattr(self, name)):
                setattr(self, name, np.concatenate([old, np.zeros(max(need, len(old)), old.dtype)]))
        self.start[self.n : self.n + len(sizes)] = self.used + np.cumsum(sizes) - sizes
        self.size[self.n : self.n + len(sizes)] = sizes
        self.pool[self.used : self.used + len(flat)] = flat
        self.n += len(sizes)
        self.used += len(flat)

    def gather(self, keys: list[str], closing: str) -> tuple[np.ndarray, np.ndarray]:
        """The ids of ``keys``, flat, and how many come up to each ``closing`` key from the one before."""
        if self.n > KEPT:
            self._restart()
        found = np.fromiter(map(self.numbers.__getitem__, keys), np.int64, len(keys))
        if new := len(self.numbers) - self.n:
            self._append(*self.learn(list(islice(reversed(self.numbers), new))[::-1]))
        size = self.size[found]
        ends = np.cumsum(size)
        ids = self.pool[np.arange(ends[-1]) + np.repeat(self.start[found] - (ends - size), size)]
        return ids, np.diff(ends[found == self.numbers[closing]], prepend=0)


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([i for x in lists for i in x], np.int32), np.array([len(x) for x in lists], np.int64)


class Encoder:
    """Ids of whole texts by one tokenizer file, with tables of words and runs met before."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        letters = [chr(c) for c in range(ord("ß"), 256) if chr(c) != "÷"]
        #: how the tokenizer's byte alphabet writes the letters beyond ASCII
        self.alphabet = str.maketrans({c: "".join(p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(c)) for c in letters})
        self.plain = False
        self._restart()
        self.plain = not self._cuts_like_this()

    def _restart(self) -> None:
        self.runs = Table(self._runs)
        self.words = Table(self._words)

    def _cuts_like_this(self) -> bool:
        """Whether the tables give what the tokenizer gives, on words of all kinds alone and side by side."""
        try:
            ids, counts = self.batch(PROBES)
        except Exception:  # noqa: BLE001 - another kind of tokenizer may fail in any way here; it is then used as it is
            return False
        finally:
            self._restart()
        want = [[*self._whole(t), END_ID] for t in PROBES]
        return counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _runs(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A run is what the tokenizer hands to its model in one piece."""
        of = self.model.tokenize
        return _flat([[t.id for t in of(r if r.isascii() else r.translate(self.alphabet))] if r != "\n" else [] for r in runs])

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        plain, odd = words, []
        line = "\n".join([*words, ""])
        if "\n\n" in line or "<|" in line or not PLAIN_LINES.fullmatch(line):
            plain = [w if PLAIN.fullmatch(w) and "<|" not in w else "" for w in words]
            odd = [k for k, (w, p) in enumerate(zip(words, plain)) if w and not p]
            line = "\n".join([*plain, ""])
        flat, sizes = self.runs.gather(RUN.findall(line.lower()), "\n")
        if not odd:
            return flat, sizes
        each = np.split(flat, np.cumsum(sizes)[:-1])
        for k in odd:
            each[k] = np.array([END_ID] if words[k] == "\n" else self._whole(words[k]), np.int32)
        return np.concatenate(each), np.array([len(x) for x in each], np.int64)

    def batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in turn, number of ids of each), the end id closing each text."""
        if not texts:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        if self.plain:
            return _flat([[*self._whole(t or ""), END_ID] for t in texts])
        spaced = []
        for text in texts:
            text = text or ""
            for c in "\n\t\r\x0b\x0c":
                if c in text:
                    text = text.replace(c, " ")
            spaced.append(text)
        return self.words.gather(" \n ".join([*spaced, ""]).split(" ")[:-1], "\n")  # a line feed closes a text


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker and file, so that its tables outlive a task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _tokenized(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, row = encoder(path), 0
        for batch in batches:
            ids, counts = enc.batch(batch.column(1).to_pylist())
            ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            kind = pa.list_(pa.field("element", pa.int32(), False))
            tokens = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids), type=kind)
            rows = pa.array(np.arange(row, row + len(counts)))
            row += len(counts)
            yield pa.RecordBatch.from_arrays([batch.column(0), rows, pa.array(counts), tokens], names=SCHEMA.names)

    return run


def write(docs: DataFrame, tokenizer: str, path: str, stripe_mb: int = 64, row_index_stride: int = 10_000) -> None:
    """Encode ``docs`` and write the store, in ascending doc_id order."""
    order = ["doc_id", "h", "n"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"), F.length("text").alias("n"))
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    encoded = ranged.mapInArrow(_tokenized(tokenizer), SCHEMA)
    options = {
        "compression": "zstd",
        "orc.stripe.size": str(stripe_mb << 20),
        "orc.row.index.stride": str(row_index_stride),
        "orc.bloom.filter.columns": "doc_id",
        "orc.bloom.filter.fpp": "0.01",
    }
    with bounded_batches(docs.sparkSession, 1):
        encoded.write.options(**options).orc(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, row, n_tokens, tokens); filters on doc_id reach the row indexes and Bloom filters."""
    return spark.read.schema(SCHEMA).orc(path)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(3)
        values = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4")
        ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
        sums = [zlib.crc32(values[a:b].tobytes()) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
        names = ["doc_id", "row", "n_tokens", "ids_crc32", "file"]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(sums, pa.int64()), batch.column(4)], names=names)


def index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32), read back from the files; start counts the ids of all documents before, in the files' order."""
    rows = read(spark, path).withColumn("file", F.regexp_extract(F.input_file_name(), r"part-(\d+)", 1).cast("int"))
    schema = "doc_id long, row long, n_tokens long, ids_crc32 long, file int"
    with bounded_batches(spark):
        rows = stage(rows.mapInArrow(_sums, schema), "token-index")
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = files.select(F.col("file").alias("__file"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.join(offsets, F.col("file") == F.col("__file"))
    start = F.col("__before") + F.sum("n_tokens").over(within) - F.col("n_tokens")
    return joined.select("doc_id", start.alias("start"), "n_tokens", "ids_crc32")


def store(docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """Write ``docs`` as a store (in the shared folder if no path is given) and return its index."""
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    write(docs, tokenizer, path)
    return index(spark, path)

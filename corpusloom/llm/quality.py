"""Quality scores: random-indexing word vectors, pooled, then a two-layer network.

Word vectors. Every word has a sparse index vector (``signs`` entries of +1/-1
among ``dims``) that follows from its hash. A word's vector is the sum of the
index vectors of the words within ``window`` places of it, over all documents;
words are hashed into ``rows`` rows, so that the table has a fixed size. Each
task adds up its own documents; the tasks' blocks of rows are added up in two steps, first
by block and one of ``SALTS`` salts, then by block, so that no task reads what all
others wrote. The table (rows x dims floats, 4 MB as set) is broadcast.

Document vector. Mean and standard deviation of the unit word vectors over all
words of the text, length of the mean, and logarithm of the number of words.

Classifier. Hidden tanh layer and a logistic output, in numpy, on at most
``labelled`` labelled rows outside the held-out fold, chosen by a hash. A fifth
of them are kept from the fitting and set the temperature that divides the
output before the logistic function.

Cases. Null, empty or wordless text: pooled vectors of zeros, scored like any
other. Null labels are not learned from; several labels of an id each count. No
label, or one value only: the score is that share (0.5 without labels). Repeated
rows are scored each. A score on the threshold counts as good. Very long texts are
read whole, in pieces that end at white space. An empty table gives an empty one.
Other columns pass through; the result columns replace any of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import held_out
from corpusloom.plans.staging import bounded_batches

PIECE = 1 << 20
#: Groups of tasks whose sums are added up apart.
SALTS = 64


@dataclass(frozen=True)
class Settings:
    rows: int = 1 << 14
    dims: int = 64
    signs: int = 4
    window: int = 2
    labelled: int = 4000
    hidden: int = 24
    epochs: int = 300
    rate: float = 0.01
    decay: float = 1e-3
    threshold: float = 0.7
    seed: int = 5
    block: int = 256


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    first: np.ndarray
    first_bias: np.ndarray
    second: np.ndarray
    second_bias: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.first + self.first_bias) @ self.second + self.second_bias

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -35, 35)))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    p = 0x9E3779B97F4A7C15 | 1
    forward, back = np.full(n, p, np.uint64), np.full(n, pow(p, -1, 1 << 64), np.uint64)
    forward[0] = back[0] = 1
    return np.multiply.accumulate(forward), np.multiply.accumulate(back)


class Hasher:
    """Row numbers of the words of a UTF-8 text, by a polynomial over the bytes."""

    def __init__(self, rows: int):
        self.shift = np.uint64(64 - rows.bit_length() + 1)
        self.forward, self.back = _powers(1 << 12)

    def __call__(self, data: bytes) -> np.ndarray:
        if len(data) > len(self.forward):
            self.forward, self.back = _powers(1 << len(data).bit_length())
        a = np.frombuffer(data, np.uint8)
        inside = (a != 32) & ((a < 9) | (a > 13))
        edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        start, end = edge[::2], edge[1::2]
        total = np.cumsum((a + np.uint64(1)) * self.forward[: len(a)], dtype=np.uint64)
        before = np.where(start > 0, total[start - 1], np.uint64(0)) if len(start) else total[:0]
        h = (total[end - 1] - before) * self.back[start]
        h ^= h >> np.uint64(32)
        return (h * np.uint64(0xD6E8FEB86659FD93) >> self.shift).astype(np.int64)


def pieces(text: str | None) -> Iterator[bytes]:
    """A whole text as UTF-8 in pieces that end at white space (or at twice the size, inside a giant word)."""
    data = (text or "").encode("utf-8", "replace")
    at = 0
    while at < len(data):
        to = at + PIECE
        if to < len(data):
            cut = max(data.rfind(c, at, to) for c in (b" ", b"\n", b"\t"))
            to = cut if cut > at else to
        yield data[at:to]
        at = to


def index_vectors(s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the index vector of every row."""
    rng = np.random.default_rng(s.seed)
    return rng.integers(0, s.dims, (s.rows, s.signs)), rng.choice(np.array([-1, 1]), (s.rows, s.signs))


def _contexts(s: Settings):
    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher, (place, sign) = Hasher(s.rows), index_vectors(s)
        table = np.zeros(s.rows * s.dims)

        def add(runs: list[np.ndarray]) -> None:
            words = np.concatenate(runs)
            doc = np.repeat(np.arange(len(runs)), [len(r) for r in runs])
            for gap in range(1, s.window + 1):
                near = doc[gap:] == doc[:-gap]
                a, b = words[gap:][near], words[:-gap][near]
                for to, of in ((a, b), (b, a)):
                    for j in range(s.signs):
                        table[:] += np.bincount(to * s.dims + place[of, j], sign[of, j], s.rows * s.dims)

        runs, n = [], 0
        for pdf in batches:
            for text in pdf["t"]:
                for piece in pieces(text):
                    runs.append(hasher(piece))
                    n += len(runs[-1])
                if n > 1 << 19:
                    add(runs)
                    runs, n = [], 0
        if n:
            add(runs)
        blocks = table.reshape(-1, s.block * s.dims)
        used = np.flatnonzero(blocks.any(1))
        yield pd.DataFrame({"block": used.astype(np.int32), "sums": [blocks[k].tobytes() for k in used]})

    return add_up


def _totals(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sums: dict[int, np.ndarray] = {}
    for pdf in parts:
        for block, data in zip(pdf["block"], pdf["sums"]):
            got = np.frombuffer(data, "<f8")
            sums[block] = sums[block] + got if block in sums else got
    yield pd.DataFrame({"block": np.array(list(sums), np.int32), "sums": [v.tobytes() for v in sums.values()]})


def word_vectors(docs: DataFrame, s: Settings = Settings()) -> np.ndarray:
    """The table of unit word vectors (rows x dims), gathered from all of ``docs``."""
    parts = docs.select(F.col("text").alias("t")).mapInPandas(_contexts(s), "block int, sums binary")
    parts = parts.withColumn("salt", F.spark_partition_id() % SALTS).repartition("block", "salt")
    once = parts.select("block", "sums").mapInPandas(_totals, "block int, sums binary")
    twice = once.repartition("block").mapInPandas(_totals, "block int, sums binary")
    with bounded_batches(docs.sparkSession):
        blocks = twice.toPandas()
    table = np.zeros((s.rows // s.block, s.block * s.dims))
    for block, data in zip(blocks["block"], blocks["sums"]):
        table[block] = np.frombuffer(data, np.float64)
    table = table.reshape(s.rows, s.dims)
    norm = np.linalg.norm(table, axis=1, keepdims=True)
    return (table / np.where(norm > 0, norm, 1)).astype(np.float32)


def pool(text: str | None, hasher: Hasher, vectors: np.ndarray) -> np.ndarray:
    dims = vectors.shape[1]
    total, square, n = np.zeros(dims), np.zeros(dims), 0
    for piece in pieces(text):
        got = vectors[hasher(piece)]
        total += got.sum(0, dtype=np.float64)
        square += np.einsum("ij,ij->j", got, got)
        n += len(got)
    mean = total / max(n, 1)
    spread_ = np.sqrt(np.maximum(square / max(n, 1) - mean * mean, 0))
    return np.concatenate([mean, spread_, [np.linalg.norm(mean), np.log1p(n)]]).astype(np.float32)


def fit(x: np.ndarray, y: np.ndarray, s: Settings = Settings()) -> Network:
    """Adam over all rows at once, then the temperature with the least loss on the rows kept back."""
    d = x.shape[1] if len(x) else 2 * s.dims + 2
    if len(np.unique(y)) < 2:
        share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
        return Network(np.zeros(d), np.ones(d), np.zeros((d, 1)), np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))), 1.0)
    rng = np.random.default_rng(s.seed)
    order = rng.permutation(len(y))
    check, train = order[: len(y) // 5], order[len(y) // 5 :]
    mean, scale = x[train].mean(0), x[train].std(0) + 1e-3
    net = Network(mean, scale, rng.normal(0, 1 / np.sqrt(d), (d, s.hidden)), np.zeros(s.hidden), rng.normal(0, 1 / np.sqrt(s.hidden), s.hidden), 0.0, 1.0)
    z, t = (x[train] - mean) / scale, y[train].astype(float)
    params = [net.first, net.first_bias, net.second, np.zeros(1)]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, s.epochs + 1):
        h = np.tanh(z @ params[0] + params[1])
        out = h @ params[2] + params[3]
        err = (1 / (1 + np.exp(-out)) - t) / len(t)
        back = np.outer(err, params[2]) * (1 - h * h)
        grads = [z.T @ back + s.decay * params[0], back.sum(0), h.T @ err + s.decay * params[2], np.array([err.sum()])]
        for i, g in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            params[i] -= s.rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    net.second_bias = float(params[3][0])
    if len(check):
        out = net.logits(x[check])
        heats = np.geomspace(0.25, 8, 61)
        losses = [np.logaddexp(0, np.where(y[check] > 0, -out, out) / k).mean() for k in heats]
        net.temperature = float(heats[int(np.argmin(losses))])
    return net


def train(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, s: Settings = Settings()) -> Network:
    """Fit on at most ``labelled`` label rows outside the held-out fold; the driver gets pooled vectors only."""
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").alias("i"), F.col("quality").alias("y")).where(F.col("y").isNotNull() & F.col("i").isNotNull() & ~held_out(F.col("i")))
    drawn = known.orderBy(F.xxhash64("i"), "i", "y").limit(s.labelled)
    pooled = pooler(spark, vectors)
    rows = docs.select(F.col("doc_id").alias("d"), F.col("text").alias("t")).join(F.broadcast(drawn), F.col("d") == F.col("i"))
    with bounded_batches(spark):
        got = rows.select("i", "y", pooled("t").alias("x")).toPandas().sort_values(["i", "y"])
    x = np.stack([np.frombuffer(b, np.float32) for b in got["x"]]) if len(got) else np.zeros((0, 2 * s.dims + 2))
    return fit(x, got["y"].to_numpy(int), s)


def pooler(spark: SparkSession, vectors: np.ndarray):
    shared = spark.sparkContext.broadcast(vectors)

    @F.pandas_udf("binary")
    def pooled(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hasher = Hasher(len(shared.value))
        for texts in batches:
            yield texts.map(lambda t: pool(t, hasher, shared.value).tobytes())

    return pooled


def score(docs: DataFrame, vectors: np.ndarray, net: Network, s: Settings = Settings()) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``; only the text goes to Python."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((vectors, net))

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table, network = shared.value
        hasher = Hasher(len(table))
        for texts in batches:
            if len(texts):
                x = np.stack([pool(t, hasher, table) for t in texts])
                yield pd.Series(network.probability(x))
            else:
                yield pd.Series([], dtype=float)

    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("score", "predicted")]
    found = docs.select(*kept, scored("text").alias("score"))
    return found.withColumn("predicted", (F.col("score") >= s.threshold).cast("int"))

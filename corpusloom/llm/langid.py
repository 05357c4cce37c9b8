"""Language identification with error-correcting output codes.

Every language gets a codeword of +1/-1. One binary classifier per bit, a
logistic regression over hashed character n-grams, predicts that bit. A text is
decoded to the codeword with the least loss, each bit's logistic loss weighted
by how well its classifier did on rows kept back from fitting; a small margin to
the second codeword flags the text as ambiguous.

Cases. Null text, or a text without a letter: ``und``, score 0, not ambiguous.
A null language is never learned. No labelled row at all: every text ``und``.
One language only: every text with a letter gets it, with score 1. Repeated rows
are scored each, and learned from once. Codewords of equal loss: the first language
by name. Very long texts are read whole, in pieces of bounded size. An empty table gives
an empty one. Other columns pass through; the result columns replace any of the same name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import drawn, held_out
from corpusloom.plans.staging import bounded_batches

UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")
PIECE = 1 << 20


@dataclass(frozen=True)
class Settings:
    """What is learned from: of the ``languages`` most frequent labels ``per_language`` rows each, ``learned`` rows in all."""

    buckets: int = 4096
    per_language: int = 400
    languages: int = 500
    learned: int = 40_000
    rounds: int = 120
    rate: float = 0.05
    decay: float = 1e-4
    margin: float = 0.2
    seed: int = 11


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray
    settings: Settings = field(default_factory=Settings)


def codewords(k: int, seed: int = 11) -> np.ndarray:
    """k rows of +1/-1. Up to seven classes: every two-way split. More: the best of random codes."""
    if k < 2:
        return np.ones((k, 1), np.int8)
    if k <= 7:
        split = np.arange(1, 2 ** (k - 1))
        rows = [np.zeros(len(split), int)] + [split >> i & 1 for i in range(k - 1)]
        return np.where(np.array(rows) == 0, 1, -1).astype(np.int8)
    rng, best, found = np.random.default_rng(seed), -1, None
    bits = 10 * int(np.ceil(np.log2(k)))
    for _ in range(50):
        code = rng.choice(np.array([-1, 1], np.int8), (k, bits))
        apart = (code[:, None, :] != code[None, :, :]).sum(2) + bits * np.eye(k, dtype=int)
        varied = (np.abs(code.sum(0, dtype=int)) < k).all()
        if varied and apart.min() > best:
            best, found = apart.min(), code
    return found


def profile(text: str, buckets: int) -> np.ndarray:
    """Unit-length square-root counts of hashed character pairs and triples of the whole text."""
    counts = np.zeros(buckets)
    for at in range(0, len(text), PIECE):
        piece = text[max(0, at - 2) : at + PIECE].lower()
        c = np.frombuffer(piece.encode("utf-32-le", "replace"), np.uint32)
        c = np.where((c < 65) | ((c > 90) & (c < 97)) | ((c > 122) & (c < 192)), np.uint32(32), c)
        pair = (c[:-1] * np.uint32(40503) + c[1:]) * np.uint32(2654435769)
        triple = (pair[:-1] ^ c[2:]) * np.uint32(2246822519)
        skip = 1 if at else 0
        for grams in (pair[skip:], triple):
            counts += np.bincount(grams >> np.uint32(16) & np.uint32(buckets - 1), minlength=buckets)
    root = np.sqrt(counts)
    return (root / (np.linalg.norm(root) or 1.0)).astype(np.float32)


def fit(x: np.ndarray, labels: list[str], settings: Settings) -> Model:
    """One logistic classifier per bit, all fitted together; a fifth of the rows only weigh the bits."""
    languages = sorted(set(labels))
    code = codewords(len(languages), settings.seed)
    if len(languages) < 2:
        shape = (settings.buckets, code.shape[1])
        return Model(languages, code, np.zeros(shape, np.float32), np.zeros(shape[1]), np.ones(shape[1]), settings)
    y = code[[languages.index(v) for v in labels]].astype(np.float32)
    order = np.random.default_rng(settings.seed).permutation(len(y))
    check, train = order[: len(y) // 5], order[len(y) // 5 :]
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    m = [np.zeros_like(w), np.zeros_like(b)]
    v = [np.zeros_like(w), np.zeros_like(b)]
    xt, yt = x[train], y[train]
    for step in range(1, settings.rounds + 1):
        pull = -yt / (1 + np.exp(np.clip(yt * (xt @ w + b), -30, 30))) / len(yt)
        for i, (p, g) in enumerate(((w, xt.T @ pull + settings.decay * w), (b, pull.sum(0)))):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            p -= settings.rate * 5 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    right = ((x[check] @ w + b) * y[check] > 0).mean(0) if len(check) else np.ones(code.shape[1])
    return Model(languages, code, w, b, np.clip(2 * right - 1, 0.05, 1), settings)


def decode(model: Model, outputs: np.ndarray) -> tuple[str, float, bool]:
    """Nearest codeword by weighted loss; the score is its share of the losses' soft minimum."""
    if len(model.languages) == 1:
        return model.languages[0], 1.0, False
    loss = np.logaddexp(0, -model.code * outputs) @ model.trust / model.trust.sum()
    share = np.exp(-(loss - loss.min()) * len(model.trust))
    share /= share.sum()
    best, second = np.argsort(-share, kind="stable")[:2]
    return model.languages[best], float(share[best]), bool(share[best] - share[second] < model.settings.margin)


def predict(model: Model, text: str | None) -> tuple[str, float, bool]:
    if not text or not model.languages or not LETTER.search(text):
        return UNKNOWN, 0.0, False
    return decode(model, profile(text, model.settings.buckets) @ model.weights + model.bias)


def sample(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(l, h, t): at most ``per_language`` different rows of each language learned, those of the lowest hash of id and text.

    Rows of the held-out fold and rows without a language are left out. A share that
    follows from the language's count is drawn first, so that ranks are only given to
    about as many rows as are kept.
    """
    rows = docs.select(F.col("doc_id").alias("i"), F.col("text").alias("t"), F.col("lang").alias("l"))
    rows = rows.where(F.col("l").isNotNull() & F.col("t").isNotNull() & ~held_out(F.col("i")))
    sizes = rows.groupBy("l").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l").limit(settings.languages).collect()
    each = min(settings.per_language, max(1, settings.learned // max(len(sizes), 1)))
    shares = [x for r in sizes for x in (F.lit(r["l"]), F.lit(min(1.0, 1.2 * each / r["n"] + 40 / r["n"])))]
    share = F.coalesce(F.try_element_at(F.create_map(*shares), F.col("l")), F.lit(-1.0)) if shares else F.lit(-1.0)
    some = rows.withColumn("h", F.xxhash64(F.col("i"), F.xxhash64("t"))).where(drawn(F.col("h"), share)).dropDuplicates(["l", "h"])
    place = F.row_number().over(Window.partitionBy("l").orderBy("h"))
    return some.withColumn("place", place).where(F.col("place") <= each).select("l", "h", "t")


def train(docs: DataFrame, settings: Settings = Settings()) -> Model:
    """Fit on the rows of ``sample``. The texts stay on the executors: the driver gets one n-gram profile a row."""
    buckets = settings.buckets

    @F.pandas_udf("binary")
    def profiles(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: profile(t, buckets).tobytes())

    with bounded_batches(docs.sparkSession):
        got = sample(docs, settings).select("l", "h", profiles("t").alias("p")).toPandas().sort_values(["l", "h"])
    if not len(got):
        return Model([], codewords(0), np.zeros((settings.buckets, 1)), np.zeros(1), np.ones(1), settings)
    return fit(np.stack([np.frombuffer(p, np.float32) for p in got["p"]]), got["l"].tolist(), settings)


def scorer(spark: SparkSession, model: Model):
    """A function of a text column giving struct<lang_pred, score, ambiguous>; only the text goes to Python."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([predict(shared.value, t) for t in texts], columns=["lang_pred", "score", "ambiguous"])

    return scored


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``ambiguous``."""
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("lang_pred", "score", "ambiguous")]
    found = docs.select(*kept, scorer(docs.sparkSession, model)(F.col(text)).alias("__scored"))
    return found.select(*kept, "__scored.lang_pred", "__scored.score", "__scored.ambiguous")


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """The documents with a language: only ``und`` goes, however close the languages of a text are."""
    found = docs.withColumn("__scored", scorer(docs.sparkSession, model)(F.col("text")))
    return found.where(F.col("__scored.lang_pred") != UNKNOWN).drop("__scored")

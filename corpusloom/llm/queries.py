"""The operators and the pipeline as registered queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import bpe, common, decontam, html, langid, merkle, mixing, pii, prefix_trie, quality, rules, secrets, simhash, token_store
from corpusloom.llm.common import ascii_lower, held_out

#: File name of the tokenizer; its folder is the ``public_tokenizers`` package.
TOKENIZER = "word_bpe_49k.json"
RANKS = "byte_bpe_50k.tiktoken"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    common.configure(spark)
    return common.table(spark, sf_dir, name)


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs.select("doc_id", "text"), langid.train(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    vectors = quality.word_vectors(docs)
    network = quality.train(docs, table(spark, sf_dir, "labels"), vectors)
    found = quality.score(docs, vectors, network)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op5_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(table(spark, sf_dir, "documents"))


def op7_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return rules.judge(docs, rules.order_rules(docs))


def op8_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.store(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, pattern = tokenizer_path(RANKS), public_tokenizers.PATTERN
    return bpe.digests(bpe.encode(table(spark, sf_dir, "documents"), path, pattern), path)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the rows, by their ids, are checked as if their text had been lower-cased."""
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, merkle.leaf(text=ascii_lower(F.col("text"))))
    rows = merkle.verified(merkle.manifest(table(spark, sf_dir, "documents"), tampered))
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.proof(F.col("way")), 256).alias("proof_sha256"), "folded_root", "verified")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_langid, op2_simhash, op3_mixing, op4_quality, op5_decontam, op6_secrets, op7_rules, op8_orc_tokens, op9_html, op10_pii, op11_prefix_trie, op12_bpe, op13_merkle)
}

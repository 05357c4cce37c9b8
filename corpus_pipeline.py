"""documents -> language ID -> near-dedup -> decontamination -> mixing -> token store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import decontam, langid, mixing, simhash, token_store
from corpusloom.llm.common import configure, table
from corpusloom.llm.queries import tokenizer_path
from corpusloom.plans.staging import stage


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents without a language go.

    Null or empty texts and texts without a letter have none. Repeated rows are judged each, long texts whole. Ties
    between languages drop nothing. An empty table stays empty; other columns pass, whatever their names.
    """
    configure(spark)
    return langid.keep_identified(docs, langid.train(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: the smallest id of each component stays.

    Texts without a word are alike. Rows that repeat an id are one document; rows without an id stay. An empty
    table stays empty; other columns pass, whatever their names.
    """
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents that hold a benchmark item go.

    Null and wordless texts hold none; all rows of an id go together. Long texts are searched whole. An empty
    table, of documents or of the benchmark, drops nothing; other columns pass, whatever their names.
    """
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: the documents of the mix, those of both laps twice.

    Texts without a word are in no mix; a null source is one of its own. Equal rows are taken together. An empty
    table stays empty; other columns pass, whatever their names.
    """
    return mixing.keep_mix(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: the store's index, read back from its files.

    Null and empty texts hold the end id only; rows without an id come first, repeated ones in the files' order. An
    empty table gives an empty index; of the columns only doc_id and text are stored, whatever the others' names.
    """
    return token_store.store(docs, tokenizer_path())


STAGES = [
    ("language", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("tokens", write_tokens),
]

#: Tokens and fingerprints are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs

"""From raw documents to token ids: five stages of the training-data operators, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftlog.llm import bpe, gracehash, langid, mixing, setsketch
from siftlog.llm.queries import tokenizer_path
from siftlog.session import ship, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID learnt from the labelled rows; texts without letters, or without a language as likely as all others together, go."""
    ship(spark)
    return langid.keep_known(docs, tokenizer_path("piece_bpe_32k.model"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the greatest id stays."""
    ship(spark)
    return gracehash.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a similarity of 0.8 or more on five-word shingles the least id stays."""
    ship(spark)
    return setsketch.drop_near_duplicates(docs, k=5, threshold=(80, 100))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at weights 3, 1, 2 share one and a half times all words; a document comes at most twice."""
    ship(spark)
    return mixing.repeat_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids, with its id, source and number of tokens."""
    ship(spark)
    return bpe.token_table(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("language", language), ("exact", exact), ("near", near), ("mixing", mixed), ("tokens", tokens)]

#: SQL can express neither language ID, nor near duplicates at this size, nor the tokenizer; a brute-force test takes its place.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""The corpus pipeline: documents to mixed, tokenized training data.

Each stage reads what the one before it has written, decides over all of it, and its
decisions take effect. All but the last return the columns of documents, whatever their
names; an empty table goes through as an empty table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilspark.llm import bpe, jaccard, langid, mixing, toxicity
from veilspark.llm.common import table, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the models of all languages do not reject: null, empty and
    letterless texts go. Repeated rows and null ids are judged like others; rows with a
    null language teach nothing; all others that teach count in the limits of rejection.
    Without any row that teaches, all go."""
    return langid.keep_identified(docs, langid.train(docs, langid.is_training()))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under one half. Null labels teach nothing, conflicting ones
    count as toxic; without any toxic label nothing goes. Null texts, were there any, stay."""
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels"), toxicity.is_training()))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of near duplicates; of repeated rows
    one. Rows with a null id or text are in no class and stay."""
    return jaccard.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; repeats are rows of their own. A null
    source is a source of its own; texts without words go with their source's whole epochs."""
    return mixing.take(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row; a null or empty text has
    no tokens."""
    return bpe.digests(bpe.encode_documents(docs))


STAGES = [("language", language), ("toxicity", toxic), ("near-duplicates", near_duplicates), ("mixing", mixed), ("encoding", encoded)]
#: Language models, MinHash candidates and hash-random keys have no SQL counterpart;
#: tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

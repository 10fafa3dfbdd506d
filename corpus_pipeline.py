"""A corpus pipeline of the training-data operators, from raw documents to packed sequences.

Defined results: documents with a null, empty or letterless text go in the first
stage, as no language is recognised in them; a null lang teaches nothing; a null
source is a host of its own; rows that repeat an id are told apart by their text, and
of rows that repeat both one stays (rows with a null id count by their text); of near
copies the smallest id stays, then the text's order; an empty table passes every
stage. Extra columns stay up to packing, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.llm import langid, linededup, packing, secret_scan, simhash
from corpuscle.llm.common import cut, fold, table
from corpuscle.llm.queries import WORD_BPE


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars follows a text that has changed."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language go."""
    return langid.filter_languages(docs, langid.train(docs, fold(F.col("doc_id"), 4) != 2))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of each source go; every document stays."""
    return _counted(linededup.drop_boilerplate(docs, details=False))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash.drop_copies(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text; every document stays."""
    model = secret_scan.train(secret_scan.labelled_samples(table(spark, sf_dir, "benchmark")))
    return _counted(secret_scan.redacted(docs, model))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of 4096."""
    return packing.pack(docs, WORD_BPE).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_lines),
    ("simhash", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: A network trained by gradient descent decides in the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

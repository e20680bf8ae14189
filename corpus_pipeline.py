"""The corpus pipeline: language ID, near duplicates, secret scans, mixing and BPE, each over all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; docs are the rows the stage before left, written as
Parquet and read again. All stages but the last return the columns of documents.

In all stages an empty table gives an empty table, and further columns stay as they are, whatever their names; the docstrings tell what
becomes of nulls, empty and very long texts, ties, repeated rows and rows that share an id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reportloom.llm import bpe, jaccard, language, mixing, secrets
from reportloom.llm.common import removed, written


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text is in one of the languages of the corpus; rows without letters (null and empty texts too) or in no known
    language go. A null lang or source is a value of its own. Equal rows stay or go together, rows of one id by their own texts;
    without any labelled row all stay. Long texts are read whole."""
    return language.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts with five-word similarity of 0.8 or more: that of the least id, and of rows that share
    it that of the least hash of its text. Texts without words and rows without an id stay; rows of one id with unlike texts are
    different documents; of rows that repeat id and text one stays."""
    return jaccard.one_of_each(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by their kind in brackets; n_chars follows, unless it is null. Null and empty texts stay as
    they are, as does every row; equal texts are changed alike, long ones throughout."""
    return secrets.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of the sources takes it. Null and empty texts have no words and aren't taken; a null source is
    one of its own; equal rows stand at one place of the order and are taken alike."""
    return mixing.mixed(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the token ids (packed little-endian unsigned 32-bit), their count, and the digest of the decoded text, for each row; a null
    text is the empty text, which has no tokens."""
    ids = bpe.encode_decode(docs)
    return ids.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", known_language),
    ("ngram_jaccard", near_duplicates),
    ("secret_scans", without_secrets),
    ("mixing", mixed),
    ("bpe", encoded),
]

#: SQL cannot express trained language models, redaction by linked spans or BPE merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        kept = written(stage(spark, docs, sf_dir), f"stage-{name}")
        if k:
            removed(docs)  # what the stage before left is read no more
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)

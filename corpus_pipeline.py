"""A corpus pipeline: from raw documents to packed training sequences.

Defined results of every stage: a null or empty text is no toxic text, no copy, holds no benchmark passage and no
secret, and packs as its end id; null in any other column is kept; a text or word of any length is handled whole; rows that repeat
a doc_id and its text are one document from the n-gram stage on, and rows with a null doc_id all stay; columns beyond those of
documents, however they are called, are kept by all stages but the last; an empty table gives an empty table.

STAGES lists (name, function). A function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read again as the next stage's docs. All
stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import fold, materialize, table
from tessera.llm.decontamination import decontaminate
from tessera.llm.ngram_join import keep_one_per_component
from tessera.llm.packing import pack_documents
from tessera.llm.queries import tokenizer_path
from tessera.llm.secrets import redact_secrets
from tessera.llm.toxicity import fit_toxicity, score_with


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.3 or more go; labels of fold 2 of 4 are not used. Without toxic labels none goes; equal texts go or stay together."""
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 4) != 2)
    return score_with(docs, model).filter(F.col("toxicity_score") < 0.3).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the document with the smallest doc_id stays; ties can't occur, as rows that repeat a doc_id and text are one."""
    return keep_one_per_component(docs, n=5, percent=75)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage of ten words or a whole shorter item go; with an empty benchmark none goes."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), window=10)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text, and n_chars follows where it is not null; every document stays."""
    return redact_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in sequences of 2048 tokens; pieces of equal length are ranked by a hash, then by doc_id and piece."""
    return pack_documents(docs, tokenizer_path("byte_bpe_50k.json"), end_id=0, capacity=2048)[1]


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_scan", mask_secrets),
    ("best_fit_packing", pack),
]

#: Tokenizing and the similarity join have no SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

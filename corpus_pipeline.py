"""Corpus pipeline: documents to packed training sequences in five stages.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept and returns a
DataFrame; it is written as Parquet and read again before the next. All but the last
return the columns of ``documents``.

1. toxicity: documents the toxicity model rejects go.
2. near_duplicates: of each group of linked documents the one of the least id stays.
3. secrets: every secret in a text is replaced by its kind; no document goes.
4. mixing: sources are mixed to their target weights, in training order; a document
   taken twice is two rows, the last one taken of a source may be cut.
5. packing: pieces of the documents' token ids, placed in sequences of 4096.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revspark.llm import mixing, near_dup, packing, secrets, toxicity
from revspark.llm.common import read_table, staged
from revspark.llm.queries import tokenizer_path
from revspark.session import checkpoint_dir, worker_path

#: No SQL engine reproduces the fitted model, the entropy windows or the tokenizer.
ORACLE_SQL = None


def _ready(spark: SparkSession) -> None:
    checkpoint_dir(spark)
    worker_path(spark)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    return toxicity.reject_toxic(docs, read_table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    return near_dup.keep_one_per_group(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    return secrets.redact_secrets(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    pieces = packing.cut_documents(docs, tokenizer_path())
    pieces = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.place_pieces(pieces).select("doc_id", "start", "length", "ids_crc32", "doc_tokens",
                                               "sequence_id", "offset")


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("secrets", secret_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each result is written and read again."""
    _ready(spark)
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""The corpus pipeline: from documents to packed training sequences, in five stages.

Each stage takes what the one before it kept, as a table that was written and
read again, and its decisions take effect. All but the last return the columns of
documents. Nulls, empty texts, repeated rows and empty tables are treated as the
operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glintframe.llm import dedup, mixing, ngram_join, packing, queries, toxicity
from glintframe.llm.common import written


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents whose restored text has a toxicity score of 0.7 or more;
    the model is fitted on these documents and the table labels."""
    return toxicity.clean_rows(docs, queries.toxicity_model(spark, docs, sf_dir))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, the one with the largest id."""
    return dedup.exact_dedup(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 in shingles of five words, over
    any number of links, the one with the smallest id."""
    return ngram_join.one_of_each(docs, width=5, num=80, den=100)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mix_rows(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of 2048 tokens at most."""
    return packing.pack(docs, queries.tokenizer())


STAGES = [
    ("toxicity", without_toxic),
    ("exact dedup", without_copies),
    ("n-gram Jaccard join", without_near_copies),
    ("mixing", mixed),
    ("best-fit packing", packed),
]

#: Scores, rounding by hashed coins and token ids have no SQL: see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, name.replace(" ", "-"))
    return docs

"""A corpus pipeline from the operators of playwatch.llm: each stage takes what the one before it kept.

Quality rules and near duplicates decide on documents, line dedup on lines, mixing on repetitions; the last stage encodes. Stages
look columns up by name and return the columns of documents; text and n_chars change where lines go.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playwatch.llm.common import written
from playwatch.llm.line_dedup import without_dropped_lines
from playwatch.llm.mixing import mixed_documents
from playwatch.llm.near_dup import first_of_classes
from playwatch.llm.quality import kept_documents
from playwatch.llm.queries import table
from playwatch.llm.word_bpe import word_bpe


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and their host's verdict keep."""
    return kept_documents(docs, host="source", max_rate=0.5)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that stand in five documents or more, but for the largest doc_id's."""
    kept = without_dropped_lines(docs, least_chars=40, least_docs=5)
    return kept.withColumn("n_chars", F.length("text").cast("long"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of every class of near duplicates."""
    return first_of_classes(docs, threshold=0.8)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    return mixed_documents(docs, weights=(5, 2, 1), of_total=1.5, max_epochs=2.0)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document, repeated as it is."""
    return word_bpe(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality rules", quality), ("line dedup", lines), ("near duplicates", near), ("mixing", mix), ("bpe", bpe)]

#: SQL expresses neither MinHash classes nor BPE; tests hold each stage, on what the one before kept, against SQL or brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        # each stage reads its documents more than once
        docs = written(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)

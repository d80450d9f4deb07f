"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playwatch.llm.ann import nearest
from playwatch.llm.common import shared_dir
from playwatch.llm.conversation_repair import damaged, repairs
from playwatch.llm.decontaminate import contamination, contamination_digests
from playwatch.llm.line_dedup import line_digests
from playwatch.llm.mixing import mixed
from playwatch.llm.near_dup import near_duplicates
from playwatch.llm.periodic import periodic_runs, run_digests, with_planted_periods
from playwatch.llm.quality import quality_verdicts
from playwatch.llm.repeats import without_repeats
from playwatch.llm.token_count import token_counts
from playwatch.llm.token_output import read_tokens, write_tokens
from playwatch.llm.toxicity import toxicity
from playwatch.llm.word_bpe import word_bpe


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2, out=out)
    return read_tokens(spark, out)


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), threshold=0.8)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixed(table(spark, sf_dir, "documents"), weights=(5, 2, 1), of_total=1.5, max_epochs=2.0)
    return mix.select("doc_id", "size", "source_size", "target", "taken")


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), every=100, k=10)


def op5_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_bpe(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_digests(table(spark, sf_dir, "documents"), least_chars=40, least_docs=5)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = quality_verdicts(table(spark, sf_dir, "documents"), host="source", max_rate=0.5)
    return verdicts.drop("host_rate")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.7)


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"), length=200)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repairs(damaged(table(spark, sf_dir, "conversations")), present=F.col("present"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_digests(contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=10))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(periodic_runs(with_planted_periods(table(spark, sf_dir, "documents")), least=24, repeats=3))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    chosen = (op1_token_output, op2_near_duplicates, op3_mixing, op4_nearest, op5_word_bpe, op6_line_dedup, op7_token_counts, op8_quality, op9_toxicity, op10_repeats,
              op11_conversation_repair, op12_decontamination, op13_periodic_runs)
    return {f.__name__: f for f in chosen}

"""The corpus pipeline: five stages, each one of the operators over all that its predecessor kept.

1. quality rules: documents that the policy rejects go;
2. n-gram Jaccard join (five words, similarity 0.8): one document of each group stays;
3. personal data: found spans are replaced in the text;
4. mixing sources: documents are used as often as their source's target weight says, each once at least;
5. packing: a row for each piece of a document in a sequence of at most 1024 tokens.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from feedsieve.llm import mixing, ngram_join, packing, pii, quality
from feedsieve.llm.common import shared_folder
from feedsieve.llm.queries import tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs, 5, 80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs, entropy=0.9, max_repeats=4.0, cover=True, exponents=(0.0, 1.0))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", near_duplicates),
    ("personal_data", personal_data),
    ("source_mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The pieces depend on a tokenizer file and on packing order, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what a stage returns is written as Parquet and read again by the next one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_folder(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs

"""The corpus pipeline: toxicity, near copies, benchmark leaks, secrets, tokens.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept, and its decisions take effect. All but the last
return the columns of the documents; the last adds the tokens. What a stage returns is written as Parquet in the cluster's shared
folder and read again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fairtag.llm import bpe, decontaminate, near_dup as copies, secrets as keys, toxicity as tox
from fairtag.llm.tables import written


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; the model learns from the labelled ones among ``docs``."""
    return tox.without_toxic(docs, tox.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_dup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: sets of five words, of which 0.8 or more are shared (op5 takes two words)."""
    return copies.representatives(docs, copies.NearDup(shingle=5))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mask; the documents stay."""
    return keys.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every text with its token ids, their number, and whether they decode to the text."""
    import public_tokenizers

    return bpe.tokenize(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxicity), ("near_dup", near_dup), ("decontamination", decontamination), ("secrets", secrets), ("tokens", tokens),
]
#: Trees, latent vectors and token ids cannot be written in SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs

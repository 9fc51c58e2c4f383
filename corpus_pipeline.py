"""A corpus, from raw documents to packed training sequences.

Every stage takes (spark, docs, folder of the tables) and returns a DataFrame;
it is written as Parquet and read again as the next stage's ``docs``.  All
stages but the last keep the columns of ``documents``.

In every stage a null text counts as empty, very long texts are read whole, ties
are settled by id and then by content, an empty table gives an empty one, and
further columns pass through all stages but the last, whatever their names.
Repeated rows fare alike in every stage but near copies, where one of them stays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloom.llm import decontaminate, packing, secrets, simhash, toxicity
from deltaloom.llm.scratch import Scratch


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents at or over their language's toxicity threshold go; empty texts and null ids are scored like any."""
    net = toxicity.fit_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs, net)
    return scored.filter(F.col(toxicity.SCORE) < toxicity.threshold_of(net)).select(docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies stays, the one with the smallest id; null ids come last, all empty texts are one group."""
    return simhash.drop_copies(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, within its edit budget, go; empty texts and an empty benchmark match nothing."""
    return decontaminate.drop_matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts give way to ``[kind]``; no document goes; null and empty texts stay as they are."""
    return secrets.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with the sequence and offset that each is packed into."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("secret_scan", secret_stage),
    ("packing", packing_stage),
]

#: SQL has neither the classifier nor the fingerprints; the tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), f"{k}_{name}")
    return docs

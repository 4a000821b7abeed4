"""A corpus pipeline of the operators in cosmotab.llm: each stage's rows are written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cosmotab.llm import common, stages

#: In order: each function takes (spark, docs, sf_dir); all but the last return the columns of documents.
STAGES = [
    ("language_id", stages.language_id),
    ("line_dedup", stages.line_dedup),
    ("near_dedup", stages.near_dedup),
    ("decontamination", stages.decontamination),
    ("bpe", stages.bpe_encoding),
]

#: SQL can't express the stages; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the table documents. Once they are written, cosmotab.sources.shared.remove_stored(spark)
    removes what the stages have stored."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.written(docs)
    return docs

"""Stages of the corpus pipeline: (spark, docs, sf_dir) -> DataFrame; all but the last keep the columns of docs.

In all of them columns of docs may have any names beside doc_id, text and lang, texts any length, and an empty table
gives an empty one. Repeated rows fare alike: all of them stay or all go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cosmotab.llm import bpe, decontam, langid, lines, minhash
from cosmotab.llm.queries import tokenizer_path

#: Documents whose language is less sure than this are rejected, with those that have no letters.
MIN_LANGUAGE_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with an identified language; null, empty and letterless texts go. The model learns from the non-null
    lang of docs; the id is no input, so null ids fare like others. A tie goes to the first language, and stays under the
    least score with more than three."""
    found = langid.identify(docs, langid.fit(docs))
    return found.filter((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= MIN_LANGUAGE_SCORE)).select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the runs of lines that stand earlier too; one of which nothing is left goes. Null and empty texts
    stay as they are; null ids come first; of equal runs in one order of id and place the first stays."""
    found = lines.dedup_lines(docs)
    found = found.filter((F.col("n_removed") == 0) | (F.trim(F.translate("new_text", "\n\t\r", "   ")) != ""))
    return found.select(*[F.col("new_text").alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8 or more), the smallest id. Rows of
    one id with different texts are judged each by its own; null ids, and null, empty or blank texts, are in no group and
    stay."""
    found = minhash.near_duplicates(docs.select("doc_id", "text"))
    gone = found.filter(~F.col("doc").eqNullSafe(F.col("component"))).select(F.col("doc").alias("_doc"), F.col("text_hash").alias("_hash")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_of"))
    return rows.join(gone, (F.col("_id") == F.col("_doc")) & (F.col("_of") == F.col("_hash")), "left_anti").select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that aren't contaminated by the benchmark. Null and empty texts have no words and stay; ids don't
    matter; a benchmark item may occur any number of times (ties)."""
    found = decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.filter(~decontam.is_contaminated()).select("row.*")


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text for each document: doc_id (null stays null), n_tokens, ids_sha256,
    decoded_sha256. Null and empty texts have no tokens."""
    found = bpe.encode_decode(docs.select("doc_id", "text"), tokenizer_path(), carry=["doc_id"], digests=True)
    return found.select("row.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")

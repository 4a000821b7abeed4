"""The registered queries of the numbered operators: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cosmotab.llm import align, ann, audit, bpe, chat, common, decontam, fingerprints, langid, lines, minhash, pii, toxicity, unigram

TOKENIZER = "byte_bpe_50k.json"
#: Its pieces are the unigram vocabulary; their log probabilities are those of the documents.
PIECES = "piece_bpe_32k.model"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.perspectives(table(spark, sf_dir, "conversations"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = minhash.near_duplicates(docs, k=3, num=85, den=100)
    return found.select(F.col("doc").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), F.col("doc").eqNullSafe(F.col("component")).alias("kept"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = lines.dedup_lines(docs)
    ranges = F.array_join(F.transform("removed", lambda r: F.concat(r["i"].cast("string"), F.lit("-"), r["j"].cast("string"))), ",")
    return found.select("row.doc_id", "n_lines", "n_removed", ranges.alias("removed_lines"), F.col("new_text").alias("text"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = unigram.count_tokens(docs, unigram.estimate(docs, tokenizer_path(PIECES)), carry=["doc_id"])
    return found.select("row.doc_id", "n_words", "n_tokens", F.round("score", 6).alias("score"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labelled = spark.createDataFrame(pii.labelled_rows(), "text string, spans array<struct<start: int, end: int>>")
    found = pii.find(docs, pii.fit(labelled), carry=["doc_id"])
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("row.doc_id", *[count(k).alias(f"n_{k}") for k in pii.KINDS], F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.filter(~common.held_out(F.col("doc_id"))))
    found = langid.identify(docs.select("doc_id", "text"), model, carry=["doc_id"])
    return found.select("row.doc_id", common.held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score")


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = bpe.encode_decode(docs, tokenizer_path(), carry=["doc_id"], digests=True)
    return found.select("row.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(~common.held_out(F.col("doc_id")))
    found = toxicity.score(docs, toxicity.fit(docs, labels), carry=["doc_id"])
    return found.select("row.doc_id", common.held_out(F.col("row.doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "hits")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    return found.select(
        "row.doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        decontam.is_contaminated().alias("contaminated"),
    )


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = align.align(docs, tokenizer_path(), tokenizer_path(PIECES), carry=["doc_id"], digests=True)
    return found.select("row.doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints.compare_with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.withColumnRenamed("id", "doc_id")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    cells, letters = audit.mask_cells(docs, table(spark, sf_dir, "labels"))
    return audit.interactions(common.written(cells), letters)


QUERIES = {
    f.__name__: f
    for f in (
        op1_chat_perspectives, op2_minhash, op3_line_dedup, op4_token_counts, op5_pii, op6_language_id, op7_nearest_neighbours, op8_bpe, op9_toxicity, op10_decontamination,
        op11_alignment, op12_fingerprints, op13_filter_audit,
    )
}

#: The others can't be written as SQL; tests hold them against brute force, public libraries or held-out rows.
ORACLE_SQL: dict[str, str] = {"op1_chat_perspectives": chat.SQL, "op13_filter_audit": audit.SQL}

"""The registered queries over the given tables, with the settings meant for production."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from gleaner.llm import sql
from gleaner.llm.aligned import alignments
from gleaner.llm.chat import formatted, read_back
from gleaner.llm.common import table
from gleaner.llm.decontam import contamination, hit_words
from gleaner.llm.flatgraph import near_vectors
from gleaner.llm.hardneg import hard_negatives
from gleaner.llm.minhash import near_duplicates
from gleaner.llm.mixing import mixture
from gleaner.llm.pii import personal_data, personal_digest
from gleaner.llm.quality import fit_quality
from gleaner.llm.ownership import secret_digest, secret_spans
from gleaner.llm.tokens import token_counts
from gleaner.llm.toxicity import fit_toxicity
from gleaner.llm.wordbpe import decoded, encoded, encoding_digest


def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every document under the 32k piece vocabulary."""
    return token_counts(table(spark, folder, "documents"),
                        public_tokenizers.path("piece_bpe_32k.model"))


def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark windows of 10 words in every document."""
    found = contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", hit_words().alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("items") > 0).alias("contaminated"))


def op2_proximity(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark items of which every document holds an altered window only."""
    found = contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", F.size("near_items").cast("bigint").alias("n_near"), "near_items")


def op3_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets in every document, live or widely copied."""
    return secret_digest(secret_spans(table(spark, folder, "documents")))


def op4_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return near_duplicates(table(spark, folder, "documents"))


def op5_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in every document."""
    return personal_digest(personal_data(table(spark, folder, "documents")))


def op6_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation, and one whose texts hold the template's own marks, read back."""
    hard = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)],
                                 "conv_id bigint, turn bigint, role string, text string")
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return read_back(formatted(rows.unionByName(more))).drop("n_rewrites")


def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """How often the mix takes each document."""
    return mixture(table(spark, folder, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every document, and whether it is kept."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = fit_quality(docs, labels.select("doc_id", labels["quality"].alias("label")))
    return model.score(docs).select(
        "doc_id", "q_score", "q_text", "q_meta", (F.col("q_score") >= 0.5).alias("kept"))


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document. Documents held out are never learned from."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    model = fit_toxicity(docs, labels.filter(~held).select("doc_id", labels["toxic"].alias("label")))
    return model.score(docs, "doc_id").select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_vector_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Links and components of every embedding."""
    return near_vectors(table(spark, folder, "embeddings")).select(
        "vec_id", "n_links", "component_id", "kept")


def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives for every hundredth embedding; every seventh has another label."""
    vectors = table(spark, folder, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.select("vec_id", label.alias("label"), "embedding"), F.col("vec_id") % 100 == 0)


def op12_bpe_codec(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every document under the 49k word vocabulary, and their decoding."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return encoding_digest(decoded(encoded(table(spark, folder, "documents"), path), path))


def op13_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Groups and links between the tokens of two vocabularies in every document."""
    return alignments(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                      public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_decontamination, op2_proximity,
                                  op3_secret_scan, op4_near_duplicates, op5_personal_data,
                                  op6_chat_format, op7_mixing, op8_quality, op9_toxicity,
                                  op10_vector_duplicates, op11_hard_negatives, op12_bpe_codec,
                                  op13_token_alignment)}
QUERIES["pipeline"] = corpus_pipeline.run
EXPECTED = {"op2_decontamination": sql.OP2, "op6_chat_format": sql.OP6, "op7_mixing": sql.OP7,
            "op10_vector_duplicates": sql.OP10, "op11_hard_negatives": sql.OP11}

"""The queries over the tables of a folder, one per operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wearline.llm import merkle, mixing, near, passages, pieces, quality, secrets, suffix_tree, toxicity, transducer, vectors, whitening, wrappers
from wearline.llm.session import table


def op1_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def op2_page_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract(table(spark, sf_dir, "pages"))


def op3_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.schedule(table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    return found.withColumn("value_hash", F.sha2("value", 256)).drop("value")


def op5_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.line_quality(table(spark, sf_dir, "documents")).drop("clean_text")


def op6_nearest_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_pca_tiled_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op8_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score_texts(table(spark, sf_dir, "documents"))


def piece_model() -> str:
    """The public BPE model's file; another path may be given to the operator."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.encode(docs, piece_model(), verify="round_trip").drop("text")


def op10_ngram_jaccard_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_groups(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.document_proofs(table(spark, sf_dir, "documents")).drop("lang", "path")


def word_tokenizer() -> str:
    """The public word BPE tokenizer's file; another path may be given to the operator."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = transducer.count_tokens(docs, word_tokenizer())
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return counted.select("doc_id", size.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_repeated_passages": op1_repeated_passages,
    "op2_page_wrappers": op2_page_wrappers,
    "op3_pfair_mix": op3_pfair_mix,
    "op4_secret_scan": op4_secret_scan,
    "op5_line_quality": op5_line_quality,
    "op6_nearest_toxicity": op6_nearest_toxicity,
    "op7_pca_tiled_cosine": op7_pca_tiled_cosine,
    "op8_suffix_tree_scores": op8_suffix_tree_scores,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_ngram_jaccard_groups": op10_ngram_jaccard_groups,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_token_counts": op12_token_counts,
    "op13_embedding_whitening": op13_embedding_whitening,
}

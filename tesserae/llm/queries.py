"""The registered queries of the text operators: each derives its digest from the operator's own output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import bitslices, divergence, hmm, language, merkle, neighbours, oracles, packing, pieces, resampling, simhash, suffixes, urls, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.judge(table(spark, sf_dir, "documents"))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"))


def op3_link_graph_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op4_sentencepiece_unigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest(pieces.encode(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model")))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary())


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_string_kernel_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, docs.where(~language.held_out())).select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def op8_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_hidden_markov_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 5 == 1)


def op11_bit_sliced_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitslices.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified(merkle.proofs(table(spark, sf_dir, "documents")))


def op13_exact_scatter_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_distribution_divergence, op2_suffix_array_dedup, op3_link_graph_urls, op4_sentencepiece_unigram, op5_best_fit_packing, op6_simhash_near_dedup, op7_string_kernel_language,
        op8_inverted_multi_index, op9_importance_resampling, op10_hidden_markov_scoring, op11_bit_sliced_top_k, op12_merkle_manifest, op13_exact_scatter_whitening,
    )
}

#: Of the operators that SQL can express over whole tables; the others are held against brute force in tests/llm.
ORACLE_SQL: dict[str, str] = dict(oracles.ORACLE_SQL)

"""Documents to packed training sequences: quality, language, near-duplicates, repeated passages, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import language, packing, queries, resampling, simhash, suffixes
from tesserae.llm.common import settle

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents whose language is predicted with less certainty go: those that the best one-versus-rest classifier hardly tells from the others.
MIN_LANGUAGE_SCORE = 0.55


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Importance resampling towards documents labelled good; those not sampled go."""
    return resampling.classify(docs, queries.table(spark, sf_dir, "labels"), COLUMNS).where("kept").select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any letter, or in no language that the classifier is sure of, go."""
    found = language.identify(docs, docs.where(~language.held_out()), COLUMNS)
    return found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE)).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (SimHash candidates, five-word Jaccard similarity of 0.8 or more), the document with the smallest doc_id stays.

    Of several rows of that doc_id the one with the smallest text, lang, source and n_chars (null last) stays; rows without a doc_id stay by themselves.
    """
    known = docs.where("doc_id is not null").select(*COLUMNS)
    stay = simhash.similar_documents(known).where("doc_id = component_id").select("doc_id").distinct()
    rest = [F.col(c) for c in COLUMNS if c != "doc_id"]
    ranked = F.struct(*(x for c in rest for x in (c.isNull(), c)))
    kept = known.join(stay, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*rest), ranked).alias("row")).select("doc_id", "row.*")
    return kept.unionByName(docs.where("doc_id is null").select(*COLUMNS)).select(*COLUMNS)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand in an earlier document are cut out of the text; bytes left of a character cut in two are dropped, and a text of which nothing is left goes."""
    cut = suffixes.remove_repeats(docs.select(*COLUMNS), keep=COLUMNS, kept="string")
    return cut.where("n_bytes = 0 or n_removed < n_bytes").select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, placed in sequences."""
    return packing.pack_documents(docs, queries.vocabulary())


STAGES = [("quality classifier", quality), ("language ID", language_id), ("SimHash near-dedup", near_dedup), ("suffix-array dedup", suffix_dedup), ("best-fit packing", pack)]
#: SQL cannot express these stages; tests/llm holds run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; what each returns is written and read again."""
    docs = queries.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs, _ = settle(docs)
    return docs

"""From documents to token ids: five stages, each on all that the one before it kept.

For every stage: repeated rows are rows like others; an empty table gives an empty one; columns
besides doc_id, text, source and lang pass through, whatever their names, and the first four stages
return the very columns that they got.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.llm import decontamination, near_dedup, quality_classifier, secret_scan, sentencepiece_codec
from tallyline.session import deleted, let_workers_import, scratch, table, temporary_tables


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject as low quality or toxic.

    A null or empty text is judged by its shape and its site; null sources and languages are sites of their own.
    """
    let_workers_import(spark)
    return quality_classifier.classified(docs, table(spark, sf_dir, "labels")).where("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: shingles of five words, similarity of 0.8.

    The least doc_id of a group stays, of repeated rows of it one; rows without an id stay where all
    of their group are so; null and empty texts are like no other and all stay.
    """
    let_workers_import(spark)
    return near_dedup.deduplicated(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; a null or empty text has none and stays."""
    let_workers_import(spark)
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark and n_chars, where it is there, counted anew; a null text stays null."""
    return secret_scan.redacted(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document in place of its text, and whether they decode to it again; a null text counts as empty.

    Columns n_tokens, ids, decoded and round_trip are replaced, text and n_chars go, all others stay.
    """
    let_workers_import(spark)
    out = sentencepiece_codec.encoded(docs.drop("n_chars", "round_trip"), sentencepiece_codec.model_path())
    whole = F.coalesce(F.col("decoded") == F.coalesce("text", F.lit("")), F.lit(False))
    return out.withColumn("round_trip", whole).drop("text", "decoded")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("secrets", secrets), ("tokens", tokens)]

#: Learnt weights, minwise trees and merges have no SQL; tests/llm holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage wrote for itself, and the documents that it read, go when its own are written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch(spark, name)
        with temporary_tables(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            deleted(spark, before)
        before = path
    return docs

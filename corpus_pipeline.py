"""A training corpus from raw documents in five stages; each works on all that the stage before it kept.

language: what has no letters, or few n-grams of any one language, goes. near_duplicates: of each group of linked
documents the one with the smallest doc_id stays. passages: repeated passages stay in their first document only.
decontamination: spans of test items go, and documents that consist of them for the most part. packing: pieces of at
most 2048 tokens in sequences. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandlake.llm import common, decontaminate, jaccard, langid, packing, passages

#: at least this share of a text's n-grams must stand in its language's filter, however many languages there are
LEAST_RATE = 0.1


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    into = common.fresh(docs.columns, "predicted")
    told = langid.predict(docs, langid.fit(langid.training_rows(docs)), into)
    return told.where(f"`{into}`.lang <> 'und' and `{into}`.rate >= {LEAST_RATE}").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    copies = common.cut(jaccard.similar_components(docs).where("doc_id <> component_id").select("doc_id").distinct(), "copies")
    sent = common.id_filter(copies)
    # only documents that may be copies are shuffled
    return common.passing(docs, "doc_id", sent, inside=False).unionByName(common.passing(docs, "doc_id", sent).join(copies, "doc_id", "left_anti").select(docs.columns))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return passages.without_passages(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("passages", repeated_passages), ("decontamination", decontamination), ("packing", pack)]

#: the stages are not expressible in SQL; tests hold them against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, common.cut(stage(spark, docs, sf_dir), name)
        common.drop(before)
    return docs

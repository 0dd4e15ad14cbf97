"""The corpus pipeline: five stages, each on all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents.  Results are written as Parquet in the shared folder and reread, so
each stage starts from stored data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.llm import decontaminate, jaccard, langid, packing, quality
from keystrata.llm.store import Scratch

#: A document goes if no language is found, or if the mean probability of the best one is lower than this.
LEAST_LANGUAGE_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language; learnt from the documents at hand that the fold doesn't hold out."""
    model, classes = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    return langid.identified(docs, model, classes, LEAST_LANGUAGE_SCORE)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose quality score is under the classifier's threshold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~quality.held_out(F.col("doc_id"))).select("doc_id", F.col("quality").alias("label"))
    model = quality.train(docs.select("doc_id", "text"), labels)
    return quality.accepted(docs, model)


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a key for each row, and the key's name: a hash of doc_id and text, as ids may be null or repeated."""
    key = "row_key"
    while key in docs.columns:
        key += "_"
    return docs.withColumn(key, F.xxhash64("doc_id", "text")), key


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of every group of near-duplicates, and one row of equal ones (id and text)."""
    rows, key = keyed(docs)
    scratch = Scratch(spark, "near-duplicates")
    c = scratch.table(jaccard.jaccard_components(rows.select(F.col(key).alias("doc_id"), "text")).select("doc_id", "component_id"), "components")
    others = scratch.table(c.where("component_id <> doc_id").select("doc_id"), "others")
    repeated = scratch.table(c.where("component_id = doc_id").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    return jaccard.once(jaccard.without(rows, others, key), repeated, key).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    rows, key = keyed(docs)
    found = decontaminate.leaks(rows.select(F.col(key).alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return jaccard.without(rows, Scratch(spark, "decontamination").table(found.select("doc_id").distinct(), "leaks"), key).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing into sequences: the place of every piece of every document."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language),
    ("quality", quality_filter),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: Trained models and packing aren't expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, scratch.table(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(before)  # what a stage has read nothing reads again
    return STAGES[-1][1](spark, docs, sf_dir)

"""The corpus pipeline: quality classifier, exact dedup, near-dedup, source mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lamella.llm.exact_dedup import drop_copies
from lamella.llm.mixing import mixed_documents
from lamella.llm.packing import packed
from lamella.llm.quality import good_documents
from lamella.llm.simhash import drop_similar
from lamella.plans.session import forget, saved


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_similar(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed(docs)


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("simhash near-dedup", near), ("source mixing", mixing), ("best-fit packing", packing)]

#: The language model and the tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and reread by the next.

    Null and empty texts have no perplexity and pass the classifier; they are one text to exact dedup, of which one row stays.
    Null ids come last where an id decides. Rows that repeat in all columns count once from exact dedup on. Columns beside those
    of documents, whatever their names, go along up to the last stage. An empty table gives no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs, f"pipeline-{k}")
            if k:
                forget(before)
    return docs

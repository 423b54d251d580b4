"""The corpus pipeline: each stage works on what its predecessor kept, written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import shared_folder
from brindle.llm.decontaminate import clean_documents
from brindle.llm.near_dedup import distinct_documents
from brindle.llm.packing import best_fit_pack
from brindle.llm.pii import find_pii, redacted
from brindle.llm.quality import good_documents

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the learned list rejects go."""
    return good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates one row stays, of the least doc_id."""
    return distinct_documents(docs.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets; n_chars follows."""
    spans = find_pii(docs, keep_text=True, carry=["lang", "source"])
    clean = spans.select("doc_id", redacted(F.col("text"), F.col("spans")).alias("text"), "carried.lang", "carried.source")
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of token ids: one row a piece."""
    return best_fit_pack(docs)


STAGES = [("quality rules", quality_rules), ("near dedup", near_dedup), ("decontamination", decontamination), ("pii", pii), ("packing", packing)]

#: Learned rules, signatures and tokenizers have no SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_folder(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs

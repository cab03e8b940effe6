"""From raw documents to packed sequences, in stages; each is written as Parquet and read again by the next.

Every stage works on all that its predecessor kept, and all but the last return the columns of the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stewardry.llm import decision_list, decontam, lines, minmax, packing
from stewardry.llm.queries import tokenizer_path
from stewardry.scale import cut


def _columns(docs: DataFrame, judged: DataFrame) -> DataFrame:
    return judged.select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the learned decision list reject."""
    rules = decision_list.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _columns(docs, decision_list.judge(docs, rules).where("kept"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the lines that are boilerplate of their source and language, recounted; none is dropped."""
    cleaned = lines.clean(docs, parts=["lang"])
    if "n_chars" in docs.columns:
        counted = F.when(F.col("n_dropped") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
        cleaned = cleaned.withColumn("n_chars", counted)
    return _columns(docs, cleaned)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8."""
    return minmax.clean(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 1024 tokens, along the curve, each with its checksum."""
    return packing.with_checksum(packing.pack(docs, tokenizer_path(), added=True))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("packing", pack),
]

#: Learned rules, and links through common shingles, are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs, name.replace(" ", "-"))
    return docs

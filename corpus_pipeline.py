"""Corpus pipeline: documents in, packed token sequences out. Part of ``roadloom.llm``."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.llm import decontamination, language_id, line_dedup, packing, simhash_dedup
from roadloom.llm.common import forget_finished, landed, wide_hash

TOKENIZER = "byte_bpe_50k.json"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised, by models learned from all labelled ones."""
    return language_id.keep_identified(docs, learn=F.col("lang").isNotNull())


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without their source's boilerplate lines; n_chars follows the text."""
    other = [c for c in docs.columns if c not in ("doc_id", "text", "source")]
    found = line_dedup.drop_boilerplate(docs, keep=other)
    found = found.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return found.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class: the row with the smallest id (null last; ties by a hash of the text);
    of equal rows one. Empty and null texts are one class."""
    text = wide_hash("text")
    classes = simhash_dedup.near_duplicates(docs.withColumn("__text", text), carry=["__text"])
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "__text")
    first = classes.groupBy("class_fp", "doc_id", "__text").agg(F.count("*").alias("__rows")).groupBy("class_fp").agg(F.min_by(F.struct("doc_id", "__text", "__rows"), row).alias("f"))
    first = landed(first.select(F.col("f.doc_id").alias("__doc"), F.col("f.__text").alias("__text"), F.col("f.__rows").alias("__rows")), "first-of-class")
    kept = docs.join(first, docs["doc_id"].eqNullSafe(first["__doc"]) & (wide_hash(docs["text"]) == first["__text"])).drop("__doc", "__text")
    single = kept.filter("__rows = 1").drop("__rows")
    if first.filter("__rows > 1").isEmpty():
        return single
    return single.unionByName(kept.filter("__rows > 1").drop("__rows").dropDuplicates(["doc_id", "text"]))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document and their places in the sequences."""
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_boilerplate_lines),
    ("simhash_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: models and fingerprints are beyond SQL; tests compare the stages with plain versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; what a stage keeps is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = landed(stage(spark, docs, sf_dir), name)
        forget_finished(spark)
    return STAGES[-1][1](spark, docs, sf_dir)

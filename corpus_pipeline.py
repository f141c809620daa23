"""A training corpus from the documents table: five stages, each written as Parquet and read by the next.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last return the columns
of docs, also such as documents lacks. Null and empty texts are documents: the classifier judges their statistics,
they are near-duplicates of each other, hold no benchmark item, and the mix, which deals in words, never takes them.
Rows with null or equal ids are judged each by their own text; the mix may repeat a row up to three times. An empty
table passes through empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import contamination, mixing, quality, registry, simhash, token_files
from tessera.llm.shared import quoted, shared_folder


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, registry.table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays. The README has what this leaves."""
    return simhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return contamination.decontaminate(docs, registry.table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight asks, written in the order of the mix's slots; n_chars follows
    a text that is cut."""
    mixed = mixing.mixed_documents(docs)
    return mixed.select(*[(F.char_length("text").cast("long") if c == "n_chars" else quoted(c)).alias(c) for c in docs.columns])


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids as Arrow files in the order of the rows of docs, a table of Spark's Parquet files by number; returned
    is each document's place in them, as read back."""
    part = F.coalesce(F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).try_cast("long"), F.lit(0))
    placed = docs.withColumn("__place", F.shiftleft(part, 40) + F.col("_metadata.row_index"))
    return token_files.token_index(placed, registry.tokenizer_path(), end_id=registry.END_ID, order_col="__place")


STAGES = [
    ("quality classifier", quality_filter),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", source_mix),
    ("token-ID / binary output", token_output),
]

#: A fitted model and hash components aren't SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is a table in the shared folder."""
    docs = registry.table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

"""Corpus pipeline: quality, lines, near-duplicates, benchmark passages, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's documents. All but the last return the
columns of documents; a changed text has its n_chars counted anew.
"""

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, functions as F

from assayer.llm import decontaminate, lines, neardup, pieces, quality
from assayer.llm.words import table
from assayer.session import checkpoint_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on this corpus, scores 0.5 or more."""
    return quality.keep_good(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that many sites share. A document that loses its last
    line with text goes: of copies on so many sites the one that keeps the lines is
    the only one left. Documents that had no text stay, and rows that lose nothing
    keep their ``n_chars`` as it is."""
    cleaned = lines.remove_boilerplate(docs.select(*COLUMNS))
    lost = F.col("n_removed") > 0
    left = cleaned.where(~lost | F.col("text").rlike(r"\S"))
    return left.withColumn("n_chars", F.when(lost, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near-duplicates."""
    return neardup.keep_first(docs.select(*COLUMNS))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.keep_clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, with the check that they decode to its text."""
    return pieces.encode(docs.select("doc_id", "text"))


STAGES = [
    ("quality_classifier", good_quality), ("line_dedup", without_boilerplate), ("minhash_near_dedup", one_of_each_group),
    ("benchmark_decontamination", without_benchmark), ("sentencepiece", tokens),
]

#: SQL can express neither the network nor the merges of the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_folder(spark)}/corpus-{uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

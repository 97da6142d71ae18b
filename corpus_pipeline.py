"""From raw documents to a training mixture: five stages, each one operator of the llm subpackage.

Stages are written and read again in between, so each works on all that its predecessor kept.

Every stage takes whole tables with a doc_id and a text column, besides any others, whatever their names: the
columns come out as they went in (``mixture`` adds ``copy``). Texts may be null, empty or of any length. An empty
table gives an empty one. Rows may repeat or lack an id; what becomes of them is said for each stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, line_dedup, mixing, ngram_join, quality
from tidemark.llm.spread import checkpoint_dir, delete, scratch


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labelled ones, scores one half or more. Rejected ones go.

    Rows are scored by their text alone, so repeated rows stay or go together; a null text counts as empty. A row
    without an id has no label to learn from. Without any label every document scores one half and stays.
    """
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    whole = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"))
    return quality.score(whole, model).where(F.col("score") >= 0.5).select("row.*")


def line_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without chunks of lines that came up before. Those of which nothing is left go; n_chars is set anew.

    Null and empty texts have no lines and stay. Rows that share an id are none earlier than the other, so both
    keep a chunk that they share; rows without an id come after all others.
    """
    out = line_dedup.dedup_lines(docs, extra=("line_dedup_lines", "line_dedup_removed"))
    gone = (F.col("line_dedup_removed") > 0) & (F.trim("text") == "")
    kept = out.where(~F.coalesce(gone, F.lit(False))).drop("line_dedup_lines", "line_dedup_removed")
    return kept.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else kept


def near_duplicate_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least id, of each group linked by 5-word shingles at a similarity of 0.8.

    Texts without words are in no group and stay, but rows of one id and text, or of no id and one text, are one
    document. Of texts of a group that share the least id the one with the least hash stays.
    """
    return ngram_join.keep_one(docs)


def benchmark_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a 10-word window of the benchmark; shorter items are looked for whole.

    Each row is judged alone. Null texts and texts without words hold no window and stay; so does everything if
    the benchmark is empty.
    """
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target rate says, in a globally shuffled order; ``copy`` counts from 0.

    The number of copies hangs on the id (or, without one, on the text), so repeated rows are drawn alike. Null is
    a source of its own. Texts aren't looked at.
    """
    return mixing.mix_sources(docs)


STAGES = [
    ("quality classifier", quality_filter),
    ("line dedup", line_filter),
    ("n-gram Jaccard join", near_duplicate_filter),
    ("benchmark decontamination", benchmark_filter),
    ("mixing sources", mixture),
]

#: SQL can't express the classifier.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
        if number:
            delete(spark, f"{folder}/{number - 1}")
    return docs

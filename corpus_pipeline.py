"""A corpus from documents: quality rules, line dedup, near-duplicate removal, decontamination, packing.

Every stage decides by id and text together, null-safe, so rows that share an id or have none are told apart. Rows that
repeat id and text get one verdict; of those that the near-duplicate stage compares one stays. Columns of docs may have any
names; those that the stages need are doc_id and text, and n_chars follows the text where it is there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import fresh, new_path, text_key, without, written
from millrace.llm.decontaminate import decontaminate
from millrace.llm.line_dedup import dedup_lines
from millrace.llm.ngram_join import near_copies
from millrace.llm.packing import pack
from millrace.llm.quality_rules import quality_verdicts


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the forest keep."""
    verdicts = quality_verdicts(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    gone = written(verdicts.where("not kept").select("doc_id", "tkey").distinct(), "rejected")
    return without(docs, gone, "doc_id", text_key(F.col("text")))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more of them share; n_chars follows the text."""
    lines, dropped = fresh(docs, "n_lines"), fresh(docs, "n_dropped")
    out = dedup_lines(docs, lines_as=lines, dropped_as=dropped)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(dropped) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies, that with the least id (a null id last); texts without words all stay."""
    gone, repeats = near_copies(docs)
    key = text_key(F.col("text"))
    left = without(docs, gone, "doc_id", key)
    if repeats.isEmpty():
        return left
    # Rows that repeat an id and a text of several words: the least of them by all columns stays.
    i, t = fresh(docs, "i"), fresh(docs, "t")
    again = repeats.select(F.col("doc_id").alias(i), F.col("tkey").alias(t))
    same = F.col("doc_id").eqNullSafe(F.col(i)) & (key == F.col(t))
    one = left.join(again, same, "left_semi").select(key.alias(t), F.struct(*docs.columns).alias(i)).groupBy(t, f"{i}.doc_id").agg(F.min(i).alias(i)).select(f"{i}.*")
    return without(left, repeats, "doc_id", key).union(one)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bucket, batch and slot of each document that is left, and its text."""
    return pack(docs, carry=("text",))


STAGES = [("quality rules", quality_stage), ("line dedup", line_stage), ("n-gram Jaccard join", near_duplicate_stage), ("benchmark decontamination", decontamination_stage), ("packing", packing_stage)]
#: The forest and the edit distance are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        path = new_path(spark, f"stage{k + 1}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

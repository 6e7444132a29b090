"""Cleaning of a corpus in five stages, each written before the next: language, lines, near copies, benchmarks, packing.

A stage deletes at once those of its scratch tables that its result does not read.

Rows are told apart by id and text: null and repeated ids lose no document. Columns of documents that the stages do not
know pass through all but the last; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from mnemoframe import scratch
from mnemoframe.llm import decontaminate, langid, line_dedup, packing, simhash
from mnemoframe.scratch import new_path


def _stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @wraps(f)
    def work(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        before = set(scratch.named())
        out = f(spark, docs, sf_dir)
        read = {part for path in out.inputFiles() for part in path.split("/")}
        scratch.delete(spark, [x for x in scratch.named() if x not in before and x.rpartition("/")[2] not in read])
        scratch.drop_shuffles(spark)
        return out

    return work


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: null texts, texts without letters, and texts that no language claims."""
    return langid.reject_unknown(docs, langid.learn(docs))


@_stage
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; so do documents that had text and have none left. ``n_chars`` follows the text."""
    kept = line_dedup.dedup_lines(docs).where((F.col("n_removed") == 0) | (F.trim("text") != ""))
    sized = kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else kept
    return sized.select(docs.columns)


@_stage
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 0.8 of its five-word shingles stays, the one with the smallest id."""
    return simhash.drop_near_duplicates(docs, n=5, similarity=(4, 5))


@_stage
def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go."""
    return decontaminate.remove_contaminated(docs, _table(spark, sf_dir, "benchmark"))


@_stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, cut where it is longer than a sequence, with its place in a written sequence of token ids."""
    return packing.pack_documents(docs)


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("benchmarks", benchmarks), ("packed", packed)]

#: Learned language scores and edit distances have no counterpart in SQL; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs

"""A training-corpus pipeline: quality, toxicity, line dedup, near-duplicate removal, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
Between stages the result is written as Parquet and read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treelake.llm import line_dedup, minhash, packing, quality, toxicity
from treelake.llm.common import Scope, stage


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier takes for good (score >= 0.5)."""
    model = quality.train_quality(docs, _labels(spark, sf_dir))
    return quality.add_quality(docs, model).where("quality_score >= 0.5").select(*docs.columns)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier doesn't take for toxic (score < 0.5)."""
    model = toxicity.train_toxicity(docs, _labels(spark, sf_dir))
    return toxicity.score_toxicity(docs, model).where("toxicity < 0.5").select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the later copies of repeated line runs; documents that lose their whole text go.

    n_chars is brought up to date where lines went.
    """
    out = line_dedup.line_dedup(docs)
    lost = (F.col("lines_removed") > 0) & ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    cols = [F.when(F.col("lines_removed") > 0, F.length("text").cast("long")).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return out.where(~lost).select(*cols)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies (five-word shingles, similarity 0.8)."""
    found = minhash.near_components(docs, words=5, similarity=(80, 100))
    gone = stage(found.where("not kept").select("doc_id").distinct(), "near_gone")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length buckets and token-budget batches of what is left."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("toxicity", keep_clean),
    ("line_dedup", dedup_lines),
    ("near_dedup", drop_near_copies),
    ("packing", pack_batches),
]

#: The classifiers can't be expressed in SQL; tests/llm holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; a stage's table is deleted as soon as the next one has been written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scope()
    for name, f in STAGES[:-1]:
        here = Scope()
        docs = here.stage(f(spark, docs, sf_dir), f"pipeline_{name}")
        before.close()
        before = here
    out = stage(STAGES[-1][1](spark, docs, sf_dir), f"pipeline_{STAGES[-1][0]}")
    before.close()
    return out

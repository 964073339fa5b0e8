"""The corpus pipeline: stages over the documents table, each written and read again by the next.

Every stage works on all its predecessor kept and returns the columns of documents, the last one token counts and digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import pieces
from tidemark.llm.decontaminate import drop_contaminated
from tidemark.llm.frames import fresh
from tidemark.llm.line_templates import dedup_lines
from tidemark.llm.near_dups import drop_near_duplicates
from tidemark.llm.quality import quality_rules
from tidemark.llm.queries import piece_model
from tidemark.session import materialize


def _same_columns(out: DataFrame, docs: DataFrame) -> DataFrame:
    """``out`` with the columns of ``docs``; a character count follows the text."""
    return out.select(
        *[F.coalesce(F.length("text"), F.lit(0)).cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    )


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; frequent lines of a host are cut from the others."""
    (kept,) = fresh(docs, "kept")
    return _same_columns(quality_rules(docs, cut=True).where(F.col(kept)), docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of templates that recur across documents go; every document stays."""
    return _same_columns(dedup_lines(docs), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the encoded and decoded texts."""
    decoded = pieces.encode_and_decode(docs.select("doc_id", "lang", "source", "text"), piece_model())
    return decoded.select("doc_id", "lang", "source", *pieces.digests(decoded))


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("sentencepiece", tokens),
]

#: Components of near-duplicates and merge-type tokens are beyond SQL; tests compare the rows with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

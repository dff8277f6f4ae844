"""From raw documents to packed training sequences: language, lines, near copies, source weights, packing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnspark.llm import common, langid, line_dedup, mixing, near_dedup, packing

#: A document whose words are in its language by less than this share, on average, is rejected.
LEAST_SCORE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those that are null, have no letter or are too little in any one language go."""
    return langid.in_a_language(docs, LEAST_SCORE)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that came before; one that had words and is left with none goes."""
    words = lambda c: F.coalesce(F.col(c).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    out, found = line_dedup.with_findings(docs)
    out = out.where(words(f"{found}.text") | (F.size(f"{found}.removed_lines") == 0))
    text = F.col(f"{found}.text")
    new = {"text": text, "n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)}
    return out.select(*[new.get(c, F.col(c)).alias(c) for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies by shingles of five words."""
    return near_dedup.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources draws them."""
    return mixing.apply(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents packed into sequences."""
    return packing.pack_documents(docs)


STAGES = [("language_id", language), ("line_dedup", lines), ("near_dedup", near_copies), ("mixing", mixture), ("packing", sequences)]

#: The first stage is a trained model; SQL can't express the result.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written to the shared folder and read again."""
    docs, folder = common.documents(spark, sf_dir), f"{common.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

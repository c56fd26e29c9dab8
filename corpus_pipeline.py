"""The corpus pipeline: language, exact copies, near copies, mix, packing; each stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.exact import deduplicate
from strata.llm.language import identify
from strata.llm.mixing import mixed_texts
from strata.llm.near import near_groups
from strata.llm.packing import pack_documents
from strata.llm.queries import vocabulary
from strata.llm.stored import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; texts that are null, letter-free or unlearnable go."""
    found = identify(docs.select(*COLUMNS), vocabulary("piece_bpe_32k.model"))
    return found.where(F.col("lang_pred") != "und").select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of equal texts."""
    return deduplicate(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates (all rows of its doc_id); rows without doc_id stay."""
    kept = near_groups(docs.select("doc_id", "text")).where("kept").select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("_kept")), "left_semi").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes, one row per document and epoch."""
    return mixed_texts(docs.select(*COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens."""
    return pack_documents(docs.select("doc_id", "text"), vocabulary("byte_bpe_50k.json"))


STAGES = [("language", language), ("exact", exact), ("near", near), ("mix", mix), ("pack", pack)]
ORACLE_SQL = None  # language and signatures have no SQL; tested against the stages' brute-force versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``; every stage is written and read again."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

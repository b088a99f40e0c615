"""A training corpus from raw documents: five stages, each one operator of the library.

toxic documents go; repeated lines are cut; one document of each near-duplicate
group stays; documents that hold benchmark passages go; the rest is packed into
sequences of 2048 tokens. All stages but the last keep the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lobloom.llm import decontaminate, linededup, packing, simhash_similar, toxicity
from lobloom.llm.ship import ensure_importable
from lobloom.llm.tables import result_name
from lobloom.session import stage

ORACLE_SQL = None  # training, fingerprints and packing have no SQL form; see tests/llm


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model does not reject."""
    ensure_importable(spark)
    return toxicity.without_toxic(docs, _table(spark, sf_dir, "labels"))


def cut_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with lines cut that repeat (nearly) in or before them."""
    ensure_importable(spark)
    out = linededup.dedup_lines(docs).drop(result_name(docs, "line_dedup"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with 5-word shingles alike to 0.8 or more."""
    ensure_importable(spark)
    return simhash_similar.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of ten words of a benchmark item."""
    ensure_importable(spark)
    return decontaminate.decontaminate(docs, _table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left, each with its place in a sequence."""
    ensure_importable(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", cut_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; every stage is written as Parquet and read again."""
    docs = _table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""Corpus pipeline over `documents`: language, exact copies, near copies, source mix, packed sequences.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last return rows
of `documents` with its columns; the last returns the packed pieces. `run` writes each stage's result to the
shared folder and reads it again for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, language, minhash, mixing, packing
from tidemark.llm.common import stored, table
from tidemark.llm.queries import tokenizer_files
from tidemark.session import configure


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found; those without a letter go.

    Where no language could be learned (no label outside the held-out quarter), the text itself tells which have a letter.
    """
    samples = language.fit(docs, ~language.held_out())
    if not samples:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    judged = language.predict(docs, samples, out=("__lang_pred", "__lang_score"))
    return judged.where(F.col("__lang_pred") != "und").select(*docs.columns)


def first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return exact_dedup.keep_first(docs)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return minhash.keep_one(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.repeated(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences, with their token ids."""
    return packing.pack(docs, **tokenizer_files())


STAGES = [
    ("language", known_language),
    ("exact_dedup", first_copies),
    ("near_dedup", one_of_near_copies),
    ("mixing", mixed_sources),
    ("packing", packed),
]

# Tokens, suffix automata and signatures have no SQL form; the tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents that stay."""
    docs = table(configure(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""A corpus pipeline over ``documents``: language, near-dedup, decontamination, mixing, token store.

Each stage works on all rows that its predecessor kept, takes its decisions there and returns the columns of documents;
the last returns what it reads back from the token store it wrote. Language models learn from the whole table of the
stage's input, never from held-out rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skillgrid.llm import decontaminate, langid, mixing, similar, token_store
from skillgrid.llm.queries import table, vocabulary
from skillgrid.session import materialize, shared_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Between random letters (none of 400 texts of 80 words is over it) and clean documents (of 80 words 99 % are over 0.05).
LEAST_MARGIN = 0.03
#: Near copies share four fifths of their shingles of five words.
NEAR = {"shingle": 5, "least": 0.8}


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language."""
    docs = docs.select(*COLUMNS)
    return langid.keep_known(docs, langid.fit(docs), LEAST_MARGIN)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: SimHash's links and those of texts too far apart for it, all verified by their shingles."""
    return similar.keep_first(docs, **NEAR)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What a reader of the written token store gets."""
    path = shared_path(spark, "token-store")
    token_store.write_store(docs, path, vocabulary())
    return token_store.read_store(spark, path)


STAGES = [("language", language), ("near_dedup", near_dedup), ("decontaminate", clean_of_benchmark), ("mix", mixture), ("token_store", tokens)]

#: Compression, fingerprints and codes have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written as Parquet and read back."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

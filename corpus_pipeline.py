"""A corpus pipeline: drop toxic documents, repeated lines and near copies, mix the sources, encode with pieces.

Each stage takes (spark, docs, sf_dir) and returns the columns of its documents; the last returns ids. Every stage's
rows are written to the shared folder and read again, so a lost executor costs no more than the stage it worked on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from readloom.llm import chosen_path, lines, mixing, pieces, toxicity
from readloom.llm.common import durable


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the cut; the model learns from the labels of ``docs`` that lie outside its fold."""
    return toxicity.stage(spark, docs, sf_dir)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents without the lines that repeated three-line windows cover; ``n_chars`` follows."""
    return lines.stage(spark, docs, sf_dir)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the least id, of each group that links of similarity 0.8 connect."""
    return chosen_path.stage(spark, docs, sf_dir)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, once for each copy that the sources' targets take."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_pieces and ids_crc32 of every copy, and sha256 and length of its decoded text."""
    return pieces.stage(spark, docs, sf_dir)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: the first stage applies a trained model, so SQL can't give these rows; tests hold stages against brute force
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), f"pipeline-{name}")
    name, stage = STAGES[-1]
    return durable(stage(spark, docs, sf_dir), f"pipeline-{name}")

"""Queries of the training-data operators, by name, and the SQL that some of them can be held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from readloom.llm import chosen_path, gif, lattice_lm, lines, mixing, order_minhash, pieces, quality, token_store, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chosen_path": chosen_path.query,
    "op2_order_minhash": order_minhash.query,
    "op3_lattice_lm": lattice_lm.query,
    "op4_mixing": mixing.query,
    "op5_pieces": pieces.query,
    "op6_gif": gif.query,
    "op7_token_store": token_store.query,
    "op8_lines": lines.query,
    "op9_toxicity": toxicity.query,
    "op10_quality": quality.query,
}

ORACLE: dict[str, str] = {
    "op4_mixing": mixing.ORACLE,
    "op8_lines": lines.ORACLE,
}

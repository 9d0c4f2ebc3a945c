"""The queries of the corpus operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from quarry.llm import bpe, exact_dedup, html_consensus, langid, mixing, sharding, simhash, token_files, warc_members, winnowing

_MODULES = {
    "op1_winnowing": winnowing,
    "op2_mixing": mixing,
    "op3_simhash_dedup": simhash,
    "op4_warc_members": warc_members,
    "op5_html_consensus": html_consensus,
    "op6_exact_dedup": exact_dedup,
    "op7_bpe": bpe,
    "op8_token_files": token_files,
    "op9_language_id": langid,
    "op10_sharding": sharding,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**{name: m.query for name, m in _MODULES.items()}, "pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    """The operators that have SQL, and the pipeline if it has."""
    out = {name: m.SQL for name, m in _MODULES.items() if getattr(m, "SQL", None)}
    return out | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})

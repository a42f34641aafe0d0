"""What the entry module registers of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import queries as q
from . import sql_checks


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (q.op1_line_dedup, q.op2_lm_scoring, q.op3_sentencepiece, q.op4_minhash_dedup, q.op5_quality_rules, q.op6_license_scans, q.op7_decontamination, q.op8_suffix_dedup, q.op9_html_extraction, q.op10_url_filters, q.op11_phrase_mining, q.op12_conversation_trie, q.op13_jaccard_join)}


def oracle_sql() -> dict[str, str]:
    return {"op4_minhash_dedup": sql_checks.OP4, "op5_quality_rules": sql_checks.OP5, "op6_license_scans": sql_checks.OP6, "op7_decontamination": sql_checks.OP7, "op10_url_filters": sql_checks.OP10, "op11_phrase_mining": sql_checks.OP11, "op12_conversation_trie": sql_checks.OP12, "op13_jaccard_join": sql_checks.OP13}

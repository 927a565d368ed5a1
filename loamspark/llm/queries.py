"""The queries of this subpackage and their SQL, for the entry module at the repository's top."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import embedding_dedup, language_id, mixing, packing, pii, quality_classifier, quality_rules, simhash_dedup, suffix_dedup, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_simhash_dedup": simhash_dedup.op3_simhash_dedup,
    "op4_url_filter": url_filter.op4_url_filter,
    "op5_mixing": mixing.op5_mixing,
    "op6_pii": pii.op6_pii,
    "op7_packing": packing.op7_packing,
    "op8_embedding_dedup": embedding_dedup.op8_embedding_dedup,
    "op9_language_id": language_id.op9_language_id,
    "op10_quality_classifier": quality_classifier.op10_quality_classifier,
}

#: DuckDB SQL for those that SQL can express.
ORACLES: dict[str, str] = {
    "op2_quality_rules": quality_rules.ORACLE_SQL,
    "op4_url_filter": url_filter.ORACLE_SQL,
    "op5_mixing": mixing.ORACLE_SQL,
}

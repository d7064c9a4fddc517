"""The numbered queries of this subpackage and the pipeline, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from passagework.llm.bpe import op10_bpe
from passagework.llm.chat import OP3_SQL, op3_chat_formatting
from passagework.llm.exact_dedup import OP8_SQL, op8_exact_dedup
from passagework.llm.filter_audit import OP11_SQL, op11_filter_audit
from passagework.llm.lexical import OP12_SQL, op12_lexical_search
from passagework.llm.near_dedup import op7_minhash_near_dedup
from passagework.llm.packing import op1_best_fit_packing
from passagework.llm.quality import op2_quality
from passagework.llm.rules import op4_quality_rules
from passagework.llm.secrets import OP6_SQL, op6_secret_scans
from passagework.llm.simhash import op13_simhash_near_dedup
from passagework.llm.toxicity import op5_toxicity
from passagework.llm.warc import OP9_SQL, op9_warc

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_best_fit_packing": op1_best_fit_packing,
        "op2_quality": op2_quality,
        "op3_chat_formatting": op3_chat_formatting,
        "op4_quality_rules": op4_quality_rules,
        "op5_toxicity": op5_toxicity,
        "op6_secret_scans": op6_secret_scans,
        "op7_minhash_near_dedup": op7_minhash_near_dedup,
        "op8_exact_dedup": op8_exact_dedup,
        "op9_warc": op9_warc,
        "op10_bpe": op10_bpe,
        "op11_filter_audit": op11_filter_audit,
        "op12_lexical_search": op12_lexical_search,
        "op13_simhash_near_dedup": op13_simhash_near_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_chat_formatting": OP3_SQL,
        "op6_secret_scans": OP6_SQL,
        "op8_exact_dedup": OP8_SQL,
        "op9_warc": OP9_SQL,
        "op11_filter_audit": OP11_SQL,
        "op12_lexical_search": OP12_SQL,
    }

"""The queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op3_byte_bpe
from .chat_windows import OP13_SQL, op13_chat_windows
from .fill_middle import OP11_SQL, op11_fill_middle
from .html_text import op8_html_text
from .jpeg import op1_progressive_jpeg
from .neardup import OP9_SQL, op9_minhash_neardup
from .packing import op6_best_fit_packing
from .quality import op4_quality_rules
from .substrings import OP2_SQL, op2_substring_dedup
from .token_counts import op7_token_counts
from .url_filters import OP10_SQL, op10_url_filters
from .vector_codes import OP12_SQL, op12_vector_codes
from .warc import OP5_SQL, op5_warc_salvage


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_progressive_jpeg": op1_progressive_jpeg,
        "op2_substring_dedup": op2_substring_dedup,
        "op3_byte_bpe": op3_byte_bpe,
        "op4_quality_rules": op4_quality_rules,
        "op5_warc_salvage": op5_warc_salvage,
        "op6_best_fit_packing": op6_best_fit_packing,
        "op7_token_counts": op7_token_counts,
        "op8_html_text": op8_html_text,
        "op9_minhash_neardup": op9_minhash_neardup,
        "op10_url_filters": op10_url_filters,
        "op11_fill_middle": op11_fill_middle,
        "op12_vector_codes": op12_vector_codes,
        "op13_chat_windows": op13_chat_windows,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_substring_dedup": OP2_SQL,
        "op5_warc_salvage": OP5_SQL,
        "op9_minhash_neardup": OP9_SQL,
        "op10_url_filters": OP10_SQL,
        "op11_fill_middle": OP11_SQL,
        "op12_vector_codes": OP12_SQL,
        "op13_chat_windows": OP13_SQL,
    }

"""Queries of this subpackage and their SQL, for the registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bm25 import op4_bm25
from .conversations import op11_conversations, op11_sql
from .fingerprint import op3_fingerprints
from .html_text import op2_html_text
from .line_dedup import op6_line_dedup
from .mixing import op5_mixing, op5_sql
from .ngram_join import op9_ngram_join
from .packing import op7_packing
from .quality import op1_quality
from .secret_scan import op8_secret_scan, op8_sql
from .spelling import op12_spelling, op12_sql
from .toxicity import op10_toxicity
from .url_filter import op13_sql, op13_url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": op1_quality,
        "op2_html_text": op2_html_text,
        "op4_bm25": op4_bm25,
        "op5_mixing": op5_mixing,
        "op6_line_dedup": op6_line_dedup,
        "op3_fingerprints": op3_fingerprints,
        "op7_packing": op7_packing,
        "op9_ngram_join": op9_ngram_join,
        "op10_toxicity": op10_toxicity,
        "op8_secret_scan": op8_secret_scan,
        "op11_conversations": op11_conversations,
        "op12_spelling": op12_spelling,
        "op13_url_filter": op13_url_filter,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_mixing": op5_sql(), "op8_secret_scan": op8_sql(), "op11_conversations": op11_sql(), "op12_spelling": op12_sql(), "op13_url_filter": op13_sql()}

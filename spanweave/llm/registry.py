"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracles
from .byte_bpe import op3_byte_bpe
from .html_text import op8_html_text
from .knn_quality import op9_knn_quality
from .line_dedup import op5_line_dedup
from .matroska import op7_media
from .packing import op2_packing
from .quality_rules import op1_quality_rules
from .secret_scan import op4_secret_scan
from .simhash import op6_simhash
from .suffix_dedup import op10_suffix_dedup

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_packing": op2_packing,
        "op3_byte_bpe": op3_byte_bpe,
        "op4_secret_scan": op4_secret_scan,
        "op5_line_dedup": op5_line_dedup,
        "op6_simhash": op6_simhash,
        "op7_media": op7_media,
        "op8_html_text": op8_html_text,
        "op9_knn_quality": op9_knn_quality,
        "op10_suffix_dedup": op10_suffix_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)

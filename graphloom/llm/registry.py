"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import license_scan, line_dedup, mixing, url_filter
from .decontamination import op9_decontamination
from .license_scan import op8_license_scan
from .line_dedup import op2_line_dedup
from .lm_scoring import op3_lm_scoring
from .media import op6_media_columns
from .mixing import op5_mixing
from .near_dedup import op7_near_dedup
from .pii import op10_pii
from .quality import op1_quality_classifier
from .url_filter import op4_url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_line_dedup": op2_line_dedup,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_url_filter": op4_url_filter,
    "op5_mixing": op5_mixing,
    "op6_media_columns": op6_media_columns,
    "op7_near_dedup": op7_near_dedup,
    "op8_license_scan": op8_license_scan,
    "op9_decontamination": op9_decontamination,
    "op10_pii": op10_pii,
}
ORACLE_SQL: dict[str, str] = {
    "op2_line_dedup": line_dedup.ORACLE_SQL,
    "op4_url_filter": url_filter.ORACLE_SQL,
    "op5_mixing": mixing.ORACLE_SQL,
    "op8_license_scan": license_scan.ORACLE_SQL,
}

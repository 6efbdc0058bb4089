"""Queries of this subpackage and their DuckDB equivalents, for the entry module."""

from __future__ import annotations

from .chat_format import OP1_SQL, op1_chat_format
from .fingerprints import op5_winnowing_fingerprints
from .jaccard_join import op2_ngram_jaccard_join
from .license_scans import op10_license_scans
from .mixing import op6_source_mixing
from .oracles import OP3_SQL, OP10_SQL
from .packing import op7_best_fit_packing
from .quality_model import op8_quality_classifier
from .quality_rules import op9_quality_rules
from .secret_scans import op3_secret_scans
from .token_counts import op4_token_counts

QUERIES = {
    "op1_chat_format": op1_chat_format,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_secret_scans": op3_secret_scans,
    "op4_token_counts": op4_token_counts,
    "op5_winnowing_fingerprints": op5_winnowing_fingerprints,
    "op6_source_mixing": op6_source_mixing,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_quality_rules": op9_quality_rules,
    "op10_license_scans": op10_license_scans,
}

ORACLES: dict[str, str] = {"op1_chat_format": OP1_SQL, "op3_secret_scans": OP3_SQL, "op10_license_scans": OP10_SQL}

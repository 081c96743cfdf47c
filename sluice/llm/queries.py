"""Queries of the training-data operators, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from .audio_features import op9_media_columns
from .importance import op12_importance_resampling
from .jaccard_join import op10_ngram_jaccard_join
from .language_crf import op8_language_id
from .lexical_search import op13_ranked_search
from .license_scan import op2_license_scans
from .line_dedup import op11_line_dedup
from .mixing import op5_mixing_sources
from .oracles import ORACLE_SQL
from .packing import op7_packing
from .quality_classifier import op4_quality_classifier
from .quality_rules import op3_quality_rules
from .secret_scan import op1_secret_scans
from .suffix_tree import op6_lm_scoring

QUERIES = {
    "op1_secret_scans": op1_secret_scans,
    "op2_license_scans": op2_license_scans,
    "op3_quality_rules": op3_quality_rules,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_mixing_sources": op5_mixing_sources,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_packing": op7_packing,
    "op8_language_id": op8_language_id,
    "op9_media_columns": op9_media_columns,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    "op11_line_dedup": op11_line_dedup,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_ranked_search": op13_ranked_search,
}

__all__ = ["ORACLE_SQL", "QUERIES"]

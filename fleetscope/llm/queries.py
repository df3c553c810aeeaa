"""The queries of this folder and the SQL of those that SQL can express."""

from __future__ import annotations

from .bpe import op4_bpe_round_trip
from .ctw import op9_context_tree_scores
from .embedding import OP7_SQL, op7_embedding_near_dedup
from .html_extract import op10_html_extraction
from .licenses import OP8_SQL, op8_license_scan
from .packing import op2_best_fit_packing
from .quality import op5_quality_rules
from .simhash import op3_simhash_near_dedup
from .substring import OP6_SQL, op6_substring_dedup
from .url_filter import OP1_SQL, op1_url_filter

QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_bpe_round_trip": op4_bpe_round_trip,
    "op5_quality_rules": op5_quality_rules,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_embedding_near_dedup": op7_embedding_near_dedup,
    "op8_license_scan": op8_license_scan,
    "op9_context_tree_scores": op9_context_tree_scores,
    "op10_html_extraction": op10_html_extraction,
}

SQL = {
    "op1_url_filter": OP1_SQL,
    "op6_substring_dedup": OP6_SQL,
    "op7_embedding_near_dedup": OP7_SQL,
    "op8_license_scan": OP8_SQL,
}

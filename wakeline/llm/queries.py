"""The queries over ``documents``, by name, and the SQL for those that have one."""

from __future__ import annotations

from .fingerprints import op5_fingerprints
from .language_id import op10_language_id
from .lm_scoring import op8_lm_scoring
from .mixing import op4_source_mix
from .near_dedup import op1_near_dedup
from .oracles import ORACLE_SQL
from .packing import op9_best_fit_packing
from .periodic_runs import op13_periodic_runs
from .quality_knn import op6_quality_classifier
from .quality_rules import op7_quality_rules
from .token_files import op3_token_files
from .whitening import op11_embedding_whitening
from .word_bpe import op12_bpe_round_trip
from .wordpiece import op2_token_counts

QUERIES = {f.__name__: f for f in (op1_near_dedup, op2_token_counts, op3_token_files, op4_source_mix, op5_fingerprints, op6_quality_classifier, op7_quality_rules, op8_lm_scoring, op9_best_fit_packing, op10_language_id, op11_embedding_whitening, op12_bpe_round_trip, op13_periodic_runs)}

__all__ = ["ORACLE_SQL", "QUERIES"]

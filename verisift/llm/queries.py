"""The queries and oracle SQL of this subpackage."""

from __future__ import annotations

from .exact_dedup import SQL_OP6, op6_exact_dedup
from .fingerprints import op7_fingerprints
from .language_id import op2_language_id
from .lm_scoring import op1_lm_scoring
from .mixing import SQL_OP4, op4_mixing
from .near_dedup import op3_minhash_near_dedup
from .packing import op8_packing
from .substring_dedup import SQL_OP5, op5_substring_dedup
from .url_filters import SQL_OP9, op9_url_filters
from .warc import SQL_OP10, op10_warc

QUERIES = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_language_id": op2_language_id,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_mixing": op4_mixing,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_fingerprints": op7_fingerprints,
    "op8_packing": op8_packing,
    "op9_url_filters": op9_url_filters,
    "op10_warc": op10_warc,
}
ORACLE_SQL = {"op4_mixing": SQL_OP4, "op5_substring_dedup": SQL_OP5, "op6_exact_dedup": SQL_OP6, "op9_url_filters": SQL_OP9, "op10_warc": SQL_OP10}

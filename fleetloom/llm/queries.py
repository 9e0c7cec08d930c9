"""The contract queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from .bpe import op5_byte_bpe
from .lm import op8_lm_scoring
from .store import op7_token_store
from .quality import op2_quality_rules
from .contamination import op1_decontamination
from .licenses import OP6_SQL, op6_license_scan
from .simhash import op4_simhash_near_dedup
from .warc import OP3_SQL, op3_warc
from .substring import OP9_SQL, op9_substring_dedup
from .suffix import OP10_SQL, op10_suffix_dedup

QUERIES = {
    "op2_quality_rules": op2_quality_rules,
    "op3_warc": op3_warc,
    "op5_byte_bpe": op5_byte_bpe,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op7_token_store": op7_token_store,
    "op8_lm_scoring": op8_lm_scoring,
    "op6_license_scan": op6_license_scan,
    "op1_decontamination": op1_decontamination,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_suffix_dedup": op10_suffix_dedup,
}

SQL = {
    "op6_license_scan": OP6_SQL,
    "op3_warc": OP3_SQL,
    "op9_substring_dedup": OP9_SQL,
    "op10_suffix_dedup": OP10_SQL,
}

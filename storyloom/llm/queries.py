"""The registered queries of the training-data operators, and the SQL of those that SQL can express."""

from storyloom.llm.alignment import op13_alignment
from storyloom.llm.bpe import op9_bpe_roundtrip
from storyloom.llm.exact_dedup import OP8_SQL, op8_exact_dedup
from storyloom.llm.fingerprints import op3_fingerprints
from storyloom.llm.html_extract import op6_html_extract
from storyloom.llm.language_id import op2_language_id
from storyloom.llm.licenses import OP4_SQL, op4_license_scan
from storyloom.llm.line_dedup import OP10_SQL, op10_line_dedup
from storyloom.llm.minhash import op1_near_duplicates
from storyloom.llm.packing import op7_packing
from storyloom.llm.quality_rules import OP11_SQL, op11_quality_rules
from storyloom.llm.ranked_search import OP12_SQL, op12_ranked_search
from storyloom.llm.substring_dedup import OP5_SQL, op5_substring_dedup

QUERIES = {
    "op1_near_duplicates": op1_near_duplicates,
    "op2_language_id": op2_language_id,
    "op3_fingerprints": op3_fingerprints,
    "op4_license_scan": op4_license_scan,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_html_extract": op6_html_extract,
    "op7_packing": op7_packing,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_bpe_roundtrip": op9_bpe_roundtrip,
    "op10_line_dedup": op10_line_dedup,
    "op11_quality_rules": op11_quality_rules,
    "op12_ranked_search": op12_ranked_search,
    "op13_alignment": op13_alignment,
}

ORACLES = {
    "op4_license_scan": OP4_SQL,
    "op5_substring_dedup": OP5_SQL,
    "op8_exact_dedup": OP8_SQL,
    "op10_line_dedup": OP10_SQL,
    "op11_quality_rules": OP11_SQL,
    "op12_ranked_search": OP12_SQL,
}

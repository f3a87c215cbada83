"""The registered queries of this subpackage, and the SQL that checks those SQL can express."""

from __future__ import annotations

from . import bpe, decontam, language, near_dups, quality, secrets, suffix_dedup, suffix_tree, topk, urls

QUERIES = {
    "op1_suffix_tree_lm": suffix_tree.op1_suffix_tree_lm,
    "op2_decontaminate": decontam.op2_decontaminate,
    "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
    "op4_language": language.op4_language,
    "op5_url_filter": urls.op5_url_filter,
    "op6_near_duplicates": near_dups.op6_near_duplicates,
    "op7_byte_bpe": bpe.op7_byte_bpe,
    "op8_secret_scan": secrets.op8_secret_scan,
    "op9_exact_topk": topk.op9_exact_topk,
    "op10_quality": quality.op10_quality,
}

ORACLE_SQL: dict[str, str] = {
    "op2_decontaminate": decontam.SQL,
    "op5_url_filter": urls.SQL,
    "op6_near_duplicates": near_dups.SQL,
    "op8_secret_scan": secrets.SQL,
    "op9_exact_topk": topk.SQL,
}

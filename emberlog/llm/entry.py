"""The queries of this subpackage, and their SQL where SQL can express them."""

from emberlog.llm import decontaminate, exact_dedup, html_text, langid, lm_score, mixing, near_dedup, negatives, quality, substring_dedup, vptree, warc, whitening

QUERIES = {
    "op1_lm_score": lm_score.query,
    "op2_quality": quality.query,
    "op3_html_text": html_text.query,
    "op4_exact_dedup": exact_dedup.query,
    "op5_decontaminate": decontaminate.query,
    "op6_language": langid.query,
    "op7_near_dedup": near_dedup.query,
    "op8_substring_dedup": substring_dedup.query,
    "op9_warc": warc.query,
    "op10_mix_sources": mixing.query,
    "op11_whiten": whitening.query,
    "op12_hard_negatives": negatives.query,
    "op13_nearest": vptree.query,
}
SQL = {
    "op4_exact_dedup": exact_dedup.SQL,
    "op8_substring_dedup": substring_dedup.SQL,
    "op9_warc": warc.SQL,
    "op12_hard_negatives": negatives.SQL,
    "op13_nearest": vptree.SQL,
}

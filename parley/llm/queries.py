"""The corpus queries by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import byte_bpe, exact_dedup, html_text, near_dup, packing, pii, quality_model, quality_rules, token_counts, toxicity
from .common import documents


def quality_rule_ablations(spark, sf_dir):
    """What each rule of each policy drops, from the ledger of all documents."""
    return quality_rules.ablations(quality_rules.ledger(documents(spark, sf_dir)))


QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_byte_bpe": byte_bpe.op2_byte_bpe,
    "op3_pii": pii.op3_pii,
    "op4_quality_classifier": quality_model.op4_quality_classifier,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_html_text": html_text.op6_html_text,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "quality_rule_ablations": quality_rule_ablations,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_near_dup": near_dup.op9_near_dup,
    "op10_token_counts": token_counts.op10_token_counts,
}

ORACLE = {
    "op5_exact_dedup": exact_dedup.OP5_SQL,
    "op7_quality_rules": quality_rules.OP7_SQL,
    "op9_near_dup": near_dup.OP9_SQL,
}

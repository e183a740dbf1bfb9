"""Queries of the training-data operators and the SQL of those that SQL can express."""

from . import alignment, ann, attribution, extraction, jaccard, langid, mining, mixing, pii, quality, segmentation, tokenfile, topk

QUERIES = {
    "op1_ann": ann.op1_ann,
    "op2_token_counts": attribution.op2_token_counts,
    "op3_jaccard": jaccard.op3_jaccard,
    "op4_quality": quality.op4_quality,
    "op5_pii": pii.op5_pii,
    "op6_topk": topk.op6_topk,
    "op7_tokenfile": tokenfile.op7_tokenfile,
    "op8_mixing": mixing.op8_mixing,
    "op9_segmentation": segmentation.op9_segmentation,
    "op10_extraction": extraction.op10_extraction,
    "op11_hard_negatives": mining.op11_hard_negatives,
    "op12_language": langid.op12_language,
    "op13_alignment": alignment.op13_alignment,
}

SQL = {
    "op6_topk": topk.OP6_SQL,
    "op8_mixing": mixing.OP8_SQL,
    "op11_hard_negatives": mining.OP11_SQL,
}

"""The numbered corpus queries and, where SQL can express one, its DuckDB twin."""

from __future__ import annotations

from . import ann, bpe, codes, hardneg, langid, linededup, media, minhash, mixing, pii, quality, simhash, tokencount

QUERIES = {
    "op1_language_id": langid.op1_language_id,
    "op2_inverted_multi_index": ann.op2_inverted_multi_index,
    "op3_pii": pii.op3_pii,
    "op4_quality": quality.op4_quality,
    "op5_bpe": bpe.op5_bpe,
    "op6_token_counts": tokencount.op6_token_counts,
    "op7_near_dedup": minhash.op7_near_dedup,
    "op8_progressive_jpeg": media.op8_progressive_jpeg,
    "op9_line_dedup": linededup.op9_line_dedup,
    "op10_mixing": mixing.op10_mixing,
    "op11_simhash": simhash.op11_simhash,
    "op12_hard_negatives": hardneg.op12_hard_negatives,
    "op13_vector_codes": codes.op13_vector_codes,
}

SQL = {
    "op7_near_dedup": minhash.ORACLE,
    "op9_line_dedup": linededup.ORACLE,
    "op12_hard_negatives": hardneg.ORACLE,
    "op13_vector_codes": codes.ORACLE,
}

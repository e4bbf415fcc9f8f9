"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from lodestrand.llm import bpe, decontaminate, fingerprint, license, lm_score, pii, quality, simhash, token_store, url_filter

QUERIES = {
    "op1_lm_score": lm_score.op1_lm_score,
    "op2_byte_bpe": bpe.op2_byte_bpe,
    "op3_simhash": simhash.op3_simhash,
    "op4_token_store": token_store.op4_token_store,
    "op5_fingerprint": fingerprint.op5_fingerprint,
    "op6_license": license.op6_license,
    "op7_quality": quality.op7_quality,
    "op8_decontamination": decontaminate.op8_decontamination,
    "op9_pii": pii.op9_pii,
    "op10_url_filter": url_filter.op10_url_filter,
}
SQL = {
    "op6_license": license.OP6_SQL,
    "op8_decontamination": decontaminate.OP8_SQL,
    "op10_url_filter": url_filter.OP10_SQL,
}

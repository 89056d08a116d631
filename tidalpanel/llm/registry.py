"""Queries of this package for the driver, with DuckDB text where SQL can express them."""

from __future__ import annotations

from tidalpanel.llm import ann, bpe, exact_dedup, mixing, pii, quality, simhash, token_files, toxicity, warc

QUERIES = {
    "op1_pii": pii.query,
    "op10_kneser_ney_quality": quality.query,
    "op2_exact_dedup": exact_dedup.query,
    "op3_mix_sources": mixing.query,
    "op4_toxicity": toxicity.query,
    "op5_token_files": token_files.query,
    "op6_simhash_near_dedup": simhash.query,
    "op7_rotated_one_bit_ann": ann.query,
    "op8_byte_bpe": bpe.query,
    "op9_warc_derivatives": warc.query,
}
ORACLE_SQL = {
    "op2_exact_dedup": exact_dedup.SQL,
    "op3_mix_sources": mixing.SQL,
    "op9_warc_derivatives": warc.SQL,
}

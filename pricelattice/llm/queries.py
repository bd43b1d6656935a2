"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, licenses, mixing, neardup, pii, quality, sharding, substrings, vectors

QUERIES = {
    "op1_source_mixing": mixing.query,
    "op2_minhash_neardup": neardup.query,
    "op3_suffix_dedup": substrings.query,
    "op4_license_scan": licenses.query,
    "op5_exact_topk": vectors.query_topk,
    "op6_quality_classifier": quality.query,
    "op7_block_nn": vectors.query_nearest,
    "op8_bpe": bpe.query,
    "op9_pii": pii.query,
    "op10_jump_sharding": sharding.query,
}
SQL = {"op1_source_mixing": mixing.SQL, "op2_minhash_neardup": neardup.SQL, "op5_exact_topk": vectors.SQL_TOPK, "op7_block_nn": vectors.SQL_NEAREST}

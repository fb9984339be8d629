"""The queries of the training-data operators and their SQL, for __spark_entry__."""

from __future__ import annotations

from . import bpe, fingerprint, license_scan, line_quality, mixing, near_dup, sharding, suffix_dedup, token_file, toxicity

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_line_quality": line_quality.op2_line_quality,
    "op3_near_dup": near_dup.op3_near_dup,
    "op4_bpe": bpe.op4_bpe,
    "op5_license_scan": license_scan.op5_license_scan,
    "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
    "op7_token_file": token_file.op7_token_file,
    "op8_fingerprint": fingerprint.op8_fingerprint,
    "op9_mixing": mixing.op9_mixing,
    "op10_toxicity": toxicity.op10_toxicity,
}
SQL = {"op2_line_quality": line_quality.SQL_OP2}

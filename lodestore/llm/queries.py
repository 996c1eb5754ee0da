"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from lodestore.llm import bpe, exact_dedup, language_id, licenses, line_dedup, near_dedup, packing, quality, sharding, warc

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_fertility": quality.op2_fertility,
    "op3_bpe": bpe.op3_bpe,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_license_scan": licenses.op5_license_scan,
    "op6_near_dedup": near_dedup.op6_near_dedup,
    "op7_warc": warc.op7_warc,
    "op8_packing": packing.op8_packing,
    "op9_language_id": language_id.op9_language_id,
    "op10_sharding": sharding.op10_sharding,
}

ORACLE_SQL = {
    "op1_exact_dedup": exact_dedup.SQL,
    "op4_line_dedup": line_dedup.SQL,
    "op7_warc": warc.SQL,
    "op8_packing": packing.SQL,
}

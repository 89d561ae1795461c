"""Queries of the operators, and the SQL that says the same where SQL can."""

from __future__ import annotations

from . import bit_planes, bpe_stream, divergence, embedding_dedup, kneser_ney, line_dedup, media_ts, packing, pii, simhash, substring_dedup, vector_codes, warc

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_media_ts": media_ts.op2_media_ts,
    "op3_packing": packing.op3_packing,
    "op4_pii": pii.op4_pii,
    "op5_embedding_dedup": embedding_dedup.op5_embedding_dedup,
    "op6_kneser_ney": kneser_ney.op6_kneser_ney,
    "op7_bit_planes": bit_planes.op7_bit_planes,
    "op8_suffix_dedup": substring_dedup.op8_suffix_dedup,
    "op9_simhash": simhash.op9_simhash,
    "op10_bpe_stream": bpe_stream.op10_bpe_stream,
    "op11_warc": warc.op11_warc,
    "op12_vector_codes": vector_codes.op12_vector_codes,
    "op13_source_audit": divergence.op13_source_audit,
}
ORACLE_SQL = {
    "op1_line_dedup": line_dedup.SQL,
    "op5_embedding_dedup": embedding_dedup.SQL,
    "op11_warc": warc.SQL,
    "op12_vector_codes": vector_codes.SQL,
    "op13_source_audit": divergence.SQL,
}

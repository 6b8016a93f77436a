"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from landloom.llm import alignment, licenses, negatives, packing, pieces, pii, quality, search, secrets, simhash, sketches, toxicity, warc

QUERIES = {
    "op1_pii_feistel": pii.op1,
    "op2_length_packing": packing.op2,
    "op3_quality_classifier": quality.op3,
    "op4_simhash_near_dedup": simhash.op4,
    "op5_pivot_top_k": search.op5,
    "op6_warc_archive": warc.op6,
    "op7_piece_scan": pieces.op7,
    "op8_licence_scan": licenses.op8,
    "op9_secret_scan": secrets.op9,
    "op10_scaled_sketch": sketches.op10,
    "op11_hard_negatives": negatives.op11,
    "op12_toxicity": toxicity.op12,
    "op13_cross_alignment": alignment.op13,
}

#: The others rest on descent, fingerprints, programmes or spans that SQL can't express; tests hold them against brute force.
ORACLE_SQL = {"op5_pivot_top_k": search.OP5_SQL, "op6_warc_archive": warc.OP6_SQL, "op11_hard_negatives": negatives.OP11_SQL}

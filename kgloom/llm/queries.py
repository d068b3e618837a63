"""The queries of this folder, by name, and the SQL they are held against where SQL can express them."""

from __future__ import annotations

from . import chat, licenses, packing, pii, quality, ring, simhash, transport, unigram, wordpiece

QUERIES = {
    "op1_anchor_pii": pii.op1_anchor_pii,
    "op2_transport_stream": transport.op2_transport_stream,
    "op3_unigram_viterbi": unigram.op3_unigram_viterbi,
    "op4_bounded_ring": ring.op4_bounded_ring,
    "op5_longest_match_counts": wordpiece.op5_longest_match_counts,
    "op6_chat_formatting": chat.op6_chat_formatting,
    "op7_best_fit_packing": packing.op7_best_fit_packing,
    "op8_license_dice": licenses.op8_license_dice,
    "op9_quality_rules": quality.op9_quality_rules,
    "op10_simhash_near_dedup": simhash.op10_simhash_near_dedup,
}

#: The others have what SQL lacks (positions of matches, hashes and tokenizers of libraries, iteration); tests hold them
#: against plain versions.
ORACLE_SQL = {
    "op6_chat_formatting": chat.ORACLE,
    "op8_license_dice": licenses.ORACLE,
    "op9_quality_rules": quality.ORACLE,
}
